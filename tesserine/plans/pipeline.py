"""Run-level operators: collections, outcomes, reconciliation, captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import outcomes
from ..operators import reports
from .base import query, sql_list, table

RES = "(SELECT DISTINCT fetch_id, url, domain, text_path, image_path, category, confidence, error, status, stage, error_code, source FROM results)"
SQL_ANNOTATED = (
    f"(SELECT fetch_id, domain, category, confidence, status, stage, error_code, source, CASE WHEN status = 'ok' THEN FALSE ELSE error_code IN {sql_list(K.RETRYABLE)} END AS retryable FROM "
    "(SELECT fetch_id, domain, category, confidence, source, s AS status, coalesce(nullif(stage, ''), 'infer') AS stage, CASE WHEN s = 'ok' THEN NULL ELSE coalesce(nullif(error_code, ''), 'unknown') END AS error_code FROM "
    f"(SELECT *, coalesce(nullif(status, ''), CASE WHEN category IS NOT NULL AND nullif(error, '') IS NULL THEN 'ok' ELSE 'failed' END) AS s FROM {RES} r) a) b) c"
)


def results(spark: SparkSession, d: str) -> DataFrame:
    cols = ("fetch_id", "url", "domain", "text_path", "image_path", "category", "confidence", "error", "status", "stage", "error_code", "source")
    return table(spark, d, "results").select(*cols).distinct()


def annotated(spark: SparkSession, d: str) -> DataFrame:
    return reports.annotate(results(spark, d)).select("fetch_id", "domain", "category", "confidence", "status", "stage", "error_code", "source", "retryable")


@query(f"SELECT * FROM {SQL_ANNOTATED}")
def annotate_rows(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d)


@query(
    f"SELECT dim, value, n FROM (SELECT 'reason' AS dim, error_code AS value, count(*) AS n FROM {SQL_ANNOTATED} WHERE status = 'failed' GROUP BY error_code UNION ALL SELECT 'stage', stage, count(*) FROM {SQL_ANNOTATED} WHERE status = 'failed' GROUP BY stage UNION ALL SELECT 'source', coalesce(source, 'live'), count(*) FROM {SQL_ANNOTATED} WHERE status = 'ok' GROUP BY coalesce(source, 'live')) t"
)
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.report(annotated(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS classified, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE retryable) AS retryable FROM {SQL_ANNOTATED}")
def run_report_summary(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("classified"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("retryable").alias("retryable"))


@query(f"SELECT DISTINCT fetch_id, domain, error_code FROM {SQL_ANNOTATED} WHERE status = 'failed'")
def missing_list(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).where("status = 'failed'").select("fetch_id", "domain", "error_code").distinct()


@query(f"SELECT fetch_id, concat(domain, chr(9), status, chr(9), coalesce(category, ''), chr(9), coalesce(printf('%.3f', confidence), 'n/a'), chr(9), coalesce(error_code, '')) AS line FROM {SQL_ANNOTATED}")
def cli_table(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", "domain", "status", F.coalesce("category", F.lit("")), F.coalesce(F.format_string("%.3f", "confidence"), F.lit("n/a")), F.coalesce("error_code", F.lit("")))
    return annotated(spark, d).select("fetch_id", F.when(F.col("confidence").isNull(), F.concat_ws("\t", "domain", "status", F.coalesce("category", F.lit("")), F.lit("n/a"), F.coalesce("error_code", F.lit("")))).otherwise(line).alias("line"))


SQL_REQUESTED = "(SELECT DISTINCT lower(trim(domain)) AS name FROM verdicts WHERE domain IS NOT NULL UNION SELECT lower(domain) FROM gold_labels)"
SQL_FIRST = f"(SELECT k, fetch_id, category, confidence, status FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fetch_id) AS r FROM (SELECT *, unnest(list_distinct([domain, url])) AS k FROM {RES} a) b WHERE k <> '') c WHERE r = 1)"


@query(
    f"WITH f AS {SQL_FIRST}, a AS (SELECT q.name, f.fetch_id, f.category, f.confidence, f.status FROM {SQL_REQUESTED} q LEFT JOIN f ON q.name = f.k), "
    "g AS (SELECT min(name) AS name, fetch_id, category, confidence, status FROM a WHERE fetch_id IS NOT NULL GROUP BY fetch_id, category, confidence, status) "
    f"SELECT name, fetch_id, category, confidence, status FROM g UNION ALL SELECT name, NULL, NULL, NULL, 'failed' FROM a WHERE fetch_id IS NULL UNION ALL SELECT NULL, fetch_id, category, confidence, status FROM (SELECT DISTINCT fetch_id, category, confidence, status FROM {RES} x) e WHERE fetch_id NOT IN (SELECT fetch_id FROM g)"
)
def reconcile_requested(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "verdicts").where("domain is not null").select(F.lower(F.trim("domain")).alias("name")).union(table(spark, d, "gold_labels").select(F.lower("domain").alias("name"))).distinct()
    return reports.reconcile(names, results(spark, d))


@query(f"SELECT q.name, EXISTS (SELECT 1 FROM {RES} r WHERE r.domain = q.name AND r.text_path <> '' AND r.image_path <> '') AS cached FROM {SQL_REQUESTED} q")
def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "verdicts").where("domain is not null").select(F.lower(F.trim("domain")).alias("name")).union(table(spark, d, "gold_labels").select(F.lower("domain").alias("name"))).distinct()
    have = results(spark, d).where("text_path <> '' and image_path <> ''").select(F.col("domain").alias("name")).distinct()
    hit = names.join(have, "name", "left_semi").withColumn("cached", F.lit(True))
    return hit.unionByName(names.join(have, "name", "left_anti").withColumn("cached", F.lit(False)))


SQL_ITEMS = "(SELECT DISTINCT collection_id, u.url AS url, u.domain AS domain, u.text_path AS text_path, u.image_path AS image_path, u.fetch_success AS fetch_success, u.cached AS cached, u.error AS error FROM (SELECT collection_id, unnest(domains) AS u FROM collections) a)"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the envelopes, once each however often delivered."""
    x = table(spark, d, "collections").select("collection_id", F.explode("domains").alias("u"))
    return x.select("collection_id", *[f"u.{c}" for c in ("url", "domain", "text_path", "image_path", "fetch_success", "cached", "error")]).distinct()


@query(f"SELECT * FROM {SQL_ITEMS} t")
def collection_items(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d)


@query(f"SELECT collection_id, count(*) AS total, count(*) FILTER (WHERE fetch_success) AS successful, count(*) FILTER (WHERE NOT fetch_success) AS failed, count(*) FILTER (WHERE cached) AS cached FROM {SQL_ITEMS} t GROUP BY collection_id")
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("collection_id").agg(F.count("*").alias("total"), F.count_if("fetch_success").alias("successful"), F.count_if(~F.col("fetch_success")).alias("failed"), F.count_if("cached").alias("cached"))


@query("SELECT collection_id, max(CAST(regexp_replace(replace(timestamp_text, ' ', 'T'), '(Z|[+]00:00Z?)$', '') AS TIMESTAMP)) AS collected_at, count(*) AS deliveries FROM collections GROUP BY collection_id")
def collection_list(spark: SparkSession, d: str) -> DataFrame:
    ts = F.try_to_timestamp(F.regexp_replace(F.replace("timestamp_text", F.lit(" "), F.lit("T")), "(Z|[+]00:00Z?)$", ""))
    return table(spark, d, "collections").groupBy("collection_id").agg(F.max(ts).cast("timestamp_ntz").alias("collected_at"), F.count("*").alias("deliveries"))


@query(
    f"SELECT r.fetch_id, r.domain, r.status, CASE WHEN r.status = 'failed' THEN coalesce(nullif(r.error, ''), i.error) END AS error, i.collection_id FROM {RES} r LEFT JOIN "
    f"(SELECT domain, max(collection_id) AS collection_id, arg_max(nullif(error, ''), collection_id || coalesce(url, '') || coalesce(error, '')) AS error FROM {SQL_ITEMS} t WHERE domain IS NOT NULL GROUP BY domain) i ON r.domain = i.domain"
)
def annotate_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Results left-joined with the last collection entry of their domain."""
    order = F.concat("collection_id", F.coalesce("url", F.lit("")), F.coalesce("error", F.lit("")))
    x = items(spark, d).where("domain is not null").withColumn("e", outcomes.given(F.col("error"))).withColumn("o", order)
    last = x.groupBy("domain").agg(F.max("collection_id").alias("collection_id"), F.max_by("e", F.when(F.col("e").isNotNull(), F.col("o"))).alias("c_error"))
    r = results(spark, d).join(last, "domain", "left")
    return r.select("fetch_id", "domain", "status", F.when(F.col("status") == "failed", F.coalesce(outcomes.given(F.col("error")), "c_error")).alias("error"), "collection_id")


@query(
    f"WITH a AS (SELECT url, max(fetch_id) AS archived FROM fetch_results WHERE success AND source = 'archive' GROUP BY url) SELECT f.fetch_id, CASE WHEN f.success THEN f.fetch_id WHEN f.error_code IN {sql_list(K.ARCHIVE_RECOVERABLE)} THEN a.archived END AS served_by, "
    f"CASE WHEN f.success THEN NULL WHEN f.error_code IN {sql_list(K.ARCHIVE_RECOVERABLE)} AND a.archived IS NOT NULL THEN NULL ELSE coalesce(nullif(f.error_code, ''), 'unknown') END AS error_code FROM fetch_results f LEFT JOIN a ON f.url = a.url WHERE f.source = 'live'"
)
def archive_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A live failure of a recoverable kind is served by the archive's page."""
    f = table(spark, d, "fetch_results")
    a = f.where("success and source = 'archive'").groupBy("url").agg(F.max("fetch_id").alias("archived"))
    can = F.coalesce(F.col("error_code").isin(*K.ARCHIVE_RECOVERABLE), F.lit(False))
    x = f.where("source = 'live'").select("fetch_id", "url", "success", "error_code").join(a, "url", "left")
    served = F.when(F.col("success"), F.col("fetch_id")).when(can, F.col("archived"))
    return x.select("fetch_id", served.alias("served_by"), F.when(F.col("success") | (can & F.col("archived").isNotNull()), F.lit(None).cast("string")).otherwise(F.coalesce(outcomes.given(F.col("error_code")), F.lit("unknown"))).alias("error_code"))


SQL_DAILY = "(SELECT domain, min(try_strptime(capture_ts, '%Y%m%d%H%M%S')) AS ts FROM crawl_index WHERE status = '200' AND try_strptime(capture_ts, '%Y%m%d%H%M%S') IS NOT NULL GROUP BY domain, substr(capture_ts, 1, 8))"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Captures of status 200, the first of each day of a domain."""
    ts = F.try_to_timestamp(F.when(F.col("capture_ts").rlike("^[0-9]{14}$"), F.col("capture_ts")), F.lit("yyyyMMddHHmmss"))
    return table(spark, d, "crawl_index").where("status = '200'").withColumn("ts", ts).where("ts is not null").groupBy("domain", F.substring("capture_ts", 1, 8).alias("day")).agg(F.min("ts").alias("ts")).select("domain", "ts")


@query(
    f"SELECT fetch_id, ts AS capture, abs(epoch_us(ts) - epoch_us(CAST(fetched_at AS TIMESTAMP))) // 1000000 AS away_s FROM (SELECT f.fetch_id, f.fetched_at, c.ts, row_number() OVER (PARTITION BY f.fetch_id ORDER BY abs(epoch_us(c.ts) - epoch_us(CAST(f.fetched_at AS TIMESTAMP))), c.ts) AS r FROM fetch_results f JOIN {SQL_DAILY} c ON f.domain = c.domain WHERE abs(epoch_us(c.ts) - epoch_us(CAST(f.fetched_at AS TIMESTAMP))) <= {K.ARCHIVE_DAYS} * 86400000000) t WHERE r = 1"
)
def nearest_capture(spark: SparkSession, d: str) -> DataFrame:
    """As-of nearest join: the capture nearest each fetch within a year, earliest on
    ties.  A domain has one capture a day at most, so its captures travel as one
    array bounded by the calendar and no pair of rows is formed."""
    days = _daily(spark, d).groupBy("domain").agg(F.collect_set("ts").alias("all"))
    x = table(spark, d, "fetch_results").select("fetch_id", "domain", "fetched_at").join(days, "domain")
    at = F.unix_micros("fetched_at")
    near = F.array_min(F.transform("all", lambda t: F.struct(F.abs(F.unix_micros(t) - at).alias("away"), t.alias("ts"))))
    x = x.withColumn("n", near).where(F.col("n.away") <= K.ARCHIVE_DAYS * 86_400_000_000)
    return x.select("fetch_id", F.col("n.ts").cast("timestamp_ntz").alias("capture"), F.expr("n.away div 1000000").alias("away_s"))


@query(f"SELECT f.fetch_id, datediff('day', CAST(max(c.ts) AS DATE), CAST(f.fetched_at AS DATE)) > 30 AS stale FROM fetch_results f JOIN {SQL_DAILY} c ON f.domain = c.domain GROUP BY f.fetch_id, f.fetched_at")
def stale_capture(spark: SparkSession, d: str) -> DataFrame:
    last = _daily(spark, d).groupBy("domain").agg(F.max("ts").alias("last"))
    return table(spark, d, "fetch_results").join(last, "domain").select("fetch_id", (F.date_diff(F.to_date("fetched_at"), F.to_date("last")) > 30).alias("stale"))


@query("SELECT domain, count(*) AS rows, count(DISTINCT url) AS urls, min(capture_ts) AS first_ts, max(capture_ts) AS last_ts FROM (SELECT DISTINCT * FROM crawl_index) t WHERE domain IS NOT NULL GROUP BY domain")
def index_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_index").distinct().where("domain is not null").groupBy("domain").agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"), F.min("capture_ts").alias("first_ts"), F.max("capture_ts").alias("last_ts"))


@query("SELECT url, fetch_id, domain, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetch_id) AS r FROM fetch_results WHERE url IS NOT NULL) t WHERE r = 1")
def keep_first_url(spark: SparkSession, d: str) -> DataFrame:
    return reports.first_by(table(spark, d, "fetch_results").where("url is not null").select("url", "fetch_id", "domain", "title"), "url", "fetch_id")


@query("SELECT fetch_id, live_id FROM (SELECT f.fetch_id, g.live_id FROM fetch_results f JOIN (SELECT domain, max(fetch_id) AS live_id FROM fetch_results WHERE source = 'live' AND success GROUP BY domain) g ON f.domain = g.domain WHERE f.source = 'archive') t")
def archive_with_live(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of a domain side by side (rows union, then matched)."""
    f = table(spark, d, "fetch_results")
    live = f.where("source = 'live' and success").groupBy("domain").agg(F.max("fetch_id").alias("live_id"))
    return f.where("source = 'archive'").join(live, "domain").select("fetch_id", "live_id")
