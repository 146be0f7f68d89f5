"""Choosing, ordering and describing rows: limits, samples, requests, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import url
from ..operators import ranking
from .base import q, query, sql_list, table
from .pipeline import SQL_ANNOTATED, SQL_FIRST, annotated, results
from .scalars import ALLOWED_TYPES, SQL_BARE, SQL_DOMAIN

LIMIT, PER_SPLIT, PER_CATEGORY, DELAY = 50, 7, 20, 2
#: Types that call for a sandbox and the modes of the header check (fixed values).
RISKY = ("application/pdf", "application/octet-stream", "application/zip", "application/x-executable", "application/x-msdownload", "application/x-msdos-program")
MODES = ("strict", "moderate", "permissive")


@query(f"SELECT q.pos, q.name, f.fetch_id, f.category, coalesce(f.status, 'failed') AS status FROM (SELECT lower(trim(domain)) AS name, min(verdict_id) AS pos FROM verdicts WHERE domain IS NOT NULL GROUP BY 1) q LEFT JOIN {SQL_FIRST} f ON q.name = f.k ORDER BY q.pos")
def requested_order(spark: SparkSession, d: str) -> DataFrame:
    """One row for each request, in the order of the requests, none lost."""
    req = table(spark, d, "verdicts").where("domain is not null").groupBy(F.lower(F.trim("domain")).alias("name")).agg(F.min("verdict_id").alias("pos"))
    keyed = results(spark, d).select("fetch_id", "category", "status", F.explode(F.array_distinct(F.array("domain", "url"))).alias("k")).where("k <> ''")
    first = keyed.groupBy(F.col("k").alias("name")).agg(F.min_by(F.struct("fetch_id", "category", "status"), "fetch_id").alias("f"))
    return req.join(first, "name", "left").select("pos", "name", "f.fetch_id", "f.category", F.coalesce("f.status", F.lit("failed")).alias("status")).orderBy("pos")


SQL_DIMS = (
    f"(SELECT 'reason' AS dim, error_code AS value, count(*) AS n FROM {SQL_ANNOTATED} WHERE status = 'failed' GROUP BY error_code UNION ALL SELECT 'stage', stage, count(*) FROM {SQL_ANNOTATED} WHERE status = 'failed' GROUP BY stage "
    f"UNION ALL SELECT 'source', coalesce(source, 'live'), count(*) FROM {SQL_ANNOTATED} WHERE status = 'ok' GROUP BY coalesce(source, 'live'))"
)


@query(f"SELECT dim, string_agg(concat(value, '=', n), ',' ORDER BY n DESC, value) AS counts FROM {SQL_DIMS} t WHERE value IS NOT NULL GROUP BY dim")
def run_report_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The report's maps, each sorted by count (a handful of codes)."""
    from ..operators import reports

    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", "n")))
    line = F.array_join(F.transform(rows, lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",")
    return reports.report(annotated(spark, d)).groupBy("dim").agg(line.alias("counts"))


@query("SELECT coalesce(category, '') AS category, count(*) AS n FROM results GROUP BY 1 ORDER BY n DESC, category")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


# -- headers ------------------------------------------------------------------------
SQL_HEADERS = "(SELECT DISTINCT lower(trim(split_part(coalesce(mime, ''), ';', 1))) AS type, contains(lower(url), '.pdf') OR CAST(coalesce(TRY_CAST(offset_text AS BIGINT), 1) AS BIGINT) % 7 = 0 AS attachment FROM crawl_index)"


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """Content types as answered; every seventh offset stands for an attachment, which
    the index does not tell."""
    kind = F.lower(F.trim(F.split_part(F.coalesce("mime", F.lit("")), F.lit(";"), F.lit(1))))
    forced = F.contains(F.lower("url"), F.lit(".pdf")) | (F.coalesce(F.col("offset_text").try_cast("bigint"), F.lit(1)) % 7 == 0)
    return table(spark, d, "crawl_index").select(kind.alias("type"), forced.alias("attachment")).distinct()


def _starts(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(c, F.lit(p))
    return out


def _sql_starts(c: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, {q(p)})" for p in parts) + ")"


@query(
    f"SELECT type, attachment, mode, NOT (coalesce(attachment, FALSE) OR (type <> '' AND NOT ok AND mode = 'strict')) AS safe, CASE WHEN coalesce(attachment, FALSE) THEN 'forced download' WHEN type = '' THEN 'no type' WHEN ok THEN '' WHEN mode = 'strict' THEN 'refused type' "
    "WHEN mode = 'moderate' THEN 'unsafe type' ELSE 'odd type' END AS reason, coalesce(attachment, FALSE) OR type = '' OR (NOT ok AND (mode = 'strict' OR (mode = 'moderate' AND risky))) AS sandbox "
    f"FROM (SELECT *, {_sql_starts('type', ALLOWED_TYPES)} AS ok, {_sql_starts('type', RISKY)} AS risky FROM {SQL_HEADERS} h, (VALUES ('strict'), ('moderate'), ('permissive')) m(mode)) t"
)
def header_rules(spark: SparkSession, d: str) -> DataFrame:
    """The check of headers before a download, in its three modes."""
    x = _headers(spark, d).select("type", "attachment", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    forced, none = F.coalesce("attachment", F.lit(False)), F.col("type") == ""
    ok, risky = _starts(F.col("type"), ALLOWED_TYPES), _starts(F.col("type"), RISKY)
    strict, moderate = F.col("mode") == "strict", F.col("mode") == "moderate"
    reason = F.when(forced, "forced download").when(none, "no type").when(ok, "").when(strict, "refused type").when(moderate, "unsafe type").otherwise("odd type")
    return x.select("type", "attachment", "mode", (~(forced | (~none & ~ok & strict))).alias("safe"), reason.alias("reason"), (forced | none | (~ok & (strict | (moderate & risky)))).alias("sandbox"))


@query(
    "SELECT type, CASE WHEN starts_with(type, 'application/pdf') THEN 'PDF document detected' WHEN starts_with(type, 'application/octet-stream') THEN 'Binary content detected' WHEN starts_with(type, 'application/zip') OR contains(type, 'archive') THEN 'Archive file detected' ELSE 'Unsupported content type' END AS headline, "
    f"{_sql_starts('type', RISKY)} AS sandbox, count(*) AS n FROM (SELECT lower(trim(split_part(mime, ';', 1))) AS type FROM crawl_index WHERE mime <> '') t WHERE NOT {_sql_starts('type', ALLOWED_TYPES)} GROUP BY type"
)
def content_type_errors(spark: SparkSession, d: str) -> DataFrame:
    """What a refused type is called and whether it calls for a sandbox."""
    t = F.col("type")
    x = table(spark, d, "crawl_index").where("mime <> ''").select(F.lower(F.trim(F.split_part("mime", F.lit(";"), F.lit(1)))).alias("type")).where(~_starts(t, ALLOWED_TYPES))
    head = F.when(F.startswith(t, F.lit("application/pdf")), "PDF document detected").when(F.startswith(t, F.lit("application/octet-stream")), "Binary content detected")
    head = head.when(F.startswith(t, F.lit("application/zip")) | F.contains(t, F.lit("archive")), "Archive file detected").otherwise("Unsupported content type")
    return x.groupBy("type").agg(F.count("*").alias("n")).select("type", head.alias("headline"), _starts(t, RISKY).alias("sandbox"), "n")


# -- limits and samples ---------------------------------------------------------------
@query(f"SELECT split, doc_id, domain, category FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS r FROM documents WHERE split IN ('train', 'val', 'test')) t WHERE r <= {PER_SPLIT}")
def split_domains(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each split, a limit for each."""
    x = table(spark, d, "documents").where(F.col("split").isin("train", "val", "test")).select("split", "doc_id", "domain", "category")
    w = Window.partitionBy("split").orderBy("doc_id")
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PER_SPLIT).drop("r")


@query(f"SELECT split, domain, doc_id FROM (SELECT split, domain, doc_id FROM documents WHERE category IS NOT NULL ORDER BY sha256(concat('7:', doc_id)), doc_id LIMIT {LIMIT}) t ORDER BY split, domain, doc_id")
def seeded_limit(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of a limited number of documents, by split and domain."""
    x = table(spark, d, "documents").where("category is not null").select("split", "domain", "doc_id")
    return x.orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(LIMIT).orderBy("split", "domain", "doc_id")


@query(f"SELECT category, doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS part FROM (SELECT category, doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 100 AS b, row_number() OVER (PARTITION BY category ORDER BY h, doc_id) AS r FROM (SELECT category, doc_id, sha256(concat('10:', doc_id)) AS h FROM documents WHERE category IS NOT NULL) a) t WHERE r <= {PER_CATEGORY}")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most so many documents a category, seeded, cut 80/10/10 by digest."""
    x = table(spark, d, "documents").where("category is not null").select("category", "doc_id", F.sha2(F.concat(F.lit("10:"), F.col("doc_id").cast("string")), 256).alias("h"))
    w = Window.partitionBy("category").orderBy("h", "doc_id")
    b = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % 100
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PER_CATEGORY).select("category", "doc_id", F.when(b < 80, "train").when(b < 90, "val").otherwise("test").alias("part"))


@query(f"SELECT doc_id FROM documents WHERE text <> '' ORDER BY doc_id LIMIT {LIMIT}")
def stop_after(spark: SparkSession, d: str) -> DataFrame:
    """Stop after so many kept documents."""
    return table(spark, d, "documents").where("text <> ''").select("doc_id").orderBy("doc_id").limit(LIMIT)


# -- requests -------------------------------------------------------------------------
@query(f"SELECT domain, last_url, valid FROM (SELECT domain, arg_max(url, fetch_id) AS last_url FROM (SELECT fetch_id, url, {SQL_DOMAIN} AS domain FROM fetch_results WHERE url <> '') a GROUP BY domain) t, LATERAL (SELECT coalesce(regexp_matches({SQL_BARE}, {q(url.DOMAIN)}) AND length({SQL_BARE}) <= 253, FALSE) AS valid) v")
def url_batch_map(spark: SparkSession, d: str) -> DataFrame:
    """The address a domain stands for in a batch: the last one asked for."""
    x = table(spark, d, "fetch_results").where("url <> ''").select("fetch_id", "url", url.domain_of(F.col("url")).alias("domain"))
    return x.groupBy("domain").agg(F.max_by("url", "fetch_id").alias("last_url")).withColumn("valid", url.is_valid_domain(F.col("domain")))


@query("SELECT doc_id, split, domain FROM documents t WHERE EXISTS (SELECT 1 FROM fetch_results f WHERE f.screenshot_path <> '' AND lower(f.domain) = lower(t.domain))")
def modality_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of domains that have a screenshot."""
    shot = table(spark, d, "fetch_results").where("screenshot_path <> ''").select(F.lower("domain").alias("k")).distinct()
    return table(spark, d, "documents").select("doc_id", "split", "domain", F.lower("domain").alias("k")).join(shot, "k", "left_semi").select("doc_id", "split", "domain")


SQL_ITEMS = "(SELECT DISTINCT collection_id, i.domain AS domain, i.fetch_success AS ok, i.text_path AS text_path, i.image_path AS image_path FROM (SELECT collection_id, unnest(domains) AS i FROM collections) a)"


@query(
    f"SELECT collection_id, domain, coalesce(ok, FALSE) AS text, coalesce(ok AND image_path <> '', FALSE) AS image, coalesce(ok AND text_path <> '', FALSE) AS llm_text, coalesce(ok AND text_path <> '' AND image_path <> '', FALSE) AS llm_multimodal FROM {SQL_ITEMS} t WHERE ok"
)
def items_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Fetched items and the kinds of classification their paths allow; by text an
    item without path is kept, to be refused with a reason."""
    x = table(spark, d, "collections").select("collection_id", F.explode("domains").alias("i")).select("collection_id", "i.domain", F.col("i.fetch_success").alias("ok"), "i.text_path", "i.image_path").distinct().where("ok")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return x.select("collection_id", "domain", F.col("ok").alias("text"), has("image_path").alias("image"), has("text_path").alias("llm_text"), (has("text_path") & has("image_path")).alias("llm_multimodal"))


@query(
    "SELECT fetch_id, CASE WHEN NOT success THEN 'fetch' WHEN m IS NOT NULL THEN 'infer' END AS stage, CASE WHEN NOT success AND coalesce(error_code, '') <> '' THEN error_code WHEN m IS NULL THEN NULL WHEN contains(m, 'no meaningful text') THEN 'empty_text' WHEN contains(m, 'not found') THEN 'missing_input_path' ELSE 'other' END AS code "
    "FROM (SELECT fetch_id, success, error_code, CASE WHEN NOT success THEN coalesce(lower(error), '') WHEN coalesce(text, '') = '' THEN 'no meaningful text' WHEN coalesce(html, '') = '' THEN 'html file not found' END AS m FROM fetch_results) t"
)
def attribute_failures(spark: SparkSession, d: str) -> DataFrame:
    """Stage and code of a failure by where and with what message it came."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    m = F.when(~F.col("success"), F.coalesce(F.lower("error"), F.lit(""))).when(empty("text"), "no meaningful text").when(empty("html"), "html file not found")
    x = table(spark, d, "fetch_results").select("fetch_id", "success", "error_code", m.alias("m"))
    has = lambda p: F.contains("m", F.lit(p))
    code = F.when(~F.col("success") & ~empty("error_code"), F.col("error_code")).when(F.col("m").isNull(), F.lit(None).cast("string")).when(has("no meaningful text"), "empty_text").when(has("not found"), "missing_input_path").otherwise("other")
    return x.select("fetch_id", F.when(~F.col("success"), "fetch").when(F.col("m").isNotNull(), "infer").alias("stage"), code.alias("code"))


@query(f"SELECT fetch_id, domain, {DELAY} * (row_number() OVER (PARTITION BY domain ORDER BY fetch_id) - 1) AS at_seconds FROM fetch_results WHERE domain IS NOT NULL")
def host_spacing(spark: SparkSession, d: str) -> DataFrame:
    """When each request to a host may start, a delay apart; a hot host is cut into
    blocks, so none of its requests pile up in one task."""
    x = table(spark, d, "fetch_results").where("domain is not null").select("fetch_id", "domain")
    return ranking.running(x, ["domain"], "fetch_id", F.lit(1), "before").select("fetch_id", "domain", (F.col("before") * DELAY).alias("at_seconds"))


@query("SELECT domain, labels, contains(labels, e) AS named FROM (SELECT lower(trim(domain)) AS domain, string_agg(DISTINCT raw_label, ',' ORDER BY raw_label) AS labels FROM verdicts WHERE raw_label IS NOT NULL AND domain IS NOT NULL GROUP BY 1) v JOIN (SELECT lower(domain) AS g, min(expected) AS e FROM gold_labels GROUP BY 1) w ON v.domain = w.g")
def labels_name_gold(spark: SparkSession, d: str) -> DataFrame:
    """All labels of a gold domain in one text and whether it names the gold label
    (labels are a small vocabulary, so a domain's set is bounded)."""
    v = table(spark, d, "verdicts").where("raw_label is not null and domain is not null").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.array_join(F.array_sort(F.collect_set("raw_label")), ",").alias("labels"))
    g = table(spark, d, "gold_labels").groupBy(F.lower("domain").alias("domain")).agg(F.min("expected").alias("e"))
    return v.join(g, "domain").select("domain", "labels", F.contains("labels", F.col("e")).alias("named"))


@query("SELECT origin, split, count(*) AS n, count(DISTINCT domain) AS domains FROM (SELECT 'documents' AS origin, split, domain FROM documents UNION ALL SELECT 'verdicts', split, lower(trim(domain)) FROM verdicts UNION ALL SELECT 'fetched', NULL, domain FROM fetch_results) t GROUP BY origin, split")
def frames_united(spark: SparkSession, d: str) -> DataFrame:
    """Frames of different tables under one another, counted."""
    one = lambda t, split, dom: table(spark, d, t).select(F.lit("fetched" if t == "fetch_results" else t).alias("origin"), split.alias("split"), dom.alias("domain"))
    x = one("documents", F.col("split"), F.col("domain")).unionByName(one("verdicts", F.col("split"), F.lower(F.trim("domain")))).unionByName(one("fetch_results", F.lit(None).cast("string"), F.col("domain")))
    return x.groupBy("origin", "split").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"))


@query("SELECT DISTINCT screenshot_path, regexp_replace(regexp_extract(screenshot_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, regexp_replace(screenshot_path, '/[^/]*$', '') AS folder FROM fetch_results WHERE screenshot_path <> ''")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Stem and folder of a screenshot's path, by which its domain is looked up."""
    p = F.col("screenshot_path")
    return table(spark, d, "fetch_results").where("screenshot_path <> ''").select(p, F.regexp_replace(F.regexp_extract(p, "([^/]*)$", 1), r"\.[^.]*$", "").alias("stem"), F.regexp_replace(p, "/[^/]*$", "").alias("folder")).distinct()


@query(f"SELECT code, count(*) AS n, bool_and(code IN {sql_list(K.RETRYABLE)}) AS retryable FROM (SELECT coalesce(nullif(error_code, ''), 'unknown') AS code FROM fetch_results WHERE NOT success) t GROUP BY code")
def retry_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Failures by code and whether a retry may help."""
    code = F.coalesce(F.nullif("error_code", F.lit("")), F.lit("unknown"))
    return table(spark, d, "fetch_results").where("not success").groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("retryable", F.col("code").isin(*K.RETRYABLE))
