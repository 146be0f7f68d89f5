"""Around fetching: guards, captures to read, scores end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..engine import Engine
from ..functions import outcomes, taxonomy, url
from ..operators import crawls, reports
from ..scoring import TextScorer
from .base import q, query, sql_list, table
from .corpus import sql_map

SQL_USABLE = (
    "status = '200' AND contains(mime, 'html') AND coalesce(filename, '') <> '' AND coalesce(offset_text, '') <> '' AND coalesce(length_text, '') <> '' AND contains(url, domain) "
    "AND regexp_matches(substr(url, instr(url, domain) + length(domain)), '^(/?|/index\\.html|/[?#](.|\n)*)$')"
)


@query(f"SELECT domain, url, capture_ts, filename FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY capture_ts, url, filename, offset_text) AS r FROM (SELECT DISTINCT * FROM crawl_index) t WHERE {SQL_USABLE} AND domain IS NOT NULL) u WHERE r = 1")
def first_usable_capture(spark: SparkSession, d: str) -> DataFrame:
    """The earliest readable home-page record of each domain."""
    x = table(spark, d, "crawl_index").distinct().where("domain is not null")
    ok = url.usable_capture(*(F.col(c) for c in ("status", "mime", "filename", "offset_text", "length_text", "url", "domain")))
    return crawls.first_usable(x, ok, F.struct("capture_ts", "url", "filename", "offset_text")).select("domain", "url", "capture_ts", "filename")


@query(
    "SELECT fetch_id, CASE WHEN domain IS NULL OR domain = '' THEN 'invalid_domain' WHEN error_code = 'dns_error' THEN 'dns_error' WHEN error_code = 'robots_blocked' THEN 'robots_blocked' WHEN error_code = 'content_type_rejected' THEN 'content_type_rejected' WHEN NOT success THEN coalesce(nullif(error_code, ''), 'unknown') END AS refused FROM fetch_results"
)
def fetch_guards(spark: SparkSession, d: str) -> DataFrame:
    """The first guard a request fails, cheap ones first."""
    c = F.col("error_code")
    refused = F.when(F.coalesce("domain", F.lit("")) == "", "invalid_domain")
    for name in ("dns_error", "robots_blocked", "content_type_rejected"):
        refused = refused.when(c == name, name)
    return table(spark, d, "fetch_results").select("fetch_id", refused.when(~F.col("success"), F.coalesce(outcomes.given(c), F.lit("unknown"))).alias("refused"))


HOSTS = (("a.example", True), ("a.example", False), ("b.example", True), ("c.example", None), ("d.example", False))


@query("SELECT host, CASE WHEN bool_and(public IS NOT NULL AND public) THEN NULL WHEN bool_or(public IS NOT NULL AND NOT public) THEN 'private_address' ELSE 'dns_error' END AS refused FROM (VALUES " + ", ".join(f"({q(h)}, {'NULL' if p is None else str(p).upper()})" for h, p in HOSTS) + ") t(host, public) GROUP BY host")
def host_guard(spark: SparkSession, d: str) -> DataFrame:
    """A host passes if it resolves and all its addresses are public."""
    x = spark.createDataFrame(list(HOSTS), "host string, public boolean")
    known = F.coalesce("public", F.lit(False))
    bad = F.col("public").isNotNull() & ~known
    return x.groupBy("host").agg(F.when(F.bool_and(known), F.lit(None).cast("string")).when(F.bool_or(bad), "private_address").otherwise("dns_error").alias("refused"))


@query(f"SELECT verdict_id, CASE WHEN contains(raw_label, '/') AND split_part(raw_label, '/', 1) IN (SELECT expected FROM gold_labels) THEN split_part(raw_label, '/', 1) ELSE {sql_map('raw_label')} END AS label FROM verdicts WHERE raw_label IS NOT NULL")
def eval_space(spark: SparkSession, d: str) -> DataFrame:
    """Labels in the space of the gold labels: a nested one maps to its parent if
    that is a gold label."""
    gold = table(spark, d, "gold_labels").select(F.col("expected").alias("parent")).distinct().withColumn("known", F.lit(True))
    v = table(spark, d, "verdicts").where("raw_label is not null").select("verdict_id", "raw_label", F.split_part("raw_label", F.lit("/"), F.lit(1)).alias("parent"))
    x = v.join(gold, "parent", "left")
    return x.select("verdict_id", F.when(F.contains("raw_label", F.lit("/")) & F.col("known"), F.col("parent")).otherwise(taxonomy.map_category(F.col("raw_label"))).alias("label"))


RATES = (("small", 0.0005), ("large", 0.03))


@query("SELECT model, round(sum(length(coalesce(reasoning, '')) // 4 / 1000.0 * CASE WHEN contains(model, 'small') THEN 0.0005 WHEN contains(model, 'large') THEN 0.03 ELSE 0.03 END), 6) AS cost FROM verdicts GROUP BY model")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Spend by model: tokens by length, the rate by the first name part."""
    rate = F.when(F.lit(False), 0.0)
    for name, r in RATES:
        rate = rate.when(F.contains("model", F.lit(name)), r)
    n = F.expr("length(coalesce(reasoning, '')) div 4")
    return table(spark, d, "verdicts").groupBy("model").agg(F.round(F.sum(n / 1000.0 * rate.otherwise(0.03)), 6).alias("cost"))


@query("SELECT domain, min(priority) AS priority, arg_min(id, priority * 10000000 + id) AS id FROM (SELECT domain, 0 AS priority, doc_id AS id FROM documents WHERE domain IS NOT NULL AND text <> '' UNION ALL SELECT domain, 1, fetch_id FROM fetch_results WHERE domain IS NOT NULL AND text <> '') t GROUP BY domain")
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    """The first source, in order of priority, that holds a domain."""
    a = table(spark, d, "documents").where("domain is not null and text <> ''").select("domain", F.lit(0).alias("priority"), F.col("doc_id").alias("id"))
    b = table(spark, d, "fetch_results").where("domain is not null and text <> ''").select("domain", F.lit(1).alias("priority"), F.col("fetch_id").alias("id"))
    return a.unionByName(b).groupBy("domain").agg(F.min("priority").alias("priority"), F.min_by("id", F.struct("priority", "id")).alias("id"))


@query(f"SELECT category, category IN {sql_list(K.CLASSES)} AS valid, count(*) AS n FROM results WHERE category IS NOT NULL GROUP BY 1, 2")
def valid_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").where("category is not null").groupBy("category", F.col("category").isin(*K.CLASSES).alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT fetch_id, k AS label, v AS probability FROM (SELECT DISTINCT fetch_id, unnest(map_keys(raw_predictions)) AS k, unnest(map_values(raw_predictions)) AS v FROM results WHERE raw_predictions IS NOT NULL) t QUALIFY v >= 0.10 OR (max(v) OVER (PARTITION BY fetch_id) < 0.10 AND row_number() OVER (PARTITION BY fetch_id ORDER BY v DESC, k) = 1)")
def result_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of results at or above the floor, the best one where none is."""
    x = table(spark, d, "results").where("raw_predictions is not null").select("fetch_id", F.explode("raw_predictions").alias("label", "probability")).distinct()
    best = x.groupBy("fetch_id").agg(F.max("probability").alias("top"), F.min_by("label", F.struct(-F.col("probability"), "label")).alias("best"))
    kept = x.join(best, "fetch_id").where((F.col("probability") >= K.LABEL_FLOOR) | ((F.col("top") < K.LABEL_FLOOR) & (F.col("label") == F.col("best"))))
    return kept.select("fetch_id", "label", "probability")


@query()
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    """Train a text scorer on the corpus' training split, classify fetched pages."""
    docs = table(spark, d, "documents").where("split = 'train' and category is not null and text <> ''").select("text", "category")
    pages = table(spark, d, "fetch_results").select("fetch_id", "url", "domain", "html", "text", "error", "error_code", "source")
    return Engine(TextScorer.fit(docs)).classify(pages).select("fetch_id", "domain", "category", "confidence", "status", "stage", "error_code", "retryable")


@query()
def run_report_fresh(spark: SparkSession, d: str) -> DataFrame:
    """The report of that run."""
    docs = table(spark, d, "documents").where("split = 'train' and category is not null and text <> ''").select("text", "category")
    pages = table(spark, d, "fetch_results").select("fetch_id", "url", "domain", "html", "text", "error", "error_code", "source")
    return reports.report(Engine(TextScorer.fit(docs)).classify(pages))


