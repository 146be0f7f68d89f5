"""The log of judgements: latest per domain, cells, application, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text
from ..operators import ranking, replies
from ..operators.reports import last_by
from .base import q, query, sql_list, table

PROMPT, FLOOR, BUDGET, COST = "c41d09ab", 0.6, 0.5, 0.002
STATUS = ("parked", "unavailable")
SQL_LAST = f"(SELECT * EXCLUDE (r) FROM (SELECT *, lower(trim(domain)) AS dom, row_number() OVER (PARTITION BY lower(trim(domain)) ORDER BY verdict_id DESC) AS r FROM verdicts WHERE prompt_hash = {q(PROMPT)} AND domain IS NOT NULL) a WHERE r = 1)"
SQL_CELL = f"CASE WHEN status IS DISTINCT FROM 'ok' OR category IS NULL THEN concat('no-verdict:', coalesce(status, '')) WHEN category = old_category THEN 'keep' WHEN category IN {sql_list(STATUS)} THEN 'move:status' ELSE concat('move:', category) END"


def latest(spark: SparkSession, d: str) -> DataFrame:
    """The last verdict of each domain under the prompt; combined map-side."""
    v = table(spark, d, "verdicts").where((F.col("prompt_hash") == PROMPT) & F.col("domain").isNotNull()).withColumn("dom", F.lower(F.trim("domain")))
    return last_by(v, "dom", "verdict_id")


def cell(status: Column, category: Column, old: Column) -> Column:
    return (
        F.when(~status.eqNullSafe("ok") | category.isNull(), F.concat(F.lit("no-verdict:"), F.coalesce(status, F.lit(""))))
        .when(category == old, "keep")
        .when(category.isin(*STATUS), "move:status")
        .otherwise(F.concat(F.lit("move:"), category))
    )


@query(f"SELECT dom, verdict_id, category, confidence, status FROM {SQL_LAST} v")
def verdict_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d).select("dom", "verdict_id", "category", "confidence", "status")


@query(f"SELECT cell, count(*) AS n FROM (SELECT {SQL_CELL} AS cell FROM {SQL_LAST} v) t GROUP BY cell")
def verdict_cells(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d).groupBy(cell(F.col("status"), F.col("category"), F.col("old_category")).alias("cell")).agg(F.count("*").alias("n"))


@query(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE u) AS usable, count(*) FILTER (WHERE k) AS kept, round(1.0 * count(*) FILTER (WHERE k) / count(*) FILTER (WHERE u), 6) AS kept_share, round(avg(confidence) FILTER (WHERE k), 4) AS mean_confidence_keep FROM (SELECT *, status = 'ok' AND category IS NOT NULL AS u, coalesce(status = 'ok' AND category = old_category, FALSE) AS k FROM {SQL_LAST} v) t"
)
def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    u = (F.col("status") == "ok") & F.col("category").isNotNull()
    k = F.coalesce((F.col("status") == "ok") & (F.col("category") == F.col("old_category")), F.lit(False))
    return latest(spark, d).agg(F.count("*").alias("total"), F.count_if(u).alias("usable"), F.count_if(k).alias("kept"), F.round(F.try_divide(F.count_if(k), F.count_if(u)), 6).alias("kept_share"), F.round(F.avg(F.when(k, F.col("confidence"))), 4).alias("mean_confidence_keep"))


@query(f"SELECT coalesce(substance_type, '') AS substance, count(*) AS n FROM {SQL_LAST} v WHERE status = 'ok' AND category = old_category GROUP BY 1")
def substance_of_kept(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d).where("status = 'ok' and category = old_category").groupBy(F.coalesce("substance_type", F.lit("")).alias("substance")).agg(F.count("*").alias("n"))


SQL_ACTION = (
    f"(SELECT t.doc_id, t.category AS old, v.category AS new, CASE WHEN v.dom IS NULL THEN 'no_verdict' WHEN v.status IS DISTINCT FROM 'ok' OR v.category IS NULL THEN concat('skipped:', coalesce(v.status, '')) WHEN coalesce(v.confidence, 0) < {FLOOR} THEN 'skipped:low_confidence' WHEN v.category = t.category THEN 'kept' ELSE 'moved' END AS action FROM documents t LEFT JOIN {SQL_LAST} v ON t.domain = v.dom)"
)


def actions(spark: SparkSession, d: str) -> DataFrame:
    v = latest(spark, d).select("dom", F.col("category").alias("new"), "status", "confidence")
    t = table(spark, d, "documents").select("doc_id", "domain", F.col("category").alias("old")).join(v, F.col("domain") == F.col("dom"), "left")
    action = (
        F.when(F.col("dom").isNull(), "no_verdict")
        .when(~F.col("status").eqNullSafe("ok") | F.col("new").isNull(), F.concat(F.lit("skipped:"), F.coalesce("status", F.lit(""))))
        .when(F.coalesce("confidence", F.lit(0.0)) < FLOOR, "skipped:low_confidence")
        .when(F.col("new") == F.col("old"), "kept")
        .otherwise("moved")
    )
    return t.select("doc_id", "old", "new", action.alias("action"))


@query(f"SELECT action, old, CASE WHEN action = 'moved' THEN new END AS new, count(*) AS n FROM {SQL_ACTION} a GROUP BY 1, 2, 3")
def verdict_moves(spark: SparkSession, d: str) -> DataFrame:
    return actions(spark, d).groupBy("action", "old", F.when(F.col("action") == "moved", F.col("new")).alias("new")).agg(F.count("*").alias("n"))


def _apply(mode: str, keeps: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        moved = F.col("action") == "moved"
        return actions(spark, d).where(~moved | F.expr(keeps)).select("doc_id", F.when(moved, F.col("new")).otherwise(F.col("old")).alias("category"))

    run.__name__ = f"verdict_apply_{mode}"
    query(f"SELECT doc_id, CASE WHEN action = 'moved' THEN new ELSE old END AS category FROM {SQL_ACTION} a WHERE action <> 'moved' OR {keeps}")(run)


_apply("drop", "FALSE")
_apply("status_only", f"new IN {sql_list(STATUS)}")
_apply("correct", "TRUE")


SQL_GOLD = f"(SELECT {SQL_CELL} AS cell, v.category = g.expected AS new_hit, coalesce(v.old_category = g.expected, FALSE) AS old_hit FROM {SQL_LAST} v JOIN (SELECT lower(domain) AS dom, expected FROM gold_labels) g ON v.dom = g.dom WHERE v.status = 'ok' AND v.category IS NOT NULL)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_labels").select(F.lower("domain").alias("dom"), "expected")
    x = latest(spark, d).where("status = 'ok' and category is not null").join(g, "dom")
    return x.select(cell(F.col("status"), F.col("category"), F.col("old_category")).alias("cell"), (F.col("category") == F.col("expected")).alias("new_hit"), F.coalesce(F.col("old_category") == F.col("expected"), F.lit(False)).alias("old_hit"))


@query(f"SELECT cell, count(*) AS n, count(*) FILTER (WHERE new_hit) AS new_hits, count(*) FILTER (WHERE old_hit) AS old_hits FROM {SQL_GOLD} t GROUP BY cell")
def verdict_vs_gold(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).groupBy("cell").agg(F.count("*").alias("n"), F.count_if("new_hit").alias("new_hits"), F.count_if("old_hit").alias("old_hits"))


@query(
    f"SELECT round(sum(w * new_rate) / sum(w), 6) AS new_agreement, round(sum(w * old_rate) / sum(w), 6) AS old_agreement, sum(n) AS adjudicated FROM (SELECT cell, count(*) AS n, avg(CASE WHEN new_hit THEN 1.0 ELSE 0.0 END) AS new_rate, avg(CASE WHEN old_hit THEN 1.0 ELSE 0.0 END) AS old_rate FROM {SQL_GOLD} t GROUP BY cell) a JOIN (SELECT cell, count(*) AS w FROM (SELECT {SQL_CELL} AS cell FROM {SQL_LAST} v) b GROUP BY cell) c USING (cell)"
)
def adjudication_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Agreement per cell, weighted by the cells' sizes in the population."""
    a = _gold(spark, d).groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.col("new_hit").cast("double")).alias("a"), F.avg(F.col("old_hit").cast("double")).alias("b"))
    w = latest(spark, d).groupBy(cell(F.col("status"), F.col("category"), F.col("old_category")).alias("cell")).agg(F.count("*").alias("w"))
    j = a.join(w, "cell")
    return j.agg(F.round(F.sum(F.col("w") * F.col("a")) / F.sum("w"), 6).alias("new_agreement"), F.round(F.sum(F.col("w") * F.col("b")) / F.sum("w"), 6).alias("old_agreement"), F.sum("n").alias("adjudicated"))


@query(f"SELECT DISTINCT domain FROM fetch_results f WHERE success AND NOT EXISTS (SELECT 1 FROM {SQL_LAST} v WHERE v.dom = f.domain) AND domain IS NOT NULL")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    done = latest(spark, d).select(F.col("dom").alias("domain"))
    return table(spark, d, "fetch_results").where("success and domain is not null").select("domain").distinct().join(done, "domain", "left_anti")


@query(f"SELECT verdict_id, before < {round(BUDGET / COST)} AS asked FROM (SELECT verdict_id, row_number() OVER (ORDER BY verdict_id) - 1 AS before FROM verdicts) t")
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Rows asked before the running cost reaches the budget (in units of cost)."""
    x = ranking.running(table(spark, d, "verdicts").select("verdict_id"), [], "verdict_id", F.lit(1), "before")
    return x.select("verdict_id", (F.col("before") < round(BUDGET / COST)).alias("asked"))


@query(
    "SELECT v.verdict_id, CASE WHEN f.domain IS NULL THEN 'invented' WHEN v.status = 'ok' AND v.category IS NULL THEN 'abstain' WHEN v.category IS NOT NULL AND v.category NOT IN " + sql_list(K.CLASSES) + " AND v.category NOT IN ('recreation') THEN 'invalid_label' ELSE v.status END AS verdict FROM verdicts v LEFT JOIN (SELECT DISTINCT domain FROM fetch_results) f ON lower(trim(v.domain)) = f.domain"
)
def verdict_match(spark: SparkSession, d: str) -> DataFrame:
    """Answers matched to asked domains; invented domains and labels are named."""
    asked = table(spark, d, "fetch_results").select(F.col("domain").alias("asked")).where("asked is not null").distinct()
    v = table(spark, d, "verdicts").join(asked, F.lower(F.trim("domain")) == F.col("asked"), "left")
    c = F.col("category")
    return v.select("verdict_id", F.when(F.col("asked").isNull(), "invented").when((F.col("status") == "ok") & c.isNull(), "abstain").when(c.isNotNull() & ~c.isin(*K.CLASSES, "recreation"), "invalid_label").otherwise(F.col("status")).alias("verdict"))


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch, doc_id, concat(((row_number() OVER (ORDER BY doc_id) - 1) % 10) + 1, '. Domain: ', coalesce(domain, 'unknown'), chr(10), '   Content: ', CASE WHEN length(text) > 2000 THEN concat(left(text, 2000), '... [truncated]') ELSE coalesce(text, '') END) AS entry FROM documents")
def prompt_entries(spark: SparkSession, d: str) -> DataFrame:
    """Numbered entries of batch prompts, ten to a batch."""
    x = ranking.positions(table(spark, d, "documents").select("doc_id", "domain", "text"), "doc_id")
    n = F.expr("(pos - 1) % 10 + 1").cast("string")
    return x.select(F.expr("(pos - 1) div 10").alias("batch"), "doc_id", F.concat(n, F.lit(". Domain: "), F.coalesce("domain", F.lit("unknown")), F.lit("\n   Content: "), F.coalesce(text.truncated(F.col("text"), 2000), F.lit(""))).alias("entry"))


@query("SELECT model, prompt_hash, count(*) AS requests, count(*) FILTER (WHERE truncated) AS truncated, round(avg(confidence), 6) AS mean_confidence FROM verdicts GROUP BY model, prompt_hash")
def usage_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verdicts").groupBy("model", "prompt_hash").agg(F.count("*").alias("requests"), F.count_if("truncated").alias("truncated"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def reply_of() -> Column:
    """A reply in one of the shapes models give, made from a verdict."""
    obj = F.to_json(F.struct(F.col("domain"), F.coalesce("category", F.lit("unclear")).alias("category"), "confidence", "reasoning"))
    k = F.col("verdict_id") % 5
    return F.when(k == 0, obj).when(k == 1, F.concat(F.lit("Sure.\n```json\n["), obj, F.lit("]\n```"))).when(k == 2, F.concat(F.lit("Category: "), F.coalesce("category", F.lit("news")), F.lit(", confidence: 0.8"))).when(k == 3, F.concat(F.lit("["), obj, F.lit(","), obj, F.lit("]"))).otherwise(F.concat(F.lit("I think "), obj, F.lit(" fits.")))


@query()
def llm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Classifications salvaged from replies in JSON, fenced JSON and prose."""
    x = table(spark, d, "verdicts").select("verdict_id", reply_of().alias("reply"))
    return replies.parsed(x, "verdict_id", "reply", list(K.CLASSES))


@query()
def llm_parse_single(spark: SparkSession, d: str) -> DataFrame:
    """The same for replies to one request: a list gives its first item."""
    x = table(spark, d, "verdicts").select("verdict_id", reply_of().alias("reply"))
    return replies.parsed(x, "verdict_id", "reply", list(K.CLASSES), single=True).drop("item")

