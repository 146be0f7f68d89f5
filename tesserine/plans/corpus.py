"""Corpus building: labels, duplicates, floors, caps, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import maths, rules, taxonomy, text, url
from ..operators import ranking
from .base import q, query, sql_list, sql_lookup, table
from .scalars import SQL_PARKED, SQL_TRIGGERED, SQL_UNAVAILABLE, W, sql_tokens, triggered

RAW = ("recreation/sports", "finance/banking", "finance/realestate", "porn", "sex/education", "sex/lingerie", "hobby/games-online", "hobby/gardening", "hobby", "webradio", "spyware", "aggressive", "chat", "models", "warez", "adv/x", "news")
FLOOR, CAP, PER_CLASS, TOP = 20, 15, 5, 10


def sql_map(c: str) -> str:
    parent = f"split_part({c}, '/', 1)"
    return (
        f"coalesce({sql_lookup(c, K.MERGED_PATHS)}, {sql_lookup(c, K.PROMOTED)}, CASE WHEN {parent} IN {sql_list(K.EXCLUDED + K.DROPPED)} THEN NULL WHEN {parent} IN {sql_list([a for a, _ in K.MERGED])} THEN {sql_lookup(parent, K.MERGED)} "
        f"WHEN {parent} IN {sql_list(K.SPLIT_PARENTS)} THEN nullif(regexp_extract({c}, '^[^/]*/(.*)$', 1), '') ELSE {parent} END)"
    )


SQL_SPLIT = "CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END"
SQL_HASH = "(('0x' || substr(sha256(lower(trim(domain))), 1, 8))::BIGINT % 100)"
SQL_D = "lower(trim(domain))"


@query(f"SELECT raw, {sql_map('raw')} AS label FROM (SELECT DISTINCT raw_label AS raw FROM verdicts WHERE raw_label IS NOT NULL UNION SELECT * FROM (VALUES " + ", ".join(f"({q(r)})" for r in RAW) + ") v(raw)) t")
def taxonomy_map(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "verdicts").where("raw_label is not null").select(F.col("raw_label").alias("raw")).union(spark.createDataFrame([(r,) for r in RAW], "raw string")).distinct()
    return x.select("raw", taxonomy.map_category(F.col("raw")).alias("label"))


@query("SELECT category, directory, count(*) AS n FROM (SELECT category, " + sql_lookup("category", K.DIRECTORY) + " AS directory FROM documents WHERE category IS NOT NULL) t GROUP BY category, directory")
def directory_map(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("category is not null").select("category", taxonomy.lookup(F.col("category"), K.DIRECTORY).alias("directory"))
    return x.groupBy("category", "directory").agg(F.count("*").alias("n"))


def _owners(spark: SparkSession, d: str, label):
    v = table(spark, d, "verdicts").where("domain is not null and raw_label is not null").select(F.lower(F.trim("domain")).alias("domain"), label(F.col("raw_label")).alias("label")).where("label is not null")
    return v.groupBy("domain").agg(F.min("label").alias("label"), F.max("label").alias("hi")).where("label = hi").select("domain", "label")


def _owner_sql(expr: str) -> str:
    return f"(SELECT domain, min(label) AS label FROM (SELECT {SQL_D} AS domain, {expr} AS label FROM verdicts WHERE domain IS NOT NULL AND raw_label IS NOT NULL) a WHERE label IS NOT NULL GROUP BY domain HAVING count(DISTINCT label) = 1)"


@query(f"SELECT doc_id, o.label FROM documents t JOIN {_owner_sql('raw_label')} o ON t.domain = o.domain")
def label_join_unique_owner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "domain").join(_owners(spark, d, lambda c: c), "domain").select("doc_id", "label")


@query(f"SELECT doc_id, o.label FROM documents t JOIN {_owner_sql(sql_map('lower(raw_label)'))} o ON t.domain = o.domain")
def label_join_post_map(spark: SparkSession, d: str) -> DataFrame:
    """Labels are mapped before a domain's owners are counted."""
    return table(spark, d, "documents").select("doc_id", "domain").join(_owners(spark, d, lambda c: taxonomy.map_category(F.lower(c))), "domain").select("doc_id", "label")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE text <> '' GROUP BY text HAVING count(*) = 1)")
def drop_duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur once; all copies of any other go.  Grouped by a digest, so
    copies combine before the shuffle and no text travels."""
    x = table(spark, d, "documents").where("text <> ''").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return x.where("n = 1").select("doc_id")


@query(f"SELECT doc_id, category FROM documents WHERE category IN (SELECT category FROM documents WHERE split = 'train' GROUP BY category HAVING count(*) >= {FLOOR})")
def min_docs_floor_train(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "category", "split")
    big = x.where("split = 'train'").groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= FLOOR).select("category")
    return x.join(big, "category", "left_semi").select("doc_id", "category")


@query(f"SELECT doc_id, category FROM documents WHERE category IN (SELECT category FROM documents GROUP BY category HAVING count(*) >= {FLOOR})")
def min_docs_floor(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "category")
    big = x.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= FLOOR).select("category")
    return x.join(big, "category", "left_semi").select("doc_id", "category")


@query(f"SELECT domain, {SQL_SPLIT} AS split FROM (SELECT DISTINCT domain, {SQL_HASH} AS h FROM fetch_results WHERE domain IS NOT NULL) t")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").where("domain is not null").select("domain").distinct().withColumn("split", maths.hash_split(F.col("domain")))


@query(f"SELECT split, {SQL_SPLIT} AS hashed, count(*) AS n FROM (SELECT split, {SQL_HASH} AS h FROM documents WHERE domain IS NOT NULL) t GROUP BY ALL")
def split_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Given splits against hashed ones, counted."""
    return table(spark, d, "documents").where("domain is not null").groupBy("split", maths.hash_split(F.col("domain")).alias("hashed")).agg(F.count("*").alias("n"))


SQL_FINAL = f"(SELECT doc_id, coalesce(category, '') AS category, {sql_tokens('x')} >= {K.CORPUS_MIN_TOKENS} AS passes, CASE WHEN {SQL_PARKED} THEN 'parked' WHEN {SQL_UNAVAILABLE} THEN 'unavailable' ELSE coalesce(category, '') END AS label FROM {SQL_TRIGGERED})"


def relabelled(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    label = F.when(rules.parked(x), "parked").when(rules.unavailable(x), "unavailable").otherwise(F.coalesce("category", F.lit("")))
    return triggered(spark, d).select("doc_id", F.coalesce("category", F.lit("")).alias("category"), (text.tokens(x) >= K.CORPUS_MIN_TOKENS).alias("passes"), label.alias("label"))


@query(f"SELECT label, count(*) AS n, count(*) FILTER (WHERE label <> category) AS moved, count(*) FILTER (WHERE NOT passes) AS refused FROM {SQL_FINAL} t GROUP BY label")
def corpus_counters(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("category")).alias("moved"), F.count_if(~F.col("passes")).alias("refused"))


SQL_CAPPED = (
    f"(SELECT *, coalesce(sum(CASE WHEN passes AND label = category THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {SQL_FINAL} t)"
)


@query(
    f"WITH f AS {SQL_CAPPED}, k AS (SELECT * FROM f WHERE category NOT IN ('parked', 'unavailable') AND passes AND before < {CAP}) SELECT doc_id, category, label FROM k UNION ALL SELECT doc_id, category, label FROM f WHERE category IN ('parked', 'unavailable') "
    f"AND passes AND before + (SELECT count(*) FROM k WHERE k.label = f.category AND k.doc_id < f.doc_id) < {CAP}"
)
def per_class_cap(spark: SparkSession, d: str) -> DataFrame:
    """A row stays while fewer than the cap of its first category were kept before
    it under that name; rows relabelled to a placeholder class fill that class."""
    names = ("parked", "unavailable")
    rows = relabelled(spark, d).where("passes")
    plain = ranking.running(rows.where(~F.col("category").isin(*names)), ["category"], "doc_id", (F.col("label") == F.col("category")).cast("int"), "before")
    kept = plain.where(F.col("before") < CAP).select("doc_id", "category", "label")
    own = rows.where(F.col("category").isin(*names)).select("doc_id", "category", "label", F.lit(True).alias("own"))
    into = kept.where(F.col("label").isin(*names)).select("doc_id", F.col("label").alias("category"), "label", F.lit(False).alias("own"))
    fill = ranking.running(own.unionByName(into), ["category"], "doc_id", (F.col("label") == F.col("category")).cast("int"), "before")
    return kept.unionByName(fill.where(F.col("own") & (F.col("before") < CAP)).select("doc_id", "category", "label"))


@query(f"SELECT category, doc_id FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY sha256(concat('42:', doc_id)), doc_id) AS r FROM documents WHERE category IS NOT NULL) t WHERE r <= {PER_CLASS}")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of equal size per class: the least digests."""
    w = Window.partitionBy("category").orderBy(F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256), "doc_id")
    return table(spark, d, "documents").where("category is not null").select("category", "doc_id", F.row_number().over(w).alias("r")).where(F.col("r") <= PER_CLASS).select("category", "doc_id")


@query(
    f"SELECT category, word, n, r FROM (SELECT category, word, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS r FROM (SELECT category, word, count(*) AS n FROM (SELECT category, unnest(string_split(lower(trim(regexp_replace(text, {q(W + '+')}, ' ', 'g'))), ' ')) AS word FROM documents WHERE category IS NOT NULL) a WHERE word <> '' GROUP BY category, word) b) c WHERE r <= {TOP}"
)
def class_vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("category is not null").select("category", F.explode(F.split(text.clean(F.col("text")), " ")).alias("word")).where("word <> ''")
    n = x.groupBy("category", "word").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "word"))).where(F.col("r") <= TOP)


SQL_NAMES = f"coalesce(category, '') NOT IN {sql_list(K.DROPPED)}"


@query(
    f"WITH f AS (SELECT b.doc_id, b.domain, b.x, f.label FROM {SQL_TRIGGERED} JOIN {SQL_FINAL} f ON b.doc_id = f.doc_id WHERE f.passes AND f.label <> '' AND b.domain IS NOT NULL AND {SQL_NAMES.replace('category', 'b.category')}), "
    "u AS (SELECT * FROM f WHERE x IN (SELECT x FROM f GROUP BY x HAVING count(*) = 1)), "
    f"k AS (SELECT *, {SQL_HASH} AS h FROM u WHERE label IN (SELECT label FROM u GROUP BY label HAVING count(*) >= {FLOOR})) "
    f"SELECT doc_id, label, {SQL_SPLIT} AS split, concat_ws(' ', regexp_replace(domain, '\\.[^.]*$', ''), lower(trim(regexp_replace(x, {q(W + '+')}, ' ', 'g')))) AS text FROM k"
)
def prepare_corpus(spark: SparkSession, d: str) -> DataFrame:
    """End to end: dropped names, relabel, filter, drop all duplicates, floor, split,
    model input.  Duplicates and floors are decided on digests; texts are joined
    with what is left of them once."""
    c, x = F.coalesce("category", F.lit("")), F.col("x")
    label = F.when(rules.parked(x), "parked").when(rules.unavailable(x), "unavailable").otherwise(c)
    rows = triggered(spark, d).where(~c.isin(*K.DROPPED) & F.col("domain").isNotNull() & (text.tokens(x) >= K.CORPUS_MIN_TOKENS))
    rows = rows.select("doc_id", "domain", "x", label.alias("label"), F.sha2("x", 256).alias("h")).where("label <> ''")
    once = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("label").alias("label")).where("n = 1").select("doc_id", "label")
    big = once.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= FLOOR).select("label")
    k = rows.join(once.join(big, "label", "left_semi").select("doc_id"), "doc_id", "left_semi")
    return k.select("doc_id", "label", maths.hash_split(F.col("domain")).alias("split"), F.concat_ws(" ", url.stem(F.col("domain")), text.clean(x)).alias("text"))


@query("SELECT source, count(*) AS docs, sum(n_chars) AS chars, count(DISTINCT domain) AS domains FROM documents GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("domain").alias("domains"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch FROM documents")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return ranking.positions(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.expr("(pos - 1) div 10").alias("batch"))


@query("SELECT DISTINCT domain FROM fetch_results WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM documents WHERE split = 'train' AND domain IS NOT NULL)")
def outside_training(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "documents").where("split = 'train'").select("domain").distinct()
    return table(spark, d, "fetch_results").select("domain").where("domain is not null").distinct().join(train, "domain", "left_anti")
