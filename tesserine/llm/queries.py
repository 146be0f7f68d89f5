"""Queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, language, mixing, neardup, packing, residue, spam, spans, splitleak, template, tokens
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(read(spark, d, "fetch_results"), read(spark, d, "lang_samples"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """Languages of every fetched text and description and of every document."""
    samples = read(spark, d, "lang_samples")
    pages = language.labels(read(spark, d, "fetch_results"), samples, "fetch_id", ["text", "meta_description"])
    docs = language.labels(read(spark, d, "documents"), samples, "doc_id", ["text"])
    tag = lambda df, name: df.select(F.lit(name).alias("table"), F.col(df.columns[0]).alias("id"), *df.columns[1:])
    return tag(pages, "fetch_results").unionByName(tag(docs, "documents"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every mixed fetched text and description and of every mixed document."""
    samples = read(spark, d, "lang_samples")
    part = lambda t, key, f: language.segments(read(spark, d, t), samples, key, f).select(F.lit(t).alias("table"), F.col(key).alias("id"), F.lit(f).alias("field"), "segment", "lang", "first_word", "last_word", "confidence")
    return part("fetch_results", "fetch_id", "text").unionByName(part("fetch_results", "fetch_id", "meta_description")).unionByName(part("documents", "doc_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return template.found(read(spark, d, "fetch_results"), read(spark, d, "lang_samples"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return template.bodies(read(spark, d, "fetch_results"), read(spark, d, "lang_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    source = read(spark, d, "fetch_results")
    pages = template.parsed(source, read(spark, d, "lang_samples"))
    return residue.found(pages, template.judged_lines(pages), source)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(read(spark, d, "fetch_results"), read(spark, d, "lang_samples"))


def p3_by_category(spark: SparkSession, d: str) -> DataFrame:
    return spam.by_category(*(read(spark, d, t) for t in ("fetch_results", "verdicts", "lang_samples")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(read(spark, d, "fetch_results")).toDF("fetch_id_a", "fetch_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(read(spark, d, "fetch_results"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(read(spark, d, "fetch_results"), read(spark, d, "lang_samples"))


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(read(spark, d, "fetch_results"), read(spark, d, "lang_samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitleak.pairs(read(spark, d, "fetch_results"), read(spark, d, "verdicts"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return splitleak.report(read(spark, d, "fetch_results"), read(spark, d, "verdicts"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(tokens.token_counts(read(spark, d, "documents")), read(spark, d, "pack_specs"))


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    specs = read(spark, d, "pack_specs")
    return packing.summary(packing.assign(tokens.token_counts(read(spark, d, "documents")), specs), specs)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(tokens.token_counts(read(spark, d, "documents")), read(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(tokens.token_counts(read(spark, d, "documents")), read(spark, d, "mix_targets"))


def p9_shares_kept(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(tokens.token_counts(read(spark, d, "documents")), read(spark, d, "mix_targets"), keep="shares")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.pairs(read(spark, d, "documents")).toDF("doc_id_a", "doc_id_b")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches: maximal intervals of a document that stand in others too."""
    return spans.intervals(read(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts; ``p10_members`` tells which documents have them."""
    docs = read(spark, d, "documents")
    return spans.links(docs, spans.anchors(docs)).toDF("doc_id_a", "doc_id_b")


def p10_members(spark: SparkSession, d: str) -> DataFrame:
    return spans.members(read(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(read(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_labels, p1_segments, p2_found, p2_bodies, p3_found, p3_by_category, p4_found, p5_found, p5_groups, p6_found, p6_restored, p7_found, p7_report, p8_containers, p8_summary, p9_mix, p9_shares, p9_shares_kept, p10_found, p10_spans, p10_links, p10_members, p10_shares)}


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _runs(k: int) -> str:
    return f"unnest(list_distinct([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})])) AS g"


#: The definitions in plain SQL, by all shared runs: right, but not for large tables.
SQL = {
    "p5_found": f"""WITH w AS (SELECT fetch_id, {_WORDS} AS w FROM fetch_results WHERE text <> ''),
g AS (SELECT fetch_id, {_runs(3)} FROM w WHERE len(w) >= 40), c AS (SELECT fetch_id, count(*) AS m FROM g GROUP BY 1)
SELECT a.fetch_id AS fetch_id_a, b.fetch_id AS fetch_id_b FROM g a JOIN g b ON a.g = b.g AND a.fetch_id < b.fetch_id
JOIN c x ON x.fetch_id = a.fetch_id JOIN c y ON y.fetch_id = b.fetch_id
GROUP BY a.fetch_id, b.fetch_id, x.m, y.m HAVING count(*) >= 0.7 * (x.m + y.m - count(*))""",
    "p7_found": f"""WITH s AS (SELECT lower(trim(domain)) AS domain, max(split) AS split FROM verdicts WHERE split IS NOT NULL AND domain IS NOT NULL GROUP BY 1),
w AS (SELECT f.fetch_id, s.split, {_WORDS} AS w FROM fetch_results f JOIN s ON f.domain = s.domain WHERE f.text <> ''),
g AS (SELECT fetch_id, split, len(w) AS n, {_runs(5)} FROM w WHERE len(w) >= 5), c AS (SELECT fetch_id, count(*) AS m FROM g GROUP BY 1)
SELECT least(h.fetch_id, t.fetch_id) AS fetch_id_a, greatest(h.fetch_id, t.fetch_id) AS fetch_id_b
FROM (SELECT * FROM g WHERE split IN ('val', 'test') AND n >= 40) h JOIN (SELECT * FROM g WHERE split = 'train') t ON h.g = t.g
JOIN c ON c.fetch_id = h.fetch_id GROUP BY h.fetch_id, t.fetch_id, c.m HAVING count(*) >= 0.8 * c.m""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS g FROM
(SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200) t),
k AS (SELECT * FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
