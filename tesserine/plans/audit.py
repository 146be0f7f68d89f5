"""Auditing verdicts and predictions: sheets, intervals, what-ifs, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import maths, taxonomy
from ..operators import metrics
from .base import q, query, sql_list, sql_lookup, table
from .corpus import sql_map
from .scalars import SQL_COLLAPSE, W
from .scores import MERGES, SQL_PRED, predictions
from .verdicts import SQL_CELL, SQL_GOLD, SQL_LAST, _gold, cell, latest

PER_CELL, UNMAPPABLE = 3, 8
KEPT_MOVES = ("move:status", "move:shopping")


@query(f"SELECT coalesce(status, '') AS status, count(*) AS n FROM {SQL_LAST} v GROUP BY 1")
def verdict_statuses(spark: SparkSession, d: str) -> DataFrame:
    return latest(spark, d).groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT category AS destination, count(*) AS n FROM {SQL_LAST} v WHERE status = 'ok' AND category IS NOT NULL AND category IS DISTINCT FROM old_category GROUP BY category")
def verdict_destinations(spark: SparkSession, d: str) -> DataFrame:
    """Where usable verdicts move documents to."""
    moved = latest(spark, d).where("status = 'ok' and category is not null and not (category <=> old_category)")
    return moved.groupBy(F.col("category").alias("destination")).agg(F.count("*").alias("n"))


SQL_TAIL = f"(SELECT *, CASE WHEN starts_with(c, 'move:') AND c NOT IN {sql_list(KEPT_MOVES)} THEN 'move:other' ELSE c END AS cell FROM (SELECT *, {SQL_CELL} AS c FROM {SQL_LAST} v) a)"


def _tail(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    x = latest(spark, d).withColumn("c", cell(F.col("status"), F.col("category"), F.col("old_category")))
    return x.withColumn("cell", F.when(F.startswith(c, F.lit("move:")) & ~c.isin(*KEPT_MOVES), "move:other").otherwise(c))


@query(f"SELECT cell, count(*) AS n FROM {SQL_TAIL} t GROUP BY cell")
def verdict_cells_tail(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the tail of single destinations as one."""
    return _tail(spark, d).groupBy("cell").agg(F.count("*").alias("n"))


@query(
    f"SELECT s.cell, s.dom AS domain, left(trim(regexp_replace(x.text, {q(W + '+')}, ' ', 'g')), 400) AS text_excerpt, coalesce(s.category, '') AS llm_label, s.confidence AS llm_confidence, left(s.reasoning, 300) AS llm_reasoning, left(s.evidence, 200) AS evidence "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256(concat('42:', dom)), dom) AS r FROM {SQL_TAIL} t) s LEFT JOIN (SELECT domain, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY domain) x ON x.domain = s.dom WHERE s.r <= {PER_CELL}"
)
def adjudication_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of each cell for a human, the current label withheld."""
    w = Window.partitionBy("cell").orderBy(F.sha2(F.concat(F.lit("42:"), "dom"), 256), "dom")
    s = _tail(spark, d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= PER_CELL)
    t = table(spark, d, "documents").where("text is not null").join(s.select(F.col("dom").alias("domain")), "domain", "left_semi").groupBy("domain").agg(F.min_by("text", "doc_id").alias("text"))
    excerpt = F.left(F.trim(F.regexp_replace("text", f"{W}+", " ")), F.lit(400))
    return s.withColumn("domain", F.col("dom")).join(t, "domain", "left").select(
        "cell", "domain", excerpt.alias("text_excerpt"), F.coalesce("category", F.lit("")).alias("llm_label"), F.col("confidence").alias("llm_confidence"),
        F.left("reasoning", F.lit(300)).alias("llm_reasoning"), F.left("evidence", F.lit(200)).alias("evidence"),
    )


def _sql_wilson(k: str, n: str) -> str:
    z = "(1.96 * 1.96)"
    p = f"(1.0 * {k} / {n})"
    s = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + {z} / (4.0 * {n} * {n})))"
    side = lambda sign: f"({p} + {z} / (2 * {n}) {sign} {s}) / (1 + {z} / {n})"
    return f"round(greatest(0.0, {side('-')}), 6) AS {k}_low, round(least(1.0, {side('+')}), 6) AS {k}_high"


@query(f"SELECT cell, n, {_sql_wilson('new', 'n')}, {_sql_wilson('old', 'n')} FROM (SELECT cell, count(*) AS n, count(*) FILTER (WHERE new_hit) AS new, count(*) FILTER (WHERE old_hit) AS old FROM {SQL_GOLD} t GROUP BY cell) a")
def adjudication_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of new and old labels per cell, as Wilson intervals."""
    x = _gold(spark, d).groupBy("cell").agg(F.count("*").alias("n"), F.count_if("new_hit").alias("new"), F.count_if("old_hit").alias("old"))
    out = []
    for k in ("new", "old"):
        low, high = maths.wilson(F.col(k), F.col("n"))
        out += [F.round(low, 6).alias(f"{k}_low"), F.round(high, 6).alias(f"{k}_high")]
    return x.select("cell", "n", *out)


SCENARIOS = (*((n, ((a, b),) if a else ()) for n, a, b in MERGES), ("all of the above", tuple((a, b) for _, a, b in MERGES if a)))


def _sql_scenarios() -> str:
    to = lambda c, m: "CASE " + " ".join(f"WHEN {c} = {q(a)} THEN {q(b)}" for a, b in m) + f" ELSE {c} END" if m else c
    return " UNION ALL ".join(f"SELECT {q(n)} AS scenario, {to('t', m)} AS t, {to('p', m)} AS p FROM x" for n, m in SCENARIOS)


@query(
    f"WITH x AS {SQL_PRED}, s AS ({_sql_scenarios()}), k AS (SELECT scenario, c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT scenario, t AS c, CASE WHEN t = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN 1 ELSE 0 END AS fn FROM s UNION ALL SELECT scenario, p, 0, 1, 0 FROM s WHERE t <> p) u GROUP BY ALL), "
    "f AS (SELECT scenario, count(*) AS classes, avg(2.0 * tp / (2 * tp + fp + fn)) AS f1 FROM k WHERE tp + fn > 0 GROUP BY scenario), a AS (SELECT scenario, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM s GROUP BY scenario), m AS (SELECT * FROM f JOIN a USING (scenario)) "
    "SELECT scenario, classes, round(accuracy, 6) AS accuracy, round(f1, 6) AS macro_f1, round(accuracy - max(accuracy) FILTER (WHERE scenario = 'base') OVER (), 6) AS accuracy_gain, round(f1 - max(f1) FILTER (WHERE scenario = 'base') OVER (), 6) AS macro_f1_gain FROM m"
)
def merge_report(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and macro-F1 under each merge of labels and all of them together, and
    what they gain; predictions are read once, merged per scenario and counted."""

    def to(c: str, m: tuple) -> Column:
        out = F.col(c)
        for a, b in reversed(m):
            out = F.when(F.col(c) == a, b).otherwise(out)
        return out

    pairs = predictions(spark, d).groupBy("t", "p").agg(F.count("*").alias("n"))
    s = pairs.select("n", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), to("t", m).alias("t"), to("p", m).alias("p")) for n, m in SCENARIOS])).alias("s")).select("n", "s.*")
    hit = F.col("t") == F.col("p")
    acc = s.groupBy("scenario").agg((F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    role = lambda c, tp, fp, fn: F.struct(F.col(c).alias("c"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    each = s.select("scenario", F.explode(F.array(role("t", F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n)), role("p", zero, F.when(hit, zero).otherwise(n), zero))).alias("r")).select("scenario", "r.*")
    k = each.groupBy("scenario", "c").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).where("tp + fn > 0")
    f = k.groupBy("scenario").agg(F.count("*").alias("classes"), F.avg(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))
    m = f.join(acc, "scenario")
    m = m.withColumn("all", F.lit(1)).join(m.where("scenario = 'base'").select(F.lit(1).alias("all"), F.col("accuracy").alias("a0"), F.col("f1").alias("f0")), "all")
    r = lambda c: F.round(c, 6)
    return m.select("scenario", "classes", r(F.col("accuracy")).alias("accuracy"), r(F.col("f1")).alias("macro_f1"), r(F.col("accuracy") - F.col("a0")).alias("accuracy_gain"), r(F.col("f1") - F.col("f0")).alias("macro_f1_gain"))


SQL_DIRECTORY = "(SELECT g.domain, " + sql_lookup("g.expected", K.DIRECTORY) + " AS want, " + sql_lookup("r.predicted", K.DIRECTORY) + " AS got, r.predicted FROM (SELECT lower(domain) AS domain, expected FROM gold_labels) g LEFT JOIN (SELECT domain, arg_max(category, struct_pack(c := confidence, f := fetch_id)) AS predicted FROM results WHERE category IS NOT NULL GROUP BY domain) r ON g.domain = r.domain)"


def _directory(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_labels").select(F.lower("domain").alias("domain"), taxonomy.lookup(F.col("expected"), K.DIRECTORY).alias("want"))
    r = table(spark, d, "results").where("category is not null").groupBy("domain").agg(F.max_by("category", F.struct("confidence", "fetch_id")).alias("predicted"))
    return g.join(r, "domain", "left").select("domain", "want", "predicted", taxonomy.lookup(F.col("predicted"), K.DIRECTORY).alias("got"))


@query(f"SELECT count(*) AS requested, count(*) FILTER (WHERE predicted IS NULL) AS failed, count(*) FILTER (WHERE predicted IS NOT NULL AND got IS NULL) AS unmappable, count(*) FILTER (WHERE got IS NOT NULL) AS scored, count(*) FILTER (WHERE got = want) AS hits FROM {SQL_DIRECTORY} x")
def directory_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Results against gold labels in the directory's coarser categories."""
    p, got = F.col("predicted"), F.col("got")
    return _directory(spark, d).agg(
        F.count("*").alias("requested"), F.count_if(p.isNull()).alias("failed"), F.count_if(p.isNotNull() & got.isNull()).alias("unmappable"), F.count_if(got.isNotNull()).alias("scored"), F.count_if(got == F.col("want")).alias("hits")
    )


@query(f"SELECT want AS directory, count(*) AS scored, round(avg(CASE WHEN got = want THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM {SQL_DIRECTORY} x WHERE got IS NOT NULL AND want IS NOT NULL GROUP BY want")
def directory_by_class(spark: SparkSession, d: str) -> DataFrame:
    x = _directory(spark, d).where("got is not null and want is not null")
    return x.groupBy(F.col("want").alias("directory")).agg(F.count("*").alias("scored"), F.round(F.avg((F.col("got") == F.col("want")).cast("double")), 6).alias("hit_rate"))


@query("SELECT category, count(*) AS n FROM (SELECT category, " + sql_lookup("category", K.DIRECTORY) + f" AS got FROM results WHERE category IS NOT NULL) t WHERE got IS NULL GROUP BY category ORDER BY n DESC, category LIMIT {UNMAPPABLE}")
def unmappable_top(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent result categories the directory has no place for."""
    x = table(spark, d, "results").where("category is not null").where(taxonomy.lookup(F.col("category"), K.DIRECTORY).isNull())
    return x.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(UNMAPPABLE)


_SET = "(SELECT list_sort(list(DISTINCT {c})) FROM {t} WHERE {c} IS NOT NULL)"


@query(
    f"SELECT list_sort([x for x in a if NOT list_contains(b, x)]) AS extra, list_sort([x for x in b if NOT list_contains(a, x)]) AS absent, [x for x in b if list_contains(a, x)] AS common, a = b AS same FROM (SELECT {_SET.format(c='category', t='results')} AS a, {_SET.format(c='expected', t='gold_labels')} AS b) t"
)
def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Vocabularies of results and gold labels: extra, absent, common in target order."""
    a = table(spark, d, "results").agg(F.array_sort(F.collect_set("category")).alias("a"))
    b = table(spark, d, "gold_labels").agg(F.array_sort(F.collect_set("expected")).alias("b"))
    x = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")
    return x.select(F.array_sort(F.array_except("a", "b")).alias("extra"), F.array_sort(F.array_except("b", "a")).alias("absent"), F.array_intersect("b", "a").alias("common"), (F.col("a") == F.col("b")).alias("same"))


@query(f"SELECT list_sort(list(DISTINCT label)) AS targets FROM (SELECT {sql_map('raw_label')} AS label FROM verdicts WHERE raw_label IS NOT NULL) t WHERE label IS NOT NULL")
def target_classes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct training labels of the raw ones, sorted (a vocabulary, not data)."""
    return table(spark, d, "verdicts").where("raw_label is not null").agg(F.array_sort(F.collect_set(taxonomy.map_category(F.col("raw_label")))).alias("targets"))


@query("SELECT DISTINCT raw_label, coalesce(" + sql_lookup("raw_label", K.MERGED_PATHS) + ", " + sql_lookup("raw_label", K.MERGED) + f", CASE WHEN contains(raw_label, '/') AND split_part(raw_label, '/', 1) IN {sql_list(K.SPLIT_PARENTS)} THEN nullif(regexp_extract(raw_label, '^[^/]*/(.*)$', 1), '') END, raw_label) AS label FROM verdicts WHERE raw_label IS NOT NULL")
def legacy_collapse(spark: SparkSession, d: str) -> DataFrame:
    """A label of an older model in today's space, itself where nothing merges it."""
    r = F.col("raw_label")
    split = F.when(F.contains(r, F.lit("/")) & F.split_part(r, F.lit("/"), F.lit(1)).isin(*K.SPLIT_PARENTS), F.nullif(F.regexp_extract(r, "^[^/]*/(.*)$", 1), F.lit("")))
    return table(spark, d, "verdicts").where("raw_label is not null").select("raw_label", F.coalesce(taxonomy.lookup(r, K.MERGED_PATHS), taxonomy.lookup(r, K.MERGED), split, r).alias("label")).distinct()


@query("SELECT vec_id, isfinite(m) AS finite FROM (SELECT vec_id, CASE WHEN e[3] > 0 THEN e[1] WHEN e[2] > 0 THEN 'NaN'::DOUBLE ELSE e[1] * 'Infinity'::DOUBLE END AS m FROM (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings) t) u")
def finite_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whether a metric is a number that can be compared (some are made infinite or
    no number here, which the table lacks)."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    m = F.when(e(3) > 0, e(1)).when(e(2) > 0, F.lit(float("nan"))).otherwise(e(1) * F.lit(float("inf")))
    return table(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", (~F.isnan("m") & (F.abs("m") < F.lit(float("inf")))).alias("finite"))


@query("SELECT verdict_id, CASE WHEN coalesce(category, '') <> '' THEN [category] ELSE [] END AS categories FROM verdicts")
def llm_categories(spark: SparkSession, d: str) -> DataFrame:
    """One judged category as a list, an absent one as none."""
    return table(spark, d, "verdicts").select("verdict_id", F.when(F.coalesce("category", F.lit("")) != "", F.array("category")).otherwise(F.array().cast("array<string>")).alias("categories"))


@query(f"SELECT f.domain, CASE WHEN v.dom IS NULL THEN 'missing' ELSE coalesce(v.status, '') END AS status, v.category FROM (SELECT DISTINCT domain FROM fetch_results WHERE success AND domain IS NOT NULL) f LEFT JOIN {SQL_LAST} v ON v.dom = f.domain")
def verdict_or_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every asked domain with its last verdict, 'missing' where none answered."""
    asked = table(spark, d, "fetch_results").where("success and domain is not null").select("domain").distinct()
    x = asked.join(latest(spark, d).select("dom", "status", "category"), F.col("domain") == F.col("dom"), "left")
    return x.select("domain", F.when(F.col("dom").isNull(), "missing").otherwise(F.coalesce("status", F.lit(""))).alias("status"), "category")
