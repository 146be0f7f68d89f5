"""Distributions over labels, and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import maths
from ..operators import metrics
from .base import q, query, sql_list, table

N = 10
LABELS = tuple(K.CLASSES[:N])
RAW = ("porn", "sex", "models", "news", "webradio", "radiotv", "hobby/gardening", "hobby/games-online", "adv", "shopping")
WEIGHTS = [0.9, 0.5, 0.7, 1.0, 0.3, 0.6, 0.8, 0.4, 0.2, 0.95]
_ARR = lambda a, lo: f"[CAST(x AS DOUBLE) FOR x IN {a}[{lo + 1}:{lo + N}]]".replace(" FOR ", " for ").replace(" IN ", " in ")
SQL_L = f"(SELECT vec_id, label, {_ARR('embedding', 0)} AS a, {_ARR('embedding', N)} AS b FROM embeddings)"


def _soft(c: str, t: float = 1.0) -> str:
    e = f"[exp((x - list_max({c})) / {t}) for x in {c}]"
    return f"[y / list_sum({e}) for y in {e}]"


SQL_P = f"(SELECT vec_id, label, {_soft('a')} AS p, {_soft('b')} AS i FROM {SQL_L} l)"


def logits(spark: SparkSession, d: str) -> DataFrame:
    part = lambda lo: F.transform(F.slice("embedding", lo + 1, N), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", part(0).alias("a"), part(N).alias("b"))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    return logits(spark, d).select("vec_id", "label", maths.softmax(F.col("a")).alias("p"), maths.softmax(F.col("b")).alias("i"))


def _r(c, n: int = 6):
    return F.transform(c, lambda x: F.round(x, n))


def _rs(c: str, n: int = 6) -> str:
    return f"[round(z, {n}) for z in {c}]"


@query(f"SELECT vec_id, {_rs('t')} AS p FROM (SELECT vec_id, {_soft('a', 1.8)} AS t FROM {SQL_L} l) m")
def softmax_temperature(spark: SparkSession, d: str) -> DataFrame:
    return logits(spark, d).select("vec_id", _r(maths.softmax(F.col("a"), 1.8)).alias("p"))


@query(f"SELECT vec_id, list_position(p, list_max(p)) AS pos, round(list_max(p), 6) AS confidence FROM {SQL_P} x")
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    return probabilities(spark, d).select("vec_id", maths.argmax(F.col("p")).cast("int").alias("pos"), F.round(F.array_max("p"), 6).alias("confidence"))


@query(
    f"SELECT vec_id, label, rank, round(v, 6) AS probability FROM (SELECT vec_id, {sql_list(LABELS).replace('(', '[').replace(')', ']')}[k] AS label, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS rank FROM (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) AS k FROM {SQL_P} x) y) z WHERE v >= {K.LABEL_FLOOR} OR rank = 1"
)
def top_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels at or above the floor, largest first; the largest if none is."""
    labels = F.array(*[F.lit(x) for x in LABELS])
    pairs = F.transform(F.arrays_zip(F.col("p").alias("p"), labels.alias("l")), lambda z, k: F.struct((-z["p"]).alias("o"), k.alias("k"), z["l"].alias("label"), z["p"].alias("p")))
    x = probabilities(spark, d).select("vec_id", F.array_sort(pairs).alias("s")).select("vec_id", F.posexplode("s").alias("i", "s"))
    return x.where((F.col("s.p") >= K.LABEL_FLOOR) | (F.col("i") == 0)).select("vec_id", "s.label", (F.col("i") + 1).alias("rank"), F.round("s.p", 6).alias("probability"))


def _project_sql() -> str:
    from ..functions.taxonomy import project_labels as project

    names, groups = project(list(RAW))
    mass = "[" + ", ".join("(" + " + ".join(f"p[{i + 1}]" for i in g) + ")" for g in groups) + "]"
    return f"SELECT vec_id, {_rs('[g / list_sum(m) for g in m]')} AS p, {len(names)} AS k FROM (SELECT vec_id, {mass} AS m FROM {SQL_P} x) y"


@query(_project_sql())
def project_labels(spark: SparkSession, d: str) -> DataFrame:
    """Merged labels' mass summed and renormalised; left-out labels drop."""
    from ..functions.taxonomy import project_labels as project

    names, groups = project(list(RAW))
    return probabilities(spark, d).select("vec_id", _r(maths.grouped(F.col("p"), groups)).alias("p"), F.lit(len(names)).alias("k"))


TARGET = ("zoo", *LABELS[::-1], "annex")


@query(f"SELECT vec_id, {_rs('[' + ', '.join(f'p[{LABELS.index(t) + 1}]' if t in LABELS else '0.0::DOUBLE' for t in TARGET) + ']')} AS p FROM {SQL_P} x")
def widen_distribution(spark: SparkSession, d: str) -> DataFrame:
    """A distribution in a larger label space, zeros where it has no label."""
    return probabilities(spark, d).select("vec_id", _r(F.array(*[F.get("p", F.lit(LABELS.index(t))) if t in LABELS else F.lit(0.0) for t in TARGET])).alias("p"))


@query(f"SELECT vec_id, {_rs('[z / list_sum(m) for z in m]').replace('for z in [', 'for y in [', 1).replace('round(z', 'round(y', 1)} AS p FROM (SELECT vec_id, [0.4 * p[k] + 0.6 * i[k] for k in range(1, {N + 1})] AS m FROM {SQL_P} x) y")
def fuse_scalar(spark: SparkSession, d: str) -> DataFrame:
    return probabilities(spark, d).select("vec_id", _r(maths.fused(F.col("p"), F.col("i"), 0.4)).alias("p"))


@query(f"SELECT vec_id, [round(v / list_sum(m), 6) for v in m] AS p FROM (SELECT vec_id, [{WEIGHTS}[k] * p[k] + (1 - {WEIGHTS}[k]) * i[k] for k in range(1, {N + 1})] AS m FROM {SQL_P} x) y")
def fuse_per_class(spark: SparkSession, d: str) -> DataFrame:
    return probabilities(spark, d).select("vec_id", _r(maths.fused(F.col("p"), F.col("i"), WEIGHTS)).alias("p"))


@query(
    f"SELECT x.vec_id, CASE WHEN y.i IS NULL THEN 'text' ELSE 'text+image' END AS modalities, CASE WHEN y.i IS NULL THEN list_position(x.p, list_max(x.p)) ELSE list_position(m, list_max(m)) END AS pos FROM {SQL_P} x LEFT JOIN (SELECT vec_id, i, [0.4 * p[k] + 0.6 * i[k] for k in range(1, {N + 1})] AS m FROM {SQL_P} z WHERE label <> 3) y ON x.vec_id = y.vec_id"
)
def combine_modalities(spark: SparkSession, d: str) -> DataFrame:
    """Text rows left-joined with image rows; blended where there is an image."""
    x = probabilities(spark, d)
    image = x.where("label <> 3").select("vec_id", "i")
    m = x.select("vec_id", "p").join(image, "vec_id", "left")
    p = F.when(F.col("i").isNull(), F.col("p")).otherwise(maths.fused(F.col("p"), F.col("i"), 0.4))
    return m.select("vec_id", F.when(F.col("i").isNull(), "text").otherwise("text+image").alias("modalities"), maths.argmax(p).cast("int").alias("pos"))


@query(
    f"SELECT vec_id, round(list_max(p), 6) AS text_max, round(list_max(i), 6) AS image_max, round(list_sum([-v * ln(v + 1e-12) for v in p]), 6) AS text_entropy, round(list_sum([-v * ln(v + 1e-12) for v in i]), 6) AS image_entropy, list_position(p, list_max(p)) = list_position(i, list_max(i)) AS agree FROM {SQL_P} x"
)
def stack_features(spark: SparkSession, d: str) -> DataFrame:
    p, i = F.col("p"), F.col("i")
    return probabilities(spark, d).select(
        "vec_id", F.round(F.array_max(p), 6).alias("text_max"), F.round(F.array_max(i), 6).alias("image_max"), F.round(maths.entropy(p), 6).alias("text_entropy"), F.round(maths.entropy(i), 6).alias("image_entropy"),
        (maths.argmax(p) == maths.argmax(i)).alias("agree"),
    )


# -- metrics ----------------------------------------------------------------------
SQL_PRED = f"(SELECT vec_id, CAST(label AS VARCHAR) AS t, CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) AS p, list_max(p) AS c, CAST(list_position(i, list_max(i)) - 1 AS VARCHAR) AS p2 FROM {SQL_P} x)"
SQL_COUNTS = (
    f"(SELECT c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp) + sum(fn) AS support FROM (SELECT t AS c, CASE WHEN t = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN 1 ELSE 0 END AS fn FROM {SQL_PRED} a UNION ALL SELECT p, 0, 1, 0 FROM {SQL_PRED} b WHERE t <> p) u GROUP BY c)"
)
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    x = probabilities(spark, d)
    name = lambda c: (maths.argmax(F.col(c)) - 1).cast("string")
    return x.select("vec_id", F.col("label").cast("string").alias("t"), name("p").alias("p"), F.array_max("p").alias("c"), name("i").alias("p2"))


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(c), 6) AS mean_confidence, (SELECT round(avg({_F1}), 6) FROM {SQL_COUNTS} k WHERE support > 0) AS macro_f1 FROM {SQL_PRED} x")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    macro = metrics.per_class(p).where("support > 0").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return p.agg(F.count("*").alias("n"), F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 6).alias("accuracy"), F.round(F.avg("c"), 6).alias("mean_confidence")).join(F.broadcast(macro))


@query(f"SELECT c AS class, support, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE 1.0 * tp / (tp + fp) END, 6) AS precision, round(CASE WHEN support = 0 THEN 0.0 ELSE 1.0 * tp / support END, 6) AS recall, round({_F1}, 6) AS f1 FROM {SQL_COUNTS} k")
def per_class_report(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.per_class(predictions(spark, d))
    return m.select(F.col("class"), "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT round(sum(n * abs(a - m)) / sum(n), 6) AS ece FROM (SELECT greatest(1, ceil(c * 10)) AS b, count(*) AS n, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS a, avg(c) AS m FROM {SQL_PRED} x GROUP BY b) y")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(predictions(spark, d)).select(F.round("ece", 6).alias("ece"))


@query(f"SELECT t, p, n, round(1.0 * n / s, 6) AS share_of_gold FROM (SELECT t, p, count(*) AS n FROM {SQL_PRED} x WHERE t <> p GROUP BY t, p) a JOIN (SELECT t AS g, count(*) AS s FROM {SQL_PRED} y GROUP BY t) b ON a.t = b.g ORDER BY n DESC, t, p LIMIT 25")
def confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    s = p.groupBy("t").agg(F.count("*").alias("s"))
    return p.where("t <> p").groupBy("t", "p").agg(F.count("*").alias("n")).join(s, "t").select("t", "p", "n", F.round(F.col("n") / F.col("s"), 6).alias("share_of_gold")).orderBy(F.desc("n"), "t", "p").limit(25)


@query(f"SELECT least(t, p) AS a, greatest(t, p) AS b, count(*) AS n, count(*) FILTER (WHERE t < p) AS a_to_b, count(*) FILTER (WHERE t > p) AS b_to_a FROM {SQL_PRED} x WHERE t <> p GROUP BY 1, 2")
def conflated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("t <> p").groupBy(F.least("t", "p").alias("a"), F.greatest("t", "p").alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("t") < F.col("p")).alias("a_to_b"), F.count_if(F.col("t") > F.col("p")).alias("b_to_a"))


MERGES = (("base", "", ""), ("01", "1", "0"), ("23", "3", "2"), ("45", "5", "4"))


@query(
    f"SELECT s.name AS scenario, round(avg(CASE WHEN (CASE WHEN t = s.a THEN s.b ELSE t END) = (CASE WHEN p = s.a THEN s.b ELSE p END) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {SQL_PRED} x, (VALUES " + ", ".join(f"({q(n)}, {q(a)}, {q(b)})" for n, a, b in MERGES) + ") s(name, a, b) GROUP BY s.name"
)
def merge_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy if labels were merged, per scenario (scenarios are few literals)."""
    to = lambda c, a, b: F.when(F.col(c) == a, b).otherwise(F.col(c))
    hits = [F.struct(F.lit(n).alias("scenario"), (to("t", a, b) == to("p", a, b)).cast("double").alias("hit")) for n, a, b in MERGES]
    return predictions(spark, d).select(F.explode(F.array(*hits)).alias("s")).groupBy("s.scenario").agg(F.round(F.avg("s.hit"), 6).alias("accuracy"))


@query(f"SELECT count(*) FILTER (WHERE p <> t AND p2 = t) AS fixed, count(*) FILTER (WHERE p = t AND p2 <> t) AS broken FROM {SQL_PRED} x")
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p") == F.col("t"), F.col("p2") == F.col("t")
    return predictions(spark, d).agg(F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"))


@query(
    "SELECT t AS class, n, hits, round(greatest(0.0, (p + z2 / (2 * n) - s) / (1 + z2 / n)), 6) AS low, round(least(1.0, (p + z2 / (2 * n) + s) / (1 + z2 / n)), 6) AS high FROM (SELECT *, 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) AS s FROM "
    f"(SELECT t, count(*) AS n, count(*) FILTER (WHERE t = p) AS hits, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS p, 1.96 * 1.96 AS z2 FROM {SQL_PRED} x GROUP BY t) a) b"
)
def agreement_by_class(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).groupBy(F.col("t").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("p")).alias("hits"))
    low, high = maths.wilson(F.col("hits"), F.col("n"))
    return x.select("class", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "SELECT g.domain, g.expected, r.predicted, r.confidence, r.predicted = g.expected AS hit FROM (SELECT lower(domain) AS domain, expected FROM gold_labels) g LEFT JOIN (SELECT domain, arg_max(category, struct_pack(c := confidence, f := fetch_id)) AS predicted, round(max(confidence), 6) AS confidence FROM results WHERE category IS NOT NULL GROUP BY domain) r ON g.domain = r.domain"
)
def gold_join(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels left-joined with the surest result of their domain."""
    g = table(spark, d, "gold_labels").select(F.lower("domain").alias("domain"), "expected")
    r = table(spark, d, "results").where("category is not null").groupBy("domain").agg(F.max_by("category", F.struct("confidence", "fetch_id")).alias("predicted"), F.round(F.max("confidence"), 6).alias("confidence"))
    return g.join(r, "domain", "left").select("domain", "expected", "predicted", "confidence", (F.col("predicted") == F.col("expected")).alias("hit"))


@query()
def fit_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Temperature of least log loss, by one aggregate over a grid."""
    return metrics.fit_temperature(logits(spark, d))


@query()
def fit_fusion_weight(spark: SparkSession, d: str) -> DataFrame:
    """Blend weight of least log loss, by one aggregate over a grid."""
    return metrics.fit_weight(probabilities(spark, d))
