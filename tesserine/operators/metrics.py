"""Metrics of predictions (columns t: truth, p: prediction, c: confidence)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 60


def per_class(x: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support over the union of labels: one pass, every
    row giving its truth and its prediction."""
    hit = F.col("t") == F.col("p")
    each = x.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("class"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"), (~hit).cast("int").alias("fn")),
                F.struct(F.col("p").alias("class"), F.lit(0).alias("tp"), (~hit).cast("int").alias("fp"), F.lit(0).alias("fn")),
            )
        ).alias("s")
    )
    g = each.groupBy("s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("class", "tp", "fp", "fn", (tp + fn).alias("support"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def calibration_error(x: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi], the first with 0."""
    b = x.groupBy(F.greatest(F.lit(1), F.ceil(F.col("c") * bins)).alias("b")).agg(F.count("*").alias("n"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("a"), F.avg("c").alias("m"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("m"))) / F.sum("n")).alias("ece"))


def mcnemar_p(fixed: int, broken: int) -> float:
    """Exact two-sided p of fixed against broken."""
    n, k = fixed + broken, min(fixed, broken)
    if n == 0:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * sum(math.exp(log(i)) for i in range(k + 1)))


def _least(x: DataFrame, losses: list, values: list[float], name: str) -> DataFrame:
    row = x.agg(*[F.avg(c).alias(f"g{i}") for i, c in enumerate(losses)])
    pairs = F.array(*[F.struct(F.col(f"g{i}").alias("nll"), F.lit(v).alias(name)) for i, v in enumerate(values)])
    return row.select(F.array_min(pairs).alias("b")).select(f"b.{name}", "b.nll")


def fit_temperature(x: DataFrame) -> DataFrame:
    """(temperature, nll) of logits a against label, over a geometric grid."""
    values = [round(0.05 * (400 ** (i / (GRID - 1))), 6) for i in range(GRID)]
    top = F.array_max("a")
    loss = lambda t: F.log(F.aggregate("a", F.lit(0.0), lambda s, v: s + F.exp((v - top) / t))) - (F.get("a", F.col("label")) - top) / t
    return _least(x, [loss(t) for t in values], values, "temperature")


def fit_weight(x: DataFrame) -> DataFrame:
    """(weight, nll) of the blend of p and i against label."""
    values = [round(i / (GRID - 1), 6) for i in range(GRID)]
    p, i = F.get("p", F.col("label")), F.get("i", F.col("label"))
    return _least(x, [-F.log(F.greatest(w * p + (1 - w) * i, F.lit(1e-9))) for w in values], values, "weight")
