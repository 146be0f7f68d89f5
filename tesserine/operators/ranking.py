"""Running counts and positions without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
LEVELS = 2


def running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, levels: int = LEVELS) -> DataFrame:
    """Add the sum of value over the rows of the same keys before each row, by an
    integer order column without ties.  Rows are cut into blocks of the order, the
    sums of the blocks into blocks again (``levels`` times in all), so no task holds
    more than BLOCK rows of a level: two levels serve BLOCK^3 rows of a key."""
    at, v = f"_b{levels}", f"_v{levels}"
    x = df.withColumn(v, value).withColumn(at, F.floor(F.col(order) / BLOCK))
    inner = Window.partitionBy(*keys, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum(v).over(inner), F.lit(0)))
    sums = x.groupBy(*keys, at).agg(F.sum(v).alias("_s"))
    if levels > 1:
        before = running(sums, keys, at, F.col("_s"), "_o", levels - 1).drop("_s")
    else:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        before = sums.withColumn("_o", F.coalesce(F.sum("_s").over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    for k in [*keys, at]:
        before = before.withColumnRenamed(k, f"_k{k}")
    cond = F.lit(True)
    for k in [*keys, at]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    return x.join(before, cond).withColumn(out, F.col("_in") + F.col("_o")).select(*df.columns, out)


def positions(df: DataFrame, order: str, out: str = "pos") -> DataFrame:
    """Add the position (from 1) of each row by an integer order column."""
    return running(df, [], order, F.lit(1), out).withColumn(out, F.col(out) + 1)
