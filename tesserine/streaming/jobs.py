"""Streams: keyed time-to-live state, outcome windows, resumable verdict log.

Sources are file streams, so a restarted job resumes from its checkpoint.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL = "300 seconds"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a Parquet table (one file or a folder)."""
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    folder, name = os.path.split(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _timed(events: DataFrame, time: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp"))


def fresh_keys(events: DataFrame, key: str, time: str, ttl: str = TTL) -> DataFrame:
    """The first event of each key within the time to live: what a cache misses."""
    return _timed(events, time).withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def outcome_windows(events: DataFrame, time: str, kind: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and kind; events later than the watermark are left out."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def folder(spark: SparkSession) -> str:
    """A new folder in the one all executors share; only a local session, whose
    only machine this is, may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return base.rstrip("/") + "/stream-" + os.urandom(6).hex() if base else tempfile.mkdtemp(prefix="tesserine-stream-")


def fold(df: DataFrame, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reduce each batch of a stream, append the results to a table and reduce that:
    for reductions of reductions (least, greatest, sums), without state."""
    base = folder(df.sparkSession)
    out = f"{base}/out"
    w = df.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
    w.foreachBatch(lambda b, n: reduce(b).write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    return reduce(df.sparkSession.read.parquet(out).drop("batch"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table of the session's shared
    folder, and read that table."""
    spark = df.sparkSession
    base = folder(spark)
    out = f"{base}/out"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
    else:
        w.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
