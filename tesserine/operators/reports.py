"""Reconciling requests with results and reporting on a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcomes, url


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order per key, all columns."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def last_by(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def annotate(rows: DataFrame) -> DataFrame:
    """Status, stage, code and retryable of result rows; idempotent."""
    s = F.coalesce(outcomes.given(F.col("status")), outcomes.status(F.col("category"), F.col("error")))
    x = rows.withColumn("status", s)
    x = x.withColumn("error_code", outcomes.annotated_code(F.col("status"), F.col("error_code"))).withColumn("stage", outcomes.annotated_stage(F.col("status"), F.col("stage")))
    return x.withColumn("retryable", outcomes.retryable(F.col("status"), F.col("error_code")))


def reconcile(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Requested names left-joined with the first result under the name or its
    host, failures made up for the rest, unasked results appended.  Both sides are
    joined on equal keys."""
    keyed = results.select("fetch_id", "domain", "url", "category", "confidence", "status", F.explode(F.array_distinct(F.array("domain", "url"))).alias("k")).where("k <> ''")
    first = first_by(keyed, "k", "fetch_id")
    r = requested.withColumn("host", url.domain_of(F.col("name")))
    by_name = first.select(F.col("k").alias("name"), *[F.col(c).alias(f"n_{c}") for c in ("fetch_id", "category", "confidence", "status")])
    by_host = first.select(F.col("k").alias("host"), *[F.col(c).alias(f"h_{c}") for c in ("fetch_id", "category", "confidence", "status")])
    m = r.join(by_name, "name", "left").join(by_host, "host", "left")
    pick = lambda c: F.coalesce(f"n_{c}", f"h_{c}") if c == "fetch_id" else F.when(F.col("n_fetch_id").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"h_{c}"))
    asked = m.select("name", "host", *[pick(c).alias(c) for c in ("fetch_id", "category", "confidence", "status")])
    got = asked.where("fetch_id is not null")
    # One result row is given once even if several names ask for it.
    got = got.groupBy("fetch_id", "category", "confidence", "status").agg(F.min("name").alias("name"))
    missing = asked.where("fetch_id is null").select(F.lit(None).cast("long").alias("fetch_id"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"), F.lit("failed").alias("status"), "name")
    extra = results.select("fetch_id", "category", "confidence", "status").distinct().join(got, "fetch_id", "left_anti").withColumn("name", F.lit(None).cast("string"))
    return got.unionByName(missing).unionByName(extra).select("name", "fetch_id", "category", "confidence", "status")


def report(rows: DataFrame) -> DataFrame:
    """(dim, value, n) counts of reasons and stages of failures and of sources of
    successes, by grouping sets."""
    fail = F.col("status") == "failed"
    x = rows.select(F.when(fail, F.col("error_code")).alias("reason"), F.when(fail, F.col("stage")).alias("stage"), F.when(~fail, F.coalesce("source", F.lit("live"))).alias("source"))
    g = x.groupingSets([["reason"], ["stage"], ["source"]], "reason", "stage", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "reason").when(F.col("g") == 5, "stage").otherwise("source")
    return g.select(dim.alias("dim"), F.coalesce("reason", "stage", "source").alias("value"), "n").where("value is not null")
