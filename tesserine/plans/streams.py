"""Streaming queries, drained over the tables as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .base import query


@query("SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_outcome_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of event kinds; complete mode over all that has arrived."""
    s = jobs.outcome_windows(jobs.stream(spark, f"{d}/events.parquet"), "ts", "event_type")
    return jobs.drain(s, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id")
def stream_fresh_users(spark: SparkSession, d: str) -> DataFrame:
    """First event per user: every batch of the stream is reduced and appended, so
    no state grows with the users."""
    first = lambda b: b.groupBy("user_id").agg(F.min("ts").alias("ts"))
    return jobs.fold(jobs.stream(spark, f"{d}/events.parquet").select("user_id", "ts"), first)


@query()
def stream_dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Events whose user wasn't seen within the time to live."""
    return jobs.drain(jobs.fresh_keys(jobs.stream(spark, f"{d}/events.parquet"), "user_id", "ts")).select("event_id", "user_id")
