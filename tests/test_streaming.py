"""Streams drain to what a batch gives."""

from __future__ import annotations

from tesserine.streaming import jobs


def test_ttl(spark, tmp_path):
    x = spark.createDataFrame([(1, "2025-01-01 00:00:00", "a"), (2, "2025-01-01 00:01:00", "a"), (3, "2025-01-01 00:02:00", "b")], "event_id long, ts string, k string")
    x.selectExpr("event_id", "cast(ts as timestamp) ts", "k").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = jobs.drain(jobs.fresh_keys(jobs.stream(spark, str(tmp_path / "e")), "k", "ts"))
    assert sorted(r["k"] for r in got.collect()) == ["a", "b"]
