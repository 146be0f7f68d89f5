"""Registered queries run; those SQL can define give its rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tesserine.llm import queries as llm

FIXED = {
    "p1_found": {"fetch_id", "field", "lang"}, "p2_found": {"fetch_id", "line_no"}, "p3_found": {"fetch_id"}, "p4_found": {"fetch_id"}, "p5_found": {"fetch_id_a", "fetch_id_b"},
    "p6_found": {"fetch_id", "field"}, "p7_found": {"fetch_id_a", "fetch_id_b"}, "p10_found": {"doc_id_a", "doc_id_b"},
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, sf, name):
    df = llm.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in FIXED:
        assert set(df.columns) == FIXED[name] and len(rows) == len(set(rows))
    if name in llm.oracle_sql():
        con = duckdb.connect()
        for t in ("fetch_results", "verdicts", "documents"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        assert sorted(rows) == sorted(con.execute(llm.oracle_sql()[name]).fetchall())


def test_segments_of_every_field(spark, sf, tmp_path):
    samples = spark.read.parquet(f"{sf}/lang_samples.parquet")
    by = {x: " ".join(r["text"] for r in samples.where(f"lang = '{x}'").limit(4).collect()) for x in ("en", "ru")}
    mixed = by["en"] + "\n" + by["ru"]
    samples.write.parquet(f"{tmp_path}/lang_samples.parquet")
    spark.createDataFrame([(1, mixed, by["en"]), (2, by["en"], mixed)], "fetch_id long, text string, meta_description string").write.parquet(f"{tmp_path}/fetch_results.parquet")
    spark.createDataFrame([(3, mixed), (4, by["ru"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["table"], r["id"], r["field"], r["lang"]) for r in llm.p1_segments(spark, str(tmp_path)).collect()}
    assert got == {(t, i, f, x) for t, i, f in (("fetch_results", 1, "text"), ("fetch_results", 2, "meta_description"), ("documents", 3, "text")) for x in by}


def test_entry(spark):
    assert set(llm.queries()) <= set(__spark_entry__.queries()) and set(llm.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
