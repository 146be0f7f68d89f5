"""Every catalogue query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from tesserine.plans import catalogue

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings fetch_results verdicts collections results crawl_index gold_labels lang_samples pack_specs mix_targets"
).split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    r = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).count() > 0
