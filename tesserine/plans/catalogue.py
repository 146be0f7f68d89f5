"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import acquisition, audit, corpus, pipeline, scalars, scores, selection, streams, verdicts  # noqa: F401
from .base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["annotate_rows"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
