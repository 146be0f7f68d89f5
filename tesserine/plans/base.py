"""Registry of catalogue queries and helpers to write their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def sql_any(col: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(p)})" for p in parts) + ")"


def sql_lookup(col: str, pairs: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(a)} THEN {q(b)}" for a, b in pairs) + " END"
