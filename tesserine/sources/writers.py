"""Writers of results, corpora and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_row(df: DataFrame, model: str) -> DataFrame:
    """The header of a result file: model and counts."""
    return df.agg(F.lit(model).alias("model_used"), F.count("*").alias("total_domains"), F.count("category").alias("successful"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"))


def splits(df: DataFrame, path: str) -> None:
    """(split, domain, category, text) as JSON lines in a folder per split."""
    df.select("split", "domain", "category", "text").write.mode("overwrite").partitionBy("split").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a log; readers take the last row of a key, so a retry is safe."""
    df.write.mode("append").json(path)


def sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
