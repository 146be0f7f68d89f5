"""Readers of the file formats around the corpus."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name) of a list file, blank lines and # comments left out."""
    x = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return x.where("trim(value) <> '' and not startswith(value, '#')").select("pos", F.trim("value").alias("name"))


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """Gold CSV with # comments; a label outside the vocabulary is an error."""
    x = spark.read.option("header", True).option("comment", "#").csv(path).select(F.lower(F.trim("domain")).alias("domain"), F.trim("expected").alias("expected"))
    return x.withColumn("expected", F.when(F.col("expected").isin(*K.CLASSES), F.col("expected")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), "expected")).cast("string")))


def screenshot_index(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    key, dom = x.columns[:2]
    return x.select(F.ltrim(F.trim(key), F.lit("0")).alias("key"), F.lower(F.trim(dom)).alias("domain")).where("key <> '' and domain <> ''")


def corpus(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(split, domain, category, text) of the JSON-lines files of a corpus."""
    out = None
    for s in splits:
        x = spark.read.schema("domain string, category string, text string").json(f"{path}/{s}.jsonl").withColumn("split", F.lit(s))
        out = x if out is None else out.unionByName(x)
    return out


def verdict_log(spark: SparkSession, path: str, prompt_hash: str, seq: str = "logged_at") -> DataFrame:
    from ..operators.reports import last_by

    return last_by(spark.read.json(path).where(F.col("prompt_hash") == prompt_hash), "domain", seq)


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """First gloss of each mapped label of a tab-separated file."""
    from ..functions.taxonomy import map_category

    x = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where("contains(value, '\t')")
    raw, gloss = F.split_part("value", F.lit("\t"), F.lit(1)), F.regexp_replace(F.trim(F.split_part("value", F.lit("\t"), F.lit(2))), r"\s+", " ")
    return x.select("n", map_category(F.trim(raw)).alias("label"), gloss.alias("gloss")).where("label is not null").groupBy("label").agg(F.min_by("gloss", "n").alias("gloss"))


def collections(spark: SparkSession, path: str) -> DataFrame:
    """Run envelopes, newest first; unreadable files are left out."""
    x = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return x.where("collection_id is not null").orderBy(F.desc("timestamp"))


def html_tree(spark: SparkSession, path: str) -> DataFrame:
    """(category, domain, html) of a <category>/<domain>.html tree."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)\.html$", 2)
    return x.select(F.replace(F.regexp_extract("path", r"([^/]+)/([^/]+)\.html$", 1), F.lit("__"), F.lit("/")).alias("category"), F.lower(name).alias("domain"), F.col("content").cast("string").alias("html"))


def warc_body(member: bytes | None) -> tuple[str, str] | None:
    """(target address, page) of the first response record of a gzip member."""
    try:
        raw = gzip.decompress(member or b"")
    except (OSError, EOFError):
        return None
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n"))}
    if fields.get(b"warc-type") != b"response":
        return None
    body = rest[: int(fields[b"content-length"])] if fields.get(b"content-length", b"").isdigit() else rest
    return fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), body.partition(b"\r\n\r\n")[2].decode("utf-8", "replace")


def warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, html) of archive records, one gzip member a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, r in ((p, warc_body(c)) for p, c in zip(b["path"], b["content"])) if r]
            yield pd.DataFrame(rows, columns=["path", "url", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, url string, html string")
