"""Choosing crawls and captures; prompt fingerprints."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crawl_day(crawl: str) -> datetime.date | None:
    """Monday of the ISO week a crawl id (…-YYYY-WW) names."""
    try:
        year, week = crawl.split("-")[-2:]
        return datetime.date.fromisocalendar(int(year), int(week), 1)
    except ValueError:
        return None


def nearest_crawls(crawls: list[str], near: str) -> list[str]:
    """Crawl ids by calendar distance to a YYYYMMDD date; unreadable ids last."""
    try:
        day = datetime.datetime.strptime(near[:8], "%Y%m%d").date()
    except ValueError:
        return list(crawls)
    far = 10**9
    return sorted(crawls, key=lambda c: abs((d - day).days) if (d := crawl_day(c)) else far)


def first_usable(index: DataFrame, usable: Column, rank: Column) -> DataFrame:
    """First usable record of each domain by rank, combined map-side."""
    x = index.where(usable).withColumn("_rank", rank)
    cols = [c for c in index.columns if c != "domain"]
    return x.groupBy("domain").agg(F.min_by(F.struct(*cols), "_rank").alias("r")).select("domain", "r.*")


def prompt_hash(categories: list[str], definitions: dict[str, str] | None, max_chars: int) -> str:
    """First 16 hex digits of the digest of what makes a prompt what it is."""
    body = json.dumps({"categories": categories, "definitions": definitions or {}, "max_chars": max_chars}, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)
