"""Predicates on pages and answers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import html_title, tokens


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def block(html: Column, domain: Column, status: Column | None = None) -> Column:
    """STRUCT<blocked, vendor, reason> of a bot wall; NULL vendor where none."""
    low, title = F.lower(html), html_title(html)
    challenge = title.isin(*K.CHALLENGE_TITLES)
    host = F.lower(F.trim(domain))
    stub = (F.coalesce(host, F.lit("")) != "") & (title == host) & (F.length(html) < K.STUB_MAX)
    denial = html.rlike(K.DENIAL)
    suspect = challenge | stub | ((F.length(html) < K.INTERSTITIAL_MAX) & denial)
    verdict = lambda v, r: F.struct(F.lit(True).alias("blocked"), F.lit(v).alias("vendor"), F.lit(r).alias("reason"))
    rules: list[tuple[Column, Column]] = [(contains_any(low, m), verdict(v, "strong_marker")) for v, m in K.STRONG_MARKERS]
    rules.append((challenge, verdict("challenge_title", "title")))
    if status is not None:
        rules.append((status.isin(*K.BLOCK_STATUSES), verdict("http", "status")))
    rules += [(suspect & contains_any(low, m), verdict(v, "weak_marker")) for v, m in K.WEAK_MARKERS]
    rules += [(stub, verdict("stub", "stub")), (denial & suspect, verdict("access_denied", "text"))]
    none = F.struct(F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("vendor"), F.lit(None).cast("string").alias("reason"))
    out = F.when(F.coalesce(html, F.lit("")) == "", none)
    for cond, v in rules:
        out = out.when(F.coalesce(cond, F.lit(False)), v)
    return out.otherwise(none)


def thin(text: Column, least: int = K.MIN_TOKENS) -> Column:
    return tokens(text) < least


def parked(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return contains_any(low, K.PARKING_SERVICES) | ((tokens(low) <= K.PARKED_MAX_WORDS) & contains_any(low, K.PARKING_PHRASES))


def unavailable(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (tokens(low) <= K.UNAVAILABLE_MAX_WORDS) & (contains_any(low, K.SERVER_ARTIFACTS) | contains_any(low, K.UNAVAILABLE_PHRASES))


def length_limit(content_type: Column) -> Column:
    return F.when(content_type == "text/html", K.HTML_LIMIT).when(content_type == "application/pdf", K.PDF_LIMIT).otherwise(K.OTHER_LIMIT)


def robots_allow(status: Column, size: Column, parsed: Column) -> Column:
    """Whether a robots answer lets a page be read."""
    return F.when(status >= 500, False).when(status >= 400, True).when(size > K.ROBOTS_MAX, False).when(status.isNull(), True).otherwise(F.coalesce(parsed, F.lit(False)))


def archive_date(text: Column) -> Column:
    """The date of a YYYYMMDD string from 2000 on, else NULL."""
    d = F.try_to_date(F.when(text.rlike("^[0-9]{8}$"), text), "yyyyMMdd")
    return F.when(d >= F.lit("2000-01-01").cast("date"), d)
