"""Outcome algebra as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def error_code(message: Column, kind: Column | None = None) -> Column:
    """Code of an error by its type and the first matching part of its message."""
    low = F.lower(F.concat_ws(" ", kind, message)) if kind is not None else F.lower(message)
    has = lambda *p: F.coalesce(F.lit(False) | _any(low, p), F.lit(False))
    return (
        F.when(has("timeout"), "timeout")
        .when(has("name or service not known", "nodename nor servname"), "dns_error")
        .when(has("robots"), "robots_blocked")
        .when(has("429", "rate limit"), "archive_rate_limited")
        .when(has("no snapshot", "no archive", "no memento"), "no_archive_snapshot")
        .when(has("connection"), "connection_error")
        .when(has("status") & has("http"), "http_error")
        .otherwise("unknown")
    )


def _any(low: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def given(c: Column) -> Column:
    """NULL for the empty string, which means absent."""
    return F.nullif(c, F.lit(""))


def status(category: Column, error: Column) -> Column:
    return F.when(category.isNotNull() & given(error).isNull(), "ok").otherwise("failed")


def retryable(state: Column, code: Column) -> Column:
    return F.when(state == "ok", False).otherwise(F.coalesce(code.isin(*K.RETRYABLE), F.lit(False)))


def annotated_code(state: Column, code: Column) -> Column:
    return F.when(state == "ok", F.lit(None).cast("string")).otherwise(F.coalesce(given(code), F.lit("unknown")))


def annotated_stage(state: Column, stage: Column) -> Column:
    return F.coalesce(given(stage), F.lit("infer"))
