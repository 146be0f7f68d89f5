"""Salvaging classifications from model replies.

A reply is scanned for JSON values: at each opening bracket outside the values
found so far the decoder tries to read one.  Values inside code fences come before
those in prose, lists before objects.  Where no value holds a category, the prose is
read field by field.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()
_FENCE = "```"
#: Category names looked for last in a reply without JSON (fixed values).
_USUAL = ("news", "shopping", "social", "educational", "entertainment", "technology", "finance", "health", "government", "sports")
#: What a reply without JSON may put before its category (fixed values).
_LEADS = ("category", "classified as", "categorized as", "categorize as")
_BLANKS = " \t\r\n:"


def _values(text: str) -> Iterator[object]:
    """JSON lists and objects that stand in a text, in order."""
    at = 0
    while at < len(text):
        starts = [i for i in (text.find("[", at), text.find("{", at)) if i >= 0]
        if not starts:
            return
        try:
            value, at = _DECODER.raw_decode(text, min(starts))
            yield value
        except ValueError:
            at = min(starts) + 1


def _quoted(text: str) -> str:
    """The text with bare words before a colon put between quotation marks."""
    out, word, inside = [], "", False
    for i, c in enumerate(text):
        if c == '"' and text[i - 1 : i] != "\\":
            inside = not inside
        if not inside and (c.isalnum() or c == "_"):
            word += c
            continue
        if word:
            out.append(f'"{word}"' if c == ":" and not word[0].isdigit() else word)
            word = ""
        out.append(c)
    return "".join(out) + word


def _holds(value: object) -> bool:
    return any(isinstance(x, dict) and "category" in x for x in (value if isinstance(value, list) else [value]))


def extract(reply: str) -> object | None:
    """The JSON value of a reply: all of it, else the first that holds a category,
    fenced before bare and lists before objects, else all of it with its keys quoted."""
    reply = reply.strip()
    for whole in (reply, _quoted(reply)):
        try:
            return json.loads(whole)
        except ValueError:
            pass
        parts = whole.split(_FENCE)
        fenced = [v for p in parts[1::2] for v in _values(p)]
        bare = [v for p in parts[::2] for v in _values(p)]
        for values in (fenced, bare):
            held = [v for v in values if _holds(v)]
            if held:
                return next((v for v in held if isinstance(v, list)), held[0])
    return None


def _sure(x: object) -> float:
    try:
        return max(0.0, min(1.0, float(x)))
    except (TypeError, ValueError):
        return 0.5


def checked(item: object) -> tuple[str | None, str, float, str] | None:
    """(domain, category, confidence, reasoning) of a well-formed item."""
    if not isinstance(item, dict):
        return None
    c = str(item.get("category", "")).strip().lower()
    if not c:
        return None
    dom = str(item["domain"]).strip().lower() if "domain" in item else None
    return dom, c, _sure(item.get("confidence", 0.5)), str(item.get("reasoning", "No reasoning provided")).strip()


def _word_after(low: str, lead: str, kind) -> str:
    """The run of characters of a kind that follows a lead and some blanks."""
    at = low.find(lead)
    while at >= 0:
        rest = low[at + len(lead) :]
        word = rest.lstrip(_BLANKS)
        if word != rest:
            end = next((i for i, c in enumerate(word) if not kind(c)), len(word))
            if end:
                return word[:end]
        at = low.find(lead, at + 1)
    return ""


def from_prose(reply: str) -> tuple[None, str, float, str] | None:
    low = reply.lower()
    letters, digits = (lambda c: c == "_" or c.isascii() and c.isalpha()), (lambda c: c == "." or c.isdigit())
    found = next((w for lead in _LEADS if (w := _word_after(low, lead, letters))), None) or next((u for u in _USUAL if u in low), None)
    if not found:
        return None
    number = _word_after(low, "confidence", digits)
    if not number and "confidence" in low:
        before = low[: low.find("confidence")].split()
        number = before[-1] if before and before[-1].replace(".", "", 1).isdigit() else ""
    number = number.rstrip(".")
    return None, found, _sure(number) if number else 0.5, "Parsed from text response"


def parse(reply: str | None) -> list[tuple[str | None, str, float, str]]:
    """The classifications of a reply, several for a batch."""
    if not reply or not reply.strip():
        return []
    got = extract(reply)
    items = got if isinstance(got, list) else [got] if got is not None else []
    out = [r for r in map(checked, items) if r]
    return out or ([r] if got is None and (r := from_prose(reply)) else [])


def parse_one(reply: str | None) -> tuple[str | None, str, float, str] | None:
    """The classification of a reply to one request: a list gives its first item."""
    if not reply or not reply.strip():
        return None
    got = extract(reply)
    return from_prose(reply) if got is None else checked(got[0] if isinstance(got, list) and got else got)


def parsed(df: DataFrame, key: str, reply: str, allowed: list[str] | None = None, single: bool = False) -> DataFrame:
    """(key, item, domain, category, confidence, reasoning, valid)."""
    read = (lambda t: [r] if (r := parse_one(t)) else []) if single else parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *r) for i, t in zip(b["k"], b["reply"]) for k, r in enumerate(read(t))]
            yield pd.DataFrame(rows, columns=["k", "item", "domain", "category", "confidence", "reasoning"])

    out = df.select(F.col(key).cast("long").alias("k"), F.col(reply).alias("reply")).mapInPandas(run, "k long, item long, domain string, category string, confidence double, reasoning string")
    valid = F.col("category").isin(*allowed) if allowed else F.lit(True)
    return out.withColumnRenamed("k", key).withColumn("valid", valid)
