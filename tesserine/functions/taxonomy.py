"""Category maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lookup(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for a, b in pairs:
        out = out.when(c == a, F.lit(b))
    return out.otherwise(F.lit(None).cast("string"))


def map_category(raw: Column) -> Column:
    """Training label of a raw category, NULL for one left out or a split parent
    without child."""
    parent, child = F.split_part(raw, F.lit("/"), F.lit(1)), F.regexp_extract(raw, "^[^/]*/(.*)$", 1)
    return F.coalesce(
        lookup(raw, K.MERGED_PATHS),
        lookup(raw, K.PROMOTED),
        F.when(parent.isin(*K.EXCLUDED, *K.DROPPED), F.lit(None).cast("string"))
        .when(parent.isin(*[a for a, _ in K.MERGED]), lookup(parent, K.MERGED))
        .when(parent.isin(*K.SPLIT_PARENTS), F.nullif(child, F.lit("")))
        .otherwise(parent),
    )


def project_labels(labels: list[str]) -> tuple[list[str], list[list[int]]]:
    """(names, positions) a checkpoint's labels merge to, in first-seen order."""
    merged = dict(K.MERGED) | dict(K.MERGED_PATHS)
    names: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        parent, _, child = label.partition("/")
        if parent in K.EXCLUDED:
            continue
        name = merged.get(label) or (child if parent in K.SPLIT_PARENTS and child else label)
        names.setdefault(name, []).append(i)
    return list(names), list(names.values())
