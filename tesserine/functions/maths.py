"""Distributions over labels as Column expressions on aligned arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column) -> Column:
    """Divided by its total; unchanged where that is 0."""
    s = total(a)
    return F.when(s == 0, a).otherwise(F.transform(a, lambda x: x / s))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(e, lambda x: x / total(e))


def argmax(p: Column) -> Column:
    """Position (from 1) of the first largest entry."""
    return F.array_position(p, F.array_max(p))


def grouped(p: Column, groups: list[list[int]]) -> Column:
    """Mass of each group of positions (from 0), renormalised."""
    return scaled(F.array(*[sum((F.get(p, F.lit(i)) for i in g), F.lit(0.0)) for g in groups]))


def fused(text: Column, image: Column, weight: float | list[float]) -> Column:
    """Weighted blend of two aligned distributions, renormalised."""
    if isinstance(weight, list):
        w = F.array(*[F.lit(float(x)) for x in weight])
        blend = F.transform(F.arrays_zip(text.alias("t"), image.alias("i"), w.alias("w")), lambda z: z["w"] * z["t"] + (1 - z["w"]) * F.coalesce(z["i"], F.lit(0.0)))
    else:
        blend = F.zip_with(text, image, lambda t, i: weight * t + (1 - weight) * F.coalesce(i, F.lit(0.0)))
    return scaled(blend)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log(x + 1e-12))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the interval of a share; (0, 0) without cases."""
    p = F.try_divide(hits, n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    zero = lambda x: F.when(n == 0, 0.0).otherwise(x)
    return zero(F.greatest(mid - half, F.lit(0.0))), zero(F.least(mid + half, F.lit(1.0)))


def hash_split(domain: Column) -> Column:
    """Split by the first four bytes of the SHA-256 of the trimmed small domain."""
    h = F.conv(F.substring(F.sha2(F.lower(F.trim(domain)), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < 80, "train").when(h < 90, "val").otherwise("test")
