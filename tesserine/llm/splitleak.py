"""Problem 7: texts of held-out splits that also stand in the training split.

Method.  Words are shingled by five.  Each band of ``BAND`` consecutive shingles
of a training text puts its minwise hash into a bucket; the same shingle is often
the least of many bands.  A held-out text looks its shingles up in those buckets,
so buckets are only joined across splits.  Whole-text minhash could not see a short
text inside a long one, which the containment asked for here allows.

Let a held-out text have n distinct shingles, 0.8 n of them in a training text.
Each place where the two part (words replaced, added, left out or moved) costs at
least four shingles, so at most 0.05 n + 1 stretches hold the common ones, and a
stretch of k holds k // BAND whole bands, each of which puts one common shingle into
a bucket: with BAND = 4 at least (0.8 n - 3 (0.05 n + 1)) / 4 = 0.1625 n - 0.75 of
the text's shingles are found there.  So the ``n - floor(0.1625 n - 0.75) + 1``
shingles rarest in the training buckets are looked up, one of which is always found;
what a hot site repeats on every page is looked up only by texts that consist
of it.  (Repeated shingles count once in n but in every stretch they stand in.)
Texts with the same words are one class per side, joined once.  Candidates are
verified exactly: containment and Jaccard similarity of the shingle sets.

``report`` counts confirmed classes with their sizes and expands no copies.

Defined results: rows without key are left out; rows without verdict, with NULL or short text on the held-out
side, have no pairs; an empty table gives none; verdicts that name two splits
for one domain count as the greater name; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shingles, signed, small, word_hashes, words

SHINGLE = 5
BAND = 4
MIN_WORDS = 40
THRESHOLD = 0.8
TRAIN, HELD = "split = 'train'", "split in ('val', 'test')"


def band_minima(s: np.ndarray) -> np.ndarray:
    """Distinct minwise hashes of all bands (of the one short band if fewer)."""
    if len(s) == 0:
        return s
    if len(s) <= BAND:
        return s.min(keepdims=True)
    return np.unique(sliding_window_view(s, BAND).min(1))


def lookups(n: int) -> int:
    """How many of n distinct shingles, rarest first, are looked up."""
    return min(n, n - int(np.floor(0.1625 * n - 0.75)) + 1) if n else 0


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, splits, ns, classes, buckets = [], [], [], [], []
        for i, split, text in zip(b["id"], b["split"], b["text"]):
            h = word_hashes(words(text))
            if len(h) >= (SHINGLE if split == "train" else MIN_WORDS):
                s = shingles(h, SHINGLE)
                s = band_minima(s) if split == "train" else np.unique(s)
                ids.append(i)
                splits.append(split)
                ns.append(lookups(len(s)))
                classes.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
                buckets.append(signed(s))
        if ids:
            yield pd.DataFrame({"id": np.array(ids, np.int64), "split": splits, "n": np.array(ns, np.int64), "cls": classes, "buckets": buckets})


def split_of_domain(verdicts: DataFrame) -> DataFrame:
    """(domain, split), one row per trimmed and lower-cased domain."""
    d = F.lower(F.regexp_replace("domain", r"(?U)^\s+|\s+$", ""))
    return verdicts.where("split is not null").groupBy(d.alias("domain")).agg(F.max("split").alias("split"))


def sketches(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, split, n, cls, buckets) of the texts of any split that are long enough;
    lineage is cut, as classes, candidates and members read it."""
    src = pages.select(F.col("fetch_id").cast("long").alias("id"), "domain", "text").where("length(text) >= 9 and domain is not null and id is not null")
    split = small(split_of_domain(verdicts).where(F.col("split").isin("train", "val", "test")), "32 + length(domain)")
    return cut(src.join(split, "domain").select("id", "split", "text").mapInPandas(_sketch, "id long, split string, n long, cls string, buckets array<long>"))


def members(sk: DataFrame, side: str) -> DataFrame:
    """(id, split, rep) of one side: the least id stands for the same words."""
    m = sk.where(side).select("id", "split", "cls")
    return m.join(m.groupBy("cls").agg(F.min("id").alias("rep")), "cls").select("id", "split", "rep").distinct()


def candidates(sk: DataFrame) -> DataFrame:
    """(id_a, id_b): held-out and training representatives that share a bucket."""

    def side(where: str) -> DataFrame:
        x = sk.where(where)
        more = members(sk, where).where("id <> rep").select("id")
        return x.join(more, "id", "left_anti")

    t = side(TRAIN).select(F.col("id").alias("t"), F.explode("buckets").alias("bucket"))
    h = side(HELD).select(F.col("id").alias("h"), "n", F.explode("buckets").alias("bucket"))
    df = t.groupBy("bucket").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("h").orderBy(F.coalesce("df", F.lit(0)), "bucket")
    look = h.join(df, "bucket", "left").withColumn("r", F.row_number().over(by_rarity)).where("r <= n and df is not null").select("h", "bucket")
    return look.join(t, "bucket").select(F.col("h").alias("id_a"), F.col("t").alias("id_b")).distinct()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict[int, np.ndarray] = {}

    def of(i: int, text: str) -> np.ndarray:
        if i not in kept:
            if len(kept) > 2000:
                kept.clear()
            kept[i] = np.unique(shingles(word_hashes(words(text)), SHINGLE))
        return kept[i]

    for b in batches:
        c, j = [], []
        for i, k, x, y in zip(b["id_a"], b["id_b"], b["text_a"], b["text_b"]):
            p, q = of(i, x), of(k, y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            c.append(both / len(p))
            j.append(both / (len(p) + len(q) - both))
        yield pd.DataFrame({"id_a": b["id_a"], "id_b": b["id_b"], "containment": c, "jaccard": j})


def overlaps(pages: DataFrame, sk: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b, containment, jaccard) of the confirmed pairs of held-out and
    training representatives."""
    from .neardup import with_texts

    full = with_texts(cut(candidates(sk)), pages, "fetch_id", "text")
    checked = full.mapInPandas(_verify, "id_a long, id_b long, containment double, jaccard double")
    return checked.where(F.col("containment") >= threshold)


def pairs(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    sk = sketches(pages, verdicts)
    held, train = (members(sk, s) for s in (HELD, TRAIN))
    o = (
        overlaps(pages, sk)
        .join(held.select(F.col("rep").alias("id_a"), F.col("id").alias("held_id")), "id_a")
        .join(train.select(F.col("rep").alias("id_b"), F.col("id").alias("train_id")), "id_b")
    )
    return o.select(F.least("held_id", "train_id").alias("fetch_id_a"), F.greatest("held_id", "train_id").alias("fetch_id_b")).distinct()


def report(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per held-out split and source of the page: overlapping rows, pairs and their
    mean similarity, counted by classes."""
    sk = sketches(pages, verdicts)
    size = members(sk, TRAIN).groupBy(F.col("rep").alias("id_b")).agg(F.count("*").alias("size"))
    by_held = overlaps(pages, sk).join(size, "id_b").groupBy(F.col("id_a").alias("rep"))
    by_held = by_held.agg(F.sum("size").alias("pairs"), F.sum(F.col("size") * F.col("jaccard")).alias("sum"))
    held = members(sk, HELD).join(by_held, "rep")
    source = pages.select(F.col("fetch_id").cast("long").alias("id"), "source").distinct()
    return (
        held.join(source, "id")
        .groupBy("split", "source")
        .agg(F.count_distinct("id").alias("rows"), F.sum("pairs").alias("pairs"), F.round(F.sum("sum") / F.sum("pairs"), 4).alias("mean_jaccard"))
    )
