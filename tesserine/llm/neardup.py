"""Problem 5: near-duplicate texts by anchor-point covering.

Method.  A text's set of 3-word shingles is sketched by ``TABLES`` fingerprints.
A fingerprint has one minhash value and ``BITS`` bits, each the lowest bit of
another minhash, so a bit differs with probability (1 - s) / 2 between texts of
similarity s.  The anchors are the points whose bits are a code word of the
binary Hamming code of length 15, chosen before any data: a perfect covering code,
so every fingerprint lies within ``RADIUS`` = 1 of exactly one anchor.  Each
fingerprint is replicated to every anchor within covering radius plus threshold
(``REACH`` = 1), at most eight.  Two fingerprints at distance up to 2 * REACH have
a point halfway between them, which lies within REACH of both and within RADIUS of
an anchor, so both reach that anchor.  Texts that meet at an anchor of any table
and whose ``CHECK``-bit sketches differ in at most ``FAR`` bits are compared
exactly, by the Jaccard similarity of their shingle sets.

A pair of similarity s meets in one table with probability s * P(at most 2 of 15
bits differ): 0.42 at 0.7, 0.65 at 0.8, 0.87 at 0.9.  ``TABLES`` = 10 tables miss
a pair of exactly 0.7 with probability 4e-3 and one of 0.8 with 3e-5; the sketch
check loses one of 0.7 with probability below 1e-5.  The minhash value keeps
unrelated texts apart; for collections far larger, ``PREFIX`` values do.

Texts with the same shingle set form one class and only its representative
is sketched.  ``pairs`` must give every pair, so all members of an anchor meet, in
a shuffled join that adaptive execution splits where an anchor is hot.  ``groups``
need not: members of an anchor are first compared with its least id alone, and
what these comparisons join is one component; only texts that stand at an anchor
with members of another component are compared further, and of those the largest
component's members never with each other.  n near copies cost n - 1 comparisons.

Defined results: rows without key are left out; rows with NULL, empty or short (< ``MIN_WORDS`` words) text have
no pairs; ties and repeated rows are pairs like any others; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, shingles, signed, small, word_hashes, words

SHINGLE = 3
MIN_WORDS = 40
THRESHOLD = 0.7
TABLES, PREFIX, BITS = 10, 1, 15
RADIUS = REACH = 1
CHECK, FAR = 64, 24
#: Shingles hashed at a time.
BLOCK = 512

_rng = np.random.default_rng(20240501)
_SEEDS = _rng.integers(1, 2**63, TABLES * (PREFIX + BITS) + CHECK, dtype=np.uint64) | np.uint64(1)


def syndrome(word: int) -> int:
    """Of the Hamming code: 0 for a code word, else the bit (from 1) to flip."""
    s = 0
    for i in range(BITS):
        if word >> i & 1:
            s ^= i + 1
    return s


def _masks() -> np.ndarray:
    """Per syndrome the flips of at most RADIUS + REACH bits that give a code word,
    padded by repetition: a flip of bits i and j changes the syndrome by i ^ j."""
    flips = [0, *(1 << i for i in range(BITS)), *(1 << i | 1 << j for i in range(BITS) for j in range(i))]
    by = [[f for f in flips if syndrome(f) == s] for s in range(BITS + 1)]
    most = max(map(len, by))
    return np.array([x + [x[0]] * (most - len(x)) for x in by], np.uint64)


_SYNDROME = np.array([syndrome(w) for w in range(1 << BITS)])
_MASKS = _masks()
_ROW = (np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def shingle_set(text: str, k: int = SHINGLE, least: int = MIN_WORDS) -> np.ndarray | None:
    """Sorted distinct shingle hashes, None for a text of fewer words."""
    ws = words(text)
    if len(ws) < max(least, k):
        return None
    return np.unique(shingles(word_hashes(ws), k))


def fingerprint(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(minhash values, bits as numbers below 2^BITS, sketch): one row a table."""
    out = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    for lo in range(0, len(s), BLOCK):
        x = s[lo : lo + BLOCK] * _SEEDS[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(out, x.min(1), out=out)
    out = mix64(out)
    low = out & np.uint64(1)
    m = TABLES * (PREFIX + BITS)
    bits = low[TABLES * PREFIX : m].reshape(TABLES, BITS) << np.arange(BITS, dtype=np.uint64)
    sketch = low[m:] << np.arange(CHECK, dtype=np.uint64)
    return out[: TABLES * PREFIX].reshape(TABLES, PREFIX), bits.sum(1, dtype=np.uint64), int(sketch.sum(dtype=np.uint64).astype(np.int64))


def anchors(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """TABLES x 8 ids of the anchors within RADIUS + REACH of the fingerprints."""
    code = bits[:, None] ^ _MASKS[_SYNDROME[bits.astype(np.int64)]]
    head = np.zeros(len(values), np.uint64)
    for j in range(values.shape[1]):
        head = mix64(head * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return mix64(head[:, None] + code * np.uint64(0xD6E8FEB86659FD93) + _ROW)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, classes, arrays, sketches = [], [], [], []
        for i, text in zip(b["id"], b["text"]):
            s = shingle_set(text)
            if s is not None:
                v, bits, sk = fingerprint(s)
                ids.append(i)
                classes.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                arrays.append(signed(np.unique(anchors(v, bits))))
                sketches.append(sk)
        if ids:
            yield pd.DataFrame({"id": np.array(ids, np.int64), "cls": classes, "anchors": arrays, "sketch": np.array(sketches, np.int64)})


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, cls, anchors, sketch) of every text long enough; lineage is cut here,
    since classes, candidates and members all read it."""
    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    src = src.where((F.length("text") >= 2 * MIN_WORDS - 1) & F.col("id").isNotNull())
    return cut(src.mapInPandas(_sketch, "id long, cls string, anchors array<long>, sketch long"))


def classes(sk: DataFrame) -> DataFrame:
    """One row per distinct shingle set: its least id stands for it."""
    return sk.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def copies(sk: DataFrame) -> DataFrame:
    """(id, rep) of the texts whose shingle set others have too."""
    return sk.select("id", "cls").distinct().join(classes(sk).where("n > 1"), "cls").select("id", "rep")


def stands(sk: DataFrame, many: DataFrame) -> DataFrame:
    """(anchor, id, sketch) of the representatives, at anchors more than one reaches."""
    at = sk.join(many.where("id <> rep").select("id"), "id", "left_anti").select("id", "sketch", F.explode("anchors").alias("anchor"))
    met = at.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    return cut(at.join(small(met), "anchor", "left_semi"))


def near(x: str, y: str):
    return F.expr(f"bit_count({x} ^ {y}) <= {FAR}")


def _jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept: dict[int, np.ndarray] = {}

    def of(i: int, text: str) -> np.ndarray:
        if i not in kept:
            if len(kept) > 2000:
                kept.clear()
            kept[i] = shingle_set(text)
        return kept[i]

    for b in batches:
        out = []
        for i, j, x, y in zip(b["id_a"], b["id_b"], b["text_a"], b["text_b"]):
            p, q = of(i, x), of(j, y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        yield pd.DataFrame({"id_a": b["id_a"], "id_b": b["id_b"], "jaccard": out})


def with_texts(pairs: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """Add text_a and text_b; only texts of documents in pairs are moved."""
    ids = small(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "8")
    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    a = src.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    b = src.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    return pairs.join(a, "id_a").join(b, "id_b")


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    full = with_texts(pairs, df, key, text)
    return full.mapInPandas(_jaccard, "id_a long, id_b long, jaccard double").where(F.col("jaccard") >= threshold)


def links(df: DataFrame, at: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b, jaccard) between representatives of different classes."""
    a, b = at.alias("a"), at.alias("b")
    met = a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.id") < F.col("b.id")) & near("a.sketch", "b.sketch"))
    return verified(cut(met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()), df, key, text, threshold)


def with_copies(found: DataFrame, many: DataFrame) -> DataFrame:
    """(id_a, id_b), least first, of pairs of representatives expanded to all
    copies (id, rep), and of the copies themselves."""
    x, y = many.alias("x"), many.alias("y")
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    side = lambda c: many.select(F.col("rep").alias(c), F.col("id").alias(f"m_{c}"))
    across = (
        found.select("id_a", "id_b")
        .join(side("id_a"), "id_a", "left")
        .join(side("id_b"), "id_b", "left")
        .select(F.coalesce("m_id_a", "id_a").alias("a"), F.coalesce("m_id_b", "id_b").alias("b"))
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    )
    return across.unionByName(within)


def pairs(df: DataFrame, key: str = "fetch_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b) of all rows with similarity >= threshold, copies included."""
    sk = sketches(df, key, text)
    many = copies(sk)
    return with_copies(links(df, stands(sk, many), key, text, threshold), many)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, root) of the connected components: labels shrink to the least id by
    large-star / small-star rounds, each a shuffle of the edges and cut from its
    lineage; ends when a round changes nothing, which takes about the logarithm of
    the longest chain.  Running out of rounds is an error, not a result."""
    cur = cut(edges.select(F.least("id_a", "id_b").alias("v"), F.greatest("id_a", "id_b").alias("u")).distinct())
    for _ in range(rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        small_low = big.groupBy("u").agg(F.min("v").alias("m"))
        star = big.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        new = cut(star.where("u <> v").distinct())
        changed = new.exceptAll(cur.select(F.col("u"), F.col("v"))).limit(1).count() + cur.select("u", "v").exceptAll(new).limit(1).count()
        cur = new.select(F.col("v"), F.col("u"))
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    star = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return star.union(star.select(F.col("root").alias("id"), "root").distinct())


def hub_candidates(at: DataFrame) -> DataFrame:
    """(id_a, id_b): every member of an anchor with the anchor's least id."""
    hub = at.groupBy("anchor").agg(F.min(F.struct("id", "sketch")).alias("hub"))
    met = at.join(hub, "anchor").where((F.col("hub.id") < F.col("id")) & near("hub.sketch", "sketch"))
    return met.select(F.col("hub.id").alias("id_a"), F.col("id").alias("id_b")).distinct()


def rest_candidates(at: DataFrame, root: DataFrame) -> DataFrame:
    """(id_a, id_b): members of an anchor in different components.  Those of its
    largest component are only compared with the others."""
    all_ = at.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    size = all_.groupBy("anchor", "root").agg(F.count("*").alias("n"))
    main = size.groupBy("anchor").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    some = all_.join(main.select("anchor", "main"), "anchor")
    a, b = some.where("root <> main").alias("a"), some.alias("b")
    other = (F.col("b.root") == F.col("b.main")) | ((F.col("a.root") != F.col("b.root")) & (F.col("a.id") < F.col("b.id")))
    met = a.join(b, (F.col("a.anchor") == F.col("b.anchor")) & other & near("a.sketch", "b.sketch"))
    return met.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b")).distinct()


def groups(df: DataFrame, key: str = "fetch_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per text long enough: its id, the least id of its group and the
    number of its exact copies.  Copies are not expanded into pairs."""
    sk = sketches(df, key, text)
    at = stands(sk, copies(sk))
    first = cut(verified(cut(hub_candidates(at)), df, key, text, threshold).select("id_a", "id_b"))
    more = cut(rest_candidates(at, components(first)))
    root = components(first.union(verified(more, df, key, text, threshold).select("id_a", "id_b")))
    cls = classes(sk).join(root.withColumnRenamed("id", "rep"), "rep", "left").select("cls", F.coalesce("root", "rep").alias("group_id"), F.col("n").alias("copies"))
    return sk.select("id", "cls").join(cls, "cls").select(F.col("id").alias(key), "group_id", "copies")
