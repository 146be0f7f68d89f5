"""Problem 10: verbatim stretches shared between documents.

Method.  Rabin-Karp hashes of every window of a fixed number of tokens are
counted in Spark; windows that stand in several documents merge into maximal
intervals.  TESTDATA states stretches in code points, so a token is a code point
and a counted window has ``MIN_SPAN`` of them.

To count only windows that can repeat, shorter windows (``WINDOW``) are hashed
first, by one vectorised pass (prefix sums of scrambled code points times powers
of an odd base, modulo 2^64); of every ``MIN_SPAN - WINDOW + 1`` consecutive ones
the least hash is kept and counted.  Each stretch of ``MIN_SPAN`` keeps at least
one, and equal stretches the same one, so every repeated window of ``MIN_SPAN``
lies around a repeated kept one: all windows there are hashed and counted.

* ``intervals``: the repeated windows of a document, merged.
* ``links``: two texts share a stretch exactly if they share a window.  The
  windows of one stretch mostly stand in the same set of documents; sets are told
  apart by their size and the exclusive or of their members' hashes, and one window
  stands for each set, so a footer of n texts costs n rows until the pairs are
  written.  Sets are joined with themselves by a shuffle that adaptive execution
  splits where a set is hot.

Exact copies are one class, which its least id stands for; ``links`` and
``members`` give the result without expanding them.

Windows are compared by 64-bit hashes: among W hashed windows a false meeting
has probability below W^2 / 2^65.

Defined results: rows without key are left out; NULL, empty and shorter texts
have no stretch; a stretch twice in one document only is not shared; periodic
texts count each distinct window once; rows that repeat a key count once; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, signed, small

MIN_SPAN = 200
WINDOW = 100
_B = 0x9E3779B97F4A7C15
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        m = max(n, 4096)
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _pow[name] = np.cumprod(p, dtype=np.uint64)
    return _pow["up"][:n], _pow["down"][:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def rolling(a: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every window of the given size."""
    n = len(a)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(a + np.uint64(1)) * up, out=s[1:])
    return mix64((s[size:] - s[:-size]) * down[: n - size + 1])


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of every run of width windows."""
    if len(h) < width:
        return np.empty(0, np.int64)
    at = sliding_window_view(h, width).argmin(1) + np.arange(len(h) - width + 1)
    return np.unique(at)


def _anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        hs, ps = [], []
        for text in b["text"]:
            h = rolling(codes(text), WINDOW)
            at = minima(h, MIN_SPAN - WINDOW + 1)
            hs.append(signed(h[at]))
            ps.append(at.astype(np.int32))
        yield pd.DataFrame({"id": b["id"], "digest": b["digest"], "h": hs, "pos": ps})


def _once(df: DataFrame) -> DataFrame:
    """One row per id; nothing is moved where no id is repeated."""
    many = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return df if many.isEmpty() else cut(df.dropDuplicates(["id"]))


def source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where((F.length("text") >= MIN_SPAN) & F.col("id").isNotNull())


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, h, pos): kept windows of every text; lineage is cut."""
    src = source(docs, key, text).withColumn("digest", F.md5("text"))
    return _once(cut(src.mapInPandas(_anchor, "id long, digest string, h array<long>, pos array<int>")))


def copies(at: DataFrame) -> DataFrame:
    """(id, rep) of the texts that have exact copies."""
    many = at.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return at.select("id", "digest").join(many, "digest").select("id", "rep")


def _window(positions: bool):
    reach = MIN_SPAN - WINDOW

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, ps = [], []
            for text, at in zip(b["text"], b["at"]):
                h = rolling(codes(text), MIN_SPAN)
                edge = np.zeros(len(h) + 1, np.int64)
                at = np.asarray(at, np.int64)
                np.add.at(edge, np.maximum(at - reach, 0), 1)
                np.add.at(edge, np.minimum(at + 1, len(h)), -1)
                w = np.flatnonzero(np.cumsum(edge[:-1]))
                hs.append(signed(h[w] if positions else np.unique(h[w])))
                ps.append(w.astype(np.int32))
            yield pd.DataFrame({"id": b["id"], "h": hs, "pos": ps} if positions else {"id": b["id"], "h": hs})

    return run


def windows(docs: DataFrame, at: DataFrame, key: str, text: str, positions: bool) -> DataFrame:
    """Hashes of all windows of MIN_SPAN around the repeated kept ones: an array
    for each text, with their positions or, without, each hash once."""
    many = at.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    occ = at.select("id", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("id", "x.h", "x.pos")
    near = occ.join(small(many), "h", "left_semi").groupBy("id").agg(F.collect_set("pos").alias("at"))
    src = source(docs, key, text).join(small(near, "24 + 4 * size(at)"), "id")
    return _once(cut(src.mapInPandas(_window(positions), "id long, h array<long>" + (", pos array<int>" if positions else ""))))


def links(docs: DataFrame, at: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_a, id_b): pairs of different texts that share a stretch."""
    more = copies(at).where("id <> rep").select("id")
    win = windows(docs, at.join(more, "id", "left_anti"), key, text, False).select("id", F.explode("h").alias("h"))
    sets = win.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("sig")).where("n > 1")
    one = sets.groupBy("n", "sig").agg(F.min("h").alias("h")).select("h")
    member = cut(win.join(small(one), "h", "left_semi").distinct())
    a, b = member.alias("a"), member.alias("b")
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")))
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_a, id_b) of all documents that share a stretch, copies included."""
    from .neardup import with_copies

    at = anchors(docs, key, text)
    return with_copies(links(docs, at, key, text), copies(at))


def members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rep): every text long enough and the one that stands for its copies."""
    at = anchors(docs, key, text)
    many = copies(at)
    return at.select("id").join(many, "id", "left").select(F.col("id").alias(key), F.coalesce("rep", "id").alias("rep"))


def intervals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end) of the maximal stretches of a document, in code points,
    each window of which stands in another document too."""
    win = windows(docs, anchors(docs, key, text), key, text, True)
    many = win.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    win = win.select("id", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("id", "x.h", "x.pos")
    hit = win.join(small(many), "h", "left_semi").select("id", "pos").distinct()
    w = Window.partitionBy("id").orderBy("pos")
    run = hit.withColumn("new", (F.col("pos") - F.lag("pos", 1, -(10**9)).over(w) > MIN_SPAN).cast("int")).withColumn("run", F.sum("new").over(w))
    return run.groupBy("id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + MIN_SPAN).alias("end")).drop("run")


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: code points shared with other documents and share."""
    got = intervals(docs, key, text).groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    n = F.length(text)
    return (
        docs.select(F.col(key).cast("long").alias("id"), F.coalesce(n, F.lit(0)).alias("n_chars"))
        .join(got, "id", "left")
        .select(
            F.col("id").alias(key),
            "n_chars",
            F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
            F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
            F.coalesce(F.round(F.try_divide("shared_chars", "n_chars"), 6), F.lit(0.0)).alias("shared_share"),
        )
    )
