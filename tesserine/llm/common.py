"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of letters and digits (``\p{L}``, ``\p{N}``).
WORD = re.compile(r"[^\W_]+")

#: Entries after which the per-worker word-hash cache starts afresh.
WORD_CACHE = 400_000

_cache: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Words of the lower-cased text, in order."""
    return WORD.findall(text.lower())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes up to which a measured table may be broadcast; larger ones are shuffled.
SMALL_BYTES = 8 << 20


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder that
    ``spark.checkpoint.dir`` names.  Without one only a local session, whose only
    machine this is, may go on."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="tesserine-ckpt-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def small(df: DataFrame, width: str | None = None) -> DataFrame:
    """``df``, cut from its lineage and measured: marked for broadcast if its
    rows times their bytes (``width``, 24 by default) stay within ``SMALL_BYTES``, left to
    a shuffle join beyond."""
    df = cut(df)
    size = df.agg(F.sum(F.expr(width) if width else F.lit(24)).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def word_hashes(ws: list[str]) -> np.ndarray:
    """A stable 64-bit hash of every word; hashes are cached per worker."""
    if len(_cache) > WORD_CACHE:
        _cache.clear()
    get = _cache.get
    out = [get(w) for w in ws]
    for i, h in enumerate(out):
        if h is None:
            w = ws[i]
            out[i] = _cache[w] = xxhash.xxh64_intdigest(w)
    return np.array(out, dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix64(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
