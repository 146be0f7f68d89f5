"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Pre-token pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The byte-pair encoding of a rank file, loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n) of every text that isn't blank; lineage is cut."""
    path = os.path.join(folder, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t and not t.isspace() else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n": np.array(n, np.int64)})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text").where("text <> '' and doc_id is not null")
    return cut(src.mapInPandas(run, "doc_id long, source string, n long").where("n > 0"))
