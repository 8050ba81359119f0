"""Pluggable text encoders. The built-in one hashes words, so that everything around an encoder runs without a model file."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import estimate_tokens, passage_prefix, query_prefix
from folioscan.operators.chunking import BUCKETS


class Encoder(Protocol):
    name: str
    dims: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit rows, one for each text."""


@dataclass(frozen=True)
class HashingEncoder:
    """Signed word counts in `dims` buckets, at unit length; a text without words is the first axis."""

    dims: int = 64
    name: str = "hashing"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % self.dims] += 1 if h >> 31 else -1
            if not row.any():
                row[0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def encode_query(encoder: Encoder, query: str) -> list[float]:
    return [float(x) for x in encoder.encode([query_prefix(encoder.name) + query])[0]]


def batches(n_tokens: list[int]) -> list[list[int]]:
    """Places of texts by length, in batches no larger than their bucket allows; beyond the last bucket one by one."""
    out: list[list[int]] = []
    before = None
    for i in sorted(range(len(n_tokens)), key=n_tokens.__getitem__):
        most, size = next(((m, k) for m, k in BUCKETS if n_tokens[i] <= m), (None, 1))
        if not out or before != most or len(out[-1]) >= size:
            out.append([])
        out[-1].append(i)
        before = most
    return out


def encode_passages(rows: DataFrame, encoder: Encoder, text_col: str = "text", bucketed: bool = False) -> DataFrame:
    """The rows with their embedding.

    `bucketed` deals rows of like length to like tasks, and the encoder gets them shortest first in batches of their
    bucket's size, which keeps a model's padding and its memory low.
    """
    if bucketed:
        rows = rows.repartitionByRange(estimate_tokens(F.coalesce(text_col, F.lit(""))))

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        prefix = passage_prefix(encoder.name)
        texts = [prefix + (t or "") for t in text]
        if not bucketed:
            return pd.Series(list(encoder.encode(texts)) if texts else [])
        out: list = [None] * len(texts)
        for part in batches([max(1, len(t) // 4) for t in texts]):
            for i, vector in zip(part, encoder.encode([texts[i] for i in part]), strict=True):
                out[i] = vector
        return pd.Series(out)

    return rows.withColumn("embedding", run(F.col(text_col)))
