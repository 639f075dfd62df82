"""Embedding column: a pluggable model, and a deterministic stand-in for offline use."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import require_dimension

DIMENSIONS = 768


def hashed_model(texts: list[str]) -> list[list[float]]:
    """Signed word hashes, unit norm. It has no semantics."""
    out = []
    for text in texts:
        v = np.zeros(DIMENSIONS)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % DIMENSIONS] += 1 if h >> 63 else -1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def embed(df: DataFrame, text: Column, model: Callable[[list[str]], list[list[float]]] = hashed_model, at_once: int = 1, per_call: int = 256) -> DataFrame:
    """Add ``embedding``; a wrong length fails the query. Row order never matters.

    The model gets at most ``per_call`` texts a call. For a remote model ``at_once``
    calls of a task may run side by side; vectors come back in the texts' order.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                texts = batch.fillna("").tolist()
                calls = [texts[k : k + per_call] for k in range(0, len(texts), per_call)]
                vectors = pool.map(model, calls) if at_once > 1 else map(model, calls)
                yield pd.Series([v for call in vectors for v in call])

    return df.withColumn("embedding", require_dimension(run(text), DIMENSIONS))
