"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import rank_cache


def encode_ids(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for every row.

    Null and empty texts give an empty array. Repeated rows and ids pass
    through; other columns of ``df`` are not read. One map over the scan: no
    shuffle, memory bounded by one Arrow batch and one text's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache = rank_cache(rank_path, pattern)
        for batch in batches:
            packed = [cache.text(x.as_py()) for x in batch.column(1)]
            ends = np.cumsum([0] + [len(x) // 4 for x in packed]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, raw binary)``: the bytes of the ids; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_cache(rank_path, pattern).codec
        for batch in batches:
            raw = [None if x is None else codec.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, raw binary")
    return out.withColumnRenamed("id", id_col)


def round_trip_digest(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and return digests.

    ``n_tokens``, ``ids_sha256`` (ids as little-endian uint32), and
    ``decoded_sha256`` of the bytes the ids decode to. Null counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = rank_cache(rank_path, pattern)
        for batch in batches:
            count, ids, raw = [], [], []
            for text in batch.column(1):
                packed = cache.text(text.as_py())
                count.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                raw.append(hashlib.sha256(cache.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = out.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
