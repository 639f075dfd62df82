"""Length-delimited binary records with masked checksums and an offset index.

A record is: length (uint64), masked CRC of the length field (uint32), the
payload, masked CRC of the payload (uint32); all little-endian. The payload is
the row's id (int64; the smallest one for null), then its token ids as uint16
where the vocabulary fits, else uint32. The checksum is zlib's CRC-32 under the
usual rotate-and-add mask. (No CRC-32C library is at hand, so files are framed
like, but not checked like, the common record format.)

Beside ``shard-N.bin`` lies ``shard-N.idx`` with (id int64, offset uint64) of
each record and a last entry for the file's end: a shuffled reader seeks by it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyarrow import fs as pafs

from .bpe import json_cache
from .scratch import new_folder

MASK_ADD = 0xA282EAD8
NULL_ID = -(2**63)
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8")])


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, or None at a clean end; ValueError on damage."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record payload")
    return body[:n]


def read_at(uri: str, entries: list[int]) -> list[tuple[int, bytes]]:
    """Records of one shard by position, through its index: (id, payload)."""
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(path.removesuffix(".bin") + ".idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    out = []
    with store.open_input_file(path) as f:
        for k in entries:
            f.seek(int(index["offset"][k]))
            payload = read_frame(f)
            out.append((struct.unpack("<q", payload[:8])[0], payload[8:]))
    return out


def write_shards(df: DataFrame, tokenizer_path: str, end_id: int, out: str, vocab: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Encode every text, append ``end_id`` and write shards in ascending id order.

    One range shuffle by id; each range is sorted (by id, then text; nulls
    first) and becomes one shard, written to a name of its own attempt and then
    renamed: a retried or twice-run task replaces an equal file. Returns one
    manifest row per shard, in order. Null texts count as empty, null ids come
    first, ties keep all rows, an empty table writes nothing, and other columns are
    not read. A very long text is one record: memory is that of its ids.
    """
    wide = "<u2" if vocab <= 0x10000 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, cache = task.partitionId(), json_cache(tokenizer_path)
        store, folder = pafs.FileSystem.from_uri(out)
        name, tail = f"{folder}/shard-{shard:06d}", np.array([end_id], "<u4").tobytes()
        own = f"{folder}/_{task.taskAttemptId()}-{shard:06d}"
        store.create_dir(folder, recursive=True)
        index, at, tokens = [], 0, 0
        with store.open_output_stream(own + ".bin", buffer_size=1 << 20) as f:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    doc = doc.as_py()
                    ids = np.frombuffer(cache.text(text.as_py()) + tail, "<u4")
                    key = NULL_ID if doc is None else doc
                    record = frame(struct.pack("<q", key) + ids.astype(wide).tobytes())
                    f.write(record)
                    index.append((key, at))
                    at += len(record)
                    tokens += len(ids)
        if not index:
            store.delete_file(own + ".bin")
            return
        with store.open_output_stream(own + ".idx") as f:
            f.write(np.array([*index, (0, at)], INDEX).tobytes())
        for end in (".idx", ".bin"):
            store.move(own + end, name + end)
        row = [[shard], [f"{out}/shard-{shard:06d}.bin"], [len(index)], [tokens], [at]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["shard", "uri", "n_records", "n_tokens", "n_bytes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    shards = rows.mapInArrow(run, "shard long, uri string, n_records long, n_tokens long, n_bytes long")
    return sorted(shards.collect())  # one small row per file


def read_shards(spark, manifest: list, vocab: int, id_col: str = "doc_id") -> DataFrame:
    """Read the files back, checking every checksum and index entry.

    Per record: id, ``start`` (ids of all records before it in all shards),
    ``n_tokens`` with the end id, ``ids_crc32`` over ids as uint32.
    """
    wide = "<u2" if vocab <= 0x10000 else "<u4"
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    firsts = np.cumsum([0] + [r["n_tokens"] for r in manifest]).tolist()
    jobs = spark.createDataFrame([(r["shard"], r["uri"], firsts[k]) for k, r in enumerate(manifest)], "shard long, uri string, first long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path.removesuffix(".bin") + ".idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                rows = []
                with store.open_input_stream(path, buffer_size=1 << 20) as f:
                    place = 0
                    for entry in index[:-1]:
                        payload = read_frame(f)
                        key = struct.unpack("<q", payload[:8])[0]
                        if (key, place) != (int(entry["id"]), int(entry["offset"])):
                            raise ValueError(f"index and records differ in {uri}")
                        place += len(payload) + 16
                        ids = np.frombuffer(payload, wide, offset=8)
                        rows.append((None if key == NULL_ID else key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 20_000:
                            yield as_batch(rows)
                            rows = []
                    if read_frame(f) is not None:
                        raise ValueError(f"records beyond the index in {uri}")
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list) -> pa.RecordBatch:
        cols = [pa.array(x, pa.int64()) for x in zip(*rows)]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32"])

    return jobs.repartition(len(manifest)).mapInArrow(run, schema)


def token_records(df: DataFrame, tokenizer_path: str, end_id: int, vocab: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus as record shards under ``out`` and return what they hold."""
    spark = df.sparkSession
    out = out or new_folder(spark, "records")
    return read_shards(spark, write_shards(df, tokenizer_path, end_id, out, vocab, id_col, text_col), vocab, id_col)
