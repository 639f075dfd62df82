"""Order-preserving packing by dynamic programming.

The token stream of a scan partition, in stored order, is cut into windows of
at most ``window`` tokens. Cuts lie at document ends (free), at sentence ends
(``sentence_cost`` each) or, where neither is near, anywhere (``hard_cost``).
With f(j) the least cost of cutting everything before j,

    f(j) = cost(j) + min over i, 0 < j - i <= window, of f(i) + padding(j - i)

and padding(L) = window - L, or 0 where L is a power of two. As padding is
linear, the minimum is that of f(i) + i over a sliding window: a monotone queue
gives it in constant time. Lengths that are powers of two are extra transitions.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import JsonCache, json_cache

#: Tokens planned at once; bounds memory whatever the partition's size.
BLOCK = 1 << 20
SHIFT = 36


def plan_cuts(pos: np.ndarray, cost: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """f and the best predecessor for each candidate position.

    ``pos`` ascends from 0 in steps of at most ``window``; ``cost`` is that of
    cutting there (0 at position 0).
    """
    n = len(pos)
    links: list[list[int]] = [[] for _ in range(n)]
    k = 1
    while k <= window:
        at = np.searchsorted(pos, pos - k)
        hit = np.flatnonzero((pos >= k) & (pos[np.minimum(at, n - 1)] == pos - k))
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            links[j].append(i)
        k *= 2
    p, c = pos.tolist(), cost.tolist()
    f, back = [0.0] * n, [-1] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        low = p[j] - window
        while p[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        best += window - p[j]
        for x in links[j]:
            if f[x] < best:
                best, i = f[x], x
        f[j], back[j] = best + c[j], i
        key = f[j] + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    return np.array(f), np.array(back)


@lru_cache(maxsize=4)
def tail_table(window: int, hard_cost: float) -> tuple[list[float], list[int]]:
    """Least cost of the stream's last L tokens, and the first piece's length.

    They go into one padded sequence or into several of power-of-two lengths.
    """
    cost, first = [0.0] * (window + 1), [0] * (window + 1)
    for n in range(1, window + 1):
        cost[n], first[n] = (0.0 if n & (n - 1) == 0 else float(window - n)), n
        k = 1
        while k < n:
            if hard_cost + cost[n - k] < cost[n]:
                cost[n], first[n] = hard_cost + cost[n - k], k
            k *= 2
    return cost, first


def candidates(ends: np.ndarray, stops: np.ndarray, total: int, window: int, gap: int, sentence_cost: float, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, with costs: 0, document ends, the last
    sentence end of each ``gap`` tokens, and hard cuts where these are too far apart."""
    if len(stops):
        stops = stops[np.append(stops[1:] // gap != stops[:-1] // gap, True)]
    pos = np.concatenate([[0], ends, stops, [total]]).astype(np.int64)
    cost = np.concatenate([[0.0], np.zeros(len(ends)), np.full(len(stops), sentence_cost), [sentence_cost]])
    order = np.lexsort((cost, pos))
    pos, cost = pos[order], cost[order]
    keep = np.append(True, pos[1:] != pos[:-1])
    pos, cost = pos[keep], cost[keep]
    far = np.flatnonzero(np.diff(pos) > window)
    if len(far):
        extra = np.concatenate([np.arange(pos[i] + window, pos[i + 1], window) for i in far])
        pos, cost = np.concatenate([pos, extra]), np.concatenate([cost, np.full(len(extra), hard_cost)])
        order = np.argsort(pos, kind="stable")
        pos, cost = pos[order], cost[order]
    return pos, cost


class Packer:
    """Collects documents, plans a block at a time and yields pieces."""

    def __init__(self, window: int, gap: int, sentence_cost: float, hard_cost: float, stop_ids: np.ndarray, first_sequence: int) -> None:
        self.window, self.gap, self.sentence_cost, self.hard_cost = window, gap, sentence_cost, hard_cost
        self.stop_ids, self.sequence = stop_ids, first_sequence
        self.ids, self.docs, self.size = [], [], 0  # docs: (id, first position, tokens)

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc, self.size, len(ids)))
        self.ids.append(ids)
        self.size += len(ids)
        return self.cut(False) if self.size >= BLOCK else []

    def cut(self, last: bool) -> list[tuple]:
        """Plan what is held; keep the unfinished end unless it is the last call."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        starts = np.array([d[1] for d in self.docs], np.int64)
        lengths = np.array([d[2] for d in self.docs], np.int64)
        ends = starts + lengths
        stops = np.flatnonzero(self.stop_ids[ids]) + 1
        pos, cost = candidates(ends, stops, self.size, self.window, self.gap, self.sentence_cost, self.hard_cost)
        f, back = plan_cuts(pos, cost, self.window)
        near = np.flatnonzero(pos >= self.size - self.window)
        tail, first = tail_table(self.window, self.hard_cost)
        if last:
            j = min(near.tolist(), key=lambda i: f[i] + tail[self.size - int(pos[i])])
        else:
            j = min(near.tolist(), key=lambda i: (f[i], -i))
        cuts = []
        k = j
        while k > 0:
            cuts.append(int(pos[k]))
            k = int(back[k])
        cuts = [0, *reversed(cuts)]
        if last:
            while cuts[-1] < self.size:
                cuts.append(cuts[-1] + first[self.size - cuts[-1]])
        out = self.pieces(ids, starts, lengths, np.array(cuts, np.int64))
        done = cuts[-1]
        self.sequence += len(cuts) - 1
        rest = int(np.searchsorted(ends, done, "right"))
        self.docs = [(d, s - done, n) for d, s, n in self.docs[rest:]]
        self.ids = [ids[done:].copy()] if done < self.size else []
        self.size -= done
        return out

    def pieces(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cuts: np.ndarray) -> list[tuple]:
        edges = np.union1d(cuts, starts[(starts > 0) & (starts < cuts[-1])])
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(starts, a, "right") - 1
        seq = np.searchsorted(cuts, a, "right") - 1
        raw = ids.astype("<u4").data.cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(a.tolist(), b.tolist())]
        names = [self.docs[i][0] for i in doc.tolist()]
        return list(zip(names, (a - starts[doc]).tolist(), (b - a).tolist(), crc, lengths[doc].tolist(), (seq + self.sequence).tolist(), (a - cuts[seq]).tolist(), np.diff(cuts)[seq].tolist()))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def sentence_stops(cache: JsonCache, marks: str = ".!?") -> np.ndarray:
    """Which ids end a sentence: those whose last character is one of ``marks``."""
    vocab = cache.codec.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for word, k in vocab.items():
        word = word.removesuffix("</w>")
        out[k] = bool(word) and word[-1] in marks
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, gap: int = 32, sentence_cost: float = 4.0, hard_cost: float = 16.0, word_ends: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; one row per piece.

    No shuffle: each scan partition is packed in its stored order, so a hot
    source, key or group of copies weighs no more than its bytes, and a retried
    task repeats the same plan. Padding at a partition's end is cut into
    power-of-two sequences. Null and empty texts are documents of one token
    (the end id). Repeated rows and null ids are packed each on its own; equal plans
    by cost are decided by position. Very long texts are cut like others: a block of
    tokens is planned at once and its open end carried on. An empty table gives an
    empty one. Other columns of ``df`` are not read. ``gap``: of several sentence ends
    within so many tokens only the last is a place to cut; document ends all are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = json_cache(tokenizer_path, word_ends)
        tail = np.array([end_id], "<u4").tobytes()
        packer = Packer(window, gap, sentence_cost, hard_cost, sentence_stops(cache), TaskContext.get().partitionId() << SHIFT)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if out := packer.add(doc.as_py(), np.frombuffer(cache.text(text.as_py()) + tail, "<u4")):
                    yield as_batch(out)
        if out := packer.cut(True):
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
