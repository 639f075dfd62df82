"""Word shingles of texts as sets of 64-bit keys, computed column-wise.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A
word's key mixes its length and its bytes, eight at a time; each step mixes all
bits before the next eight bytes enter, so no algebraic relation between words
carries over to keys. Words over LONGEST bytes are keyed by BLAKE2b. A shingle's
key folds the keys of its words. Equal shingles have equal keys; two different
ones share a key with a chance of 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MIX = np.uint64(0xD6E8FEB86659FD93)
STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20
LONGEST = 256
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Keeps the first k bytes of a little-endian word.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MIX
    x = (x ^ (x >> U(29))) * MIX
    return x ^ (x >> U(32))


def word_keys(data: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words in ``data``, and where each document's words begin.

    ``doc_at``: the documents' byte offsets with the end; words do not span them.
    """
    inside = ~SPACE[data]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    edges = doc_at[(doc_at > 0) & (doc_at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    low = np.append(LOWER[data], np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    size = ends - starts
    keys = size.astype(U) * STEP
    live, k = np.arange(len(starts)), 0
    while len(live):
        keys[live] = mix(keys[live] + STEP) ^ (eights[starts[live] + k] & KEEP[np.minimum(size[live] - k, 8)])
        k += 8
        live = live[(size[live] > k) & (size[live] <= LONGEST)]
    for i in np.flatnonzero(size > LONGEST).tolist():
        keys[i] = long_word(data[starts[i] : ends[i]])
    return mix(keys), np.searchsorted(starts, doc_at)


def long_word(data: np.ndarray) -> np.uint64:
    """The unmixed key of one word longer than LONGEST bytes."""
    return U(int.from_bytes(hashlib.blake2b(LOWER[data].tobytes(), digest_size=8).digest(), "little"))


def long_text(data: np.ndarray) -> np.ndarray:
    """Word keys of one text longer than CHUNK bytes, cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the chunk
                rest = np.flatnonzero(SPACE[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
                out.append(word_keys(data[at:end], np.array([0, end - at]))[0])
                at = end
                continue
        out.append(word_keys(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Keys of all runs of ``width`` words."""
    n = len(words) - width + 1
    key = words[:n] + U(width)
    for j in range(1, width):
        key = mix(key) + words[j : n + j]
    return mix(key)


def as_set(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    return np.unique(fold(words, min(width, len(words))))


def ordered_set(words: np.ndarray, width: int, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set of shingle keys by the levels of their words, then by key.

    ``common``: sorted keys of words with a ``level``; other words have level 0.
    """
    if not len(words) or not len(common):
        return as_set(words, width)
    width = min(width, len(words))
    at = np.minimum(np.searchsorted(common, words), len(common) - 1)
    own = np.where(common[at] == words, level[at], 0).astype(np.int16)
    total = own[: len(words) - width + 1].copy()
    for j in range(1, width):
        total += own[j : len(words) - width + 1 + j]
    keys, first = np.unique(fold(words, width), return_index=True)
    return keys[np.argsort(total[first], kind="stable")]


def batch_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word keys of each text of an Arrow string column; null is empty."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        if at[end] - at[k] > CHUNK:  # then it is a single long text
            yield long_text(data[at[k] : at[end]])
        else:
            words, first = word_keys(data[at[k] : at[end]], at[k : end + 1] - at[k])
            for i in range(end - k):
                yield words[first[i] : first[i + 1]]
        k = end


def batch_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle keys of each text."""
    for words in batch_words(column):
        yield as_set(words, width)
