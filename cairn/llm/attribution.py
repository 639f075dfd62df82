"""Token counts by section: encode a document once, join token spans to sections.

Byte-level tokens tile the text's bytes, so their spans are the running sum of
token widths. Both token spans and sections are ordered, so the interval join
is a pair of binary searches a section.

Rules for a token that crosses a section's boundary: ``start`` (it belongs where
it begins), ``end`` (where its last byte lies), ``fraction`` (to each section by
its share of bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import rank_cache

RULES = ("start", "end", "fraction")


def line_spans(text: str) -> list[tuple[str, int, int]]:
    """Each line with its line feed, in characters."""
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            out.append((f"line{k}", at, end))
        at = end
    return out


def byte_places(text: str) -> np.ndarray | None:
    """Byte offset of each character and of the end; None for ASCII, where they are equal."""
    if text.isascii():
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def allocate(widths: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each byte span under ``rule``, and the tokens that cross its edges."""
    edge = np.append(0, np.cumsum(widths))
    total = float(edge[-1])
    begin, end = np.clip(begin, 0, total), np.clip(end, 0, total)
    first, last = edge[:-1], edge[1:]
    if rule == "start":
        count = (np.searchsorted(first, end) - np.searchsorted(first, begin)).astype(float)
    elif rule == "end":
        count = (np.searchsorted(last, end, "right") - np.searchsorted(last, begin, "right")).astype(float)
    elif rule == "fraction":
        place = np.arange(len(edge), dtype=float)
        count = np.interp(end, edge, place) - np.interp(begin, edge, place) if len(widths) else np.zeros(len(begin))
    else:
        raise ValueError(f"rule is one of {RULES}")
    cut = np.isin([begin, end], edge, invert=True).sum(axis=0)
    return np.where(end > begin, count, 0.0), np.where(end > begin, cut, 0)


SCHEMA = "doc_id long, section string, begin long, end long, n_tokens double, n_crossing int, doc_tokens long"


def attribute_tokens(df: DataFrame, rank_path: str, pattern: str, rule: str = "start", spans_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section.

    Sections are those of ``spans_col`` (array of struct<name, begin, end> in
    characters, which may overlap or leave gaps), else the lines. A document
    without a section (null or empty text, null array) gets one row with a null
    section and no tokens allocated. Spans are clipped to the text; a null bound is
    the text's begin or end, a null span none, a null name stays null. Rows repeat as
    in ``df``, an empty table gives an empty one, and other columns are not read. A map
    over the scan: no shuffle; memory is that of one text's tokens and spans.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = rank_cache(rank_path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = text.as_py() or ""
                spans = line_spans(text) if spans_col is None else [(s["name"], 0 if s["begin"] is None else s["begin"], len(text) if s["end"] is None else s["end"]) for s in batch.column(2)[k].as_py() or [] if s]
                widths = cache.widths[np.frombuffer(cache.text(text), "<u4")]
                if not spans:
                    rows.append((doc, None, None, None, 0.0, 0, len(widths)))
                    continue
                at = np.clip(np.array([s[1:] for s in spans], np.int64), 0, len(text))
                places = byte_places(text)
                count, cut = allocate(widths, *(at if places is None else places[at]).T, rule)
                rows += [(doc, name, b, e, c, x, len(widths)) for (name, _, _), (b, e), c, x in zip(spans, at.tolist(), count.tolist(), cut.tolist())]
                if len(rows) > 20_000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else [])]
    return df.select(*cols).mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
