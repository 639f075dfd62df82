"""Token-bounded, section-aware chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP_TOKENS = 500, 50
CHUNK = "doc long, section int, piece int, content string, section_heading string, page_number int, page_end int, token_count int, char_count int, has_list boolean, is_continuation boolean"
COUNTERS: dict[str, Callable[[str], int]] = {"whitespace": lambda text: len(text.split())}


def split_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text.strip())) if s]


def split_words(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Greedy runs of words within ``limit`` tokens; one over-long word stands alone."""
    out: list[str] = []
    for word in text.split():
        if out and count(f"{out[-1]} {word}") <= limit:
            out[-1] += f" {word}"
        else:
            out.append(word)
    return out


class SectionSplitter:
    """Cuts one section that exceeds the limit, carrying whole sentences over."""

    def __init__(self, heading: str, pages: tuple[int, int], limit: int, overlap: int, count: Callable[[str], int]) -> None:
        self.count, self.limit, self.span = count, limit, pages
        self.prefix = f"[{heading}]\n" if heading and heading != "Preamble" else ""
        self.space = limit - count(self.prefix)
        self.room = max(1, self.space)
        self.overlap = min(overlap, self.room // 5)
        self.out: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.size, self.pages, self.listed = 0, set(), False

    def carried(self) -> str:
        """Whole sentences from the end of what is held, within the overlap."""
        kept: list[str] = []
        total = 0
        for sentence in reversed([s for part in self.parts for s in split_sentences(part)]):
            total += self.count(sentence)
            if total > self.overlap:
                break
            kept.insert(0, sentence)
        return " ".join(kept)

    def flush(self, carry: bool) -> None:
        if not self.parts:
            return
        text = (self.prefix + "\n\n".join(self.parts).strip()).strip()
        self.out.append((text, min(self.pages, default=self.span[0]), max(self.pages, default=self.span[1]), self.listed))
        seed = self.carried() if carry else ""
        self.parts = [seed] if seed and self.count(seed) <= self.overlap else []
        self.size = self.count(seed) if self.parts else 0
        self.pages, self.listed = set(), False

    def make_room(self, n: int) -> None:
        """Hand out what is held if ``n`` more tokens do not fit; the overlap goes too if they still do not."""
        if self.parts and self.size + n > self.space:
            self.flush(True)
            if self.size + n > self.space:
                self.parts, self.size = [], 0

    def add(self, text: str, page: int | None, listed: bool) -> None:
        n = self.count(text)
        self.make_room(n)
        self.parts.append(text)
        self.size += n
        if page:
            self.pages.add(page)
        self.listed |= listed

    def split(self, blocks: list[dict]) -> list[tuple[str, int, int, bool]]:
        for b in blocks:
            listed, content = b["block_type"] == "list_item", b["content"].strip()
            if not content:
                continue
            n = self.count(content)
            if n <= self.room:
                self.add(content, b["page"], listed)
                continue
            self.make_room(n)
            for sentence in split_sentences(content):
                pieces = [sentence] if self.count(sentence) <= self.room else split_words(sentence, self.room, self.count)
                for piece in pieces:
                    self.add(piece, b["page"], listed)
        self.flush(False)
        return self.out


def chunk_sections(sections: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, counter: str = "whitespace") -> DataFrame:
    """Chunks of ``sections`` (see the structure operator), numbered within each section.

    A map over sections: no shuffle. A section within the limit is one chunk with
    its heading; a larger one is cut at blocks, sentences, then words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = COUNTERS[counter]
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                blocks = list(r.blocks)
                if not r.full_text.strip():
                    continue
                if count(r.full_text) <= max_tokens:
                    found = [(r.full_text, r.page_start, r.page_end, any(b["block_type"] == "list_item" for b in blocks))]
                else:
                    found = SectionSplitter(r.heading, (r.page_start, r.page_end), max_tokens, overlap_tokens, count).split(blocks)
                rows += [(r.doc, r.section, k, text, r.heading, a, z, count(text), len(text), listed, k > 0) for k, (text, a, z, listed) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK.split(", ")])

    cols = sections.select(F.col("doc").cast("long"), F.col("section").cast("int"), "heading", "page_start", "page_end", "blocks", "full_text")
    return cols.mapInPandas(run, CHUNK)


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with ``chunk_index``, counted from 0 through a document's sections."""
    order = W.partitionBy("doc").orderBy("section", "piece")
    return chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))


def chunk_text(df: DataFrame, id_col: str, text_col: str, chunk_size: int = 1000) -> DataFrame:
    """Plain-text entry: page 1, a quarter of ``chunk_size`` (100 at least) tokens a chunk."""
    from .structure import sections

    pages = df.select(F.col(id_col).cast("long").alias("doc"), F.lit(1).alias("page"), F.col(text_col).alias("text"))
    return chunk_sections(sections(pages), max(100, chunk_size // 4))
