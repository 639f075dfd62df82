"""Byte-pair encoding of whole texts, piece by piece.

A text is cut only where the tokenizer's own split pattern always has a
boundary: before a single space, or around a single line feed, that stands
between two characters which are not white space; and, in Latin-1 text without
apostrophes, between letters and other characters. The pieces then encode
independently, so the ids of a piece are looked up in a bounded cache and only
unseen pieces reach the tokenizer library. Text without such places (long runs
of white space, unusual white space) goes to the library in larger pieces.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space, by any engine's reckoning, other than space and line feed; and two
#: invisible characters that some engines have counted as white space.
OTHER_SPACE = "".join(map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
ODD = re.compile(f"[{OTHER_SPACE}]")
WORDS = re.compile(r"\n| ?[^ \n]+")
BARE = re.compile(r"[^ \n]+")
SAFE = re.compile(rf"(?<=[^\s{OTHER_SPACE}])(?= [^\s{OTHER_SPACE}])")
#: All letters of Latin-1. A run of them is one pretoken where there is no apostrophe,
#: and so is all that lies between such runs a safe piece.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
KINDS = re.compile(rf" ?[{LETTERS}]+| ?[^ \n{LETTERS}]+|\n")
BARE_KINDS = re.compile(rf"[{LETTERS}]+|[^ \n{LETTERS}]+")
#: A Latin-1 word with its trailing marks: the same pretokens for any Unicode version.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Runs of white space that would exhaust the library's backtracking pattern engine.
LONG_RUN = 4096
RUNS = re.compile("[\t-\r \x85\xa0%s]{%d,}" % ("".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))), LONG_RUN))
#: Longer pieces are encoded each time.
LONGEST_CACHED = 64


def is_regular(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    return bool(text) and not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text
        or "\n " in text or "\n\n" in text or ODD.search(text)
    )


def by_kind(text: str) -> bool:
    """Whether letters and other characters may be encoded apart: Latin-1 without apostrophes."""
    if "'" in text:
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def pieces(text: str) -> list[str]:
    """Cut ``text`` at safe boundaries; the pieces joined give ``text``."""
    if not text:
        return []
    if not is_regular(text):
        return SAFE.split(text)
    return (KINDS if by_kind(text) else WORDS).findall(text)


class PieceCache(dict):
    """Piece to packed little-endian uint32 ids; two generations of ``limit`` pieces."""

    def __init__(self, limit: int = 250_000) -> None:
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST_CACHED:
            return self.encode(piece)
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got

    def encode(self, piece: str) -> bytes:
        raise NotImplementedError

    def text(self, text: str | None) -> bytes:
        """Packed ids of a whole text; null counts as empty."""
        return b"".join(map(self.__getitem__, pieces(text))) if text else b""


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=None)
def byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for each byte, by rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class RankCache(PieceCache):
    """tiktoken with a local rank file, no special tokens."""

    def __init__(self, path: str, pattern: str, limit: int = 250_000) -> None:
        super().__init__(limit)
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.codec = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, k in ranks.items():
            self.widths[k] = len(word)

    def encode(self, piece: str) -> bytes:
        if len(piece) < LONG_RUN:
            return pack(self.codec.encode_ordinary(piece))
        out, at = [], 0
        for run in RUNS.finditer(piece):
            # The pattern takes a run but for its last character, which may lead the next word.
            end = run.end() - (run.end() < len(piece))
            out += [pack(self.codec.encode_ordinary(piece[at : run.start()])), pack(self.codec._encode_single_piece(piece[run.start() : end]))]
            at = end
        return b"".join([*out, pack(self.codec.encode_ordinary(piece[at:]))])

    def decode(self, packed: bytes) -> bytes:
        """Raw bytes: a text cut inside a character still decodes losslessly."""
        return self.codec.decode_bytes(np.frombuffer(packed, "<u4").tolist())


class JsonCache(PieceCache):
    """A tokenizers file; byte-level, with or without word ends.

    Plain Latin words go straight to the library's BPE model; all else goes
    through its whole chain of normalizer, splitter and model.
    """

    def __init__(self, path: str, word_ends: bool = False, limit: int = 250_000) -> None:
        super().__init__(limit)
        from tokenizers import Tokenizer

        self.codec = Tokenizer.from_file(path)
        self.codec.encode_special_tokens = True
        self.model, self.word_ends = self.codec.model, word_ends
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.letters = str.maketrans(self.letters)

    def encode(self, piece: str) -> bytes:
        plain = PLAIN.fullmatch(piece)
        if not plain:
            return array("I", self.codec.encode(piece, add_special_tokens=False).ids).tobytes()
        word, marks = plain.groups()
        if marks:
            return self[word] + self[marks]
        if self.word_ends:
            word = word.lstrip().lower()
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.word_ends and not ODD.search(text):
            found = BARE_KINDS.findall(text.lower()) if by_kind(text) else BARE.findall(text)
            return b"".join(map(self.__getitem__, found))
        return b"".join(map(self.__getitem__, pieces(text)))


@lru_cache(maxsize=4)
def rank_cache(path: str, pattern: str) -> RankCache:
    """One per worker process, kept across its tasks."""
    return RankCache(path, pattern)


@lru_cache(maxsize=4)
def json_cache(path: str, word_ends: bool = False) -> JsonCache:
    return JsonCache(path, word_ends)
