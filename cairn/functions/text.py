"""Text functions as native column expressions.

``(?U)`` makes white space and word boundaries Unicode-aware; ``(?d)`` leaves the
line feed as the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bullet glyphs at a line's start that become "- " (fixed values).
BULLETS = r"\x{FFFD}\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}\x{25AA}\x{25AB}\x{00B7}\x{25BA}\x{203A}"


#: White space of Unicode, as ``(?U)\s`` has it (fixed values).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without outer white space; a trim looks at a text's ends, a pattern at all of it."""
    return F.btrim(c, F.lit(BLANKS))


def dehyphenate(c: Column) -> Column:
    """Join words broken over lines: syllables without, compounds with the hyphen."""
    c = F.regexp_replace(c, r"(?U)(\b[A-Za-z]+)-\s*\n\s*([a-z]+[A-Za-z]*\b)", "$1$2")
    return F.regexp_replace(c, r"(?U)(\b[A-Za-z0-9]+)-\s*\n\s*([A-Za-z0-9]+\b)", "$1-$2")


def clean(c: Column) -> Column:
    """Line ends, bullets, broken words, runs of blanks, outer white space; null gives ""."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"(?Umd)^\s*[{BULLETS}]\s*", "- ")
    c = F.regexp_replace(dehyphenate(c), r"[ \t]{2,}", " ")
    return strip(c)


def sanitize(c: Column) -> Column:
    """Drop characters that do not print (but line feed and tab); at most one empty line."""
    c = F.regexp_replace(strip(c), r"[\p{C}\p{Z}&&[^ \n\t]]", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    parts = F.split(strip(c), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def dedup_key(c: Column) -> Column:
    """SHA-256 of the text in lower case with white space as single blanks."""
    return F.sha2(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), 256)


def token_count(c: Column) -> Column:
    """White-space tokens: the offline stand-in for a BPE count.

    Each word shrinks to its first character, so none is copied into an array.
    """
    return F.char_length(F.regexp_replace(c, r"(?U)(\S)\S*\s*|\s+", "$1"))


def is_trivial(c: Column, tokens: Column) -> Column:
    return (F.char_length(c) < 15) | (tokens < 4)


def is_noise(c: Column) -> Column:
    """Scanner noise, judged from 40 characters on."""
    n, n_words = F.char_length(c), token_count(c)
    letters = F.char_length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    unknown = n - F.char_length(F.replace(c, F.lit("\ufffd")))
    single = F.regexp_count(c, F.lit(r"(?U)(?<!\S)\p{L}(?!\S)"))
    spaced = (n_words >= 20) & (single / n_words > 0.40)
    return (n >= 40) & ((unknown >= 3) | (letters / n < 0.35) | F.coalesce(spaced, F.lit(False)))


def is_broken(c: Column) -> Column:
    """Whether the body behind a "[heading] " ends inside a hyphenated word."""
    c = strip(c)
    body = F.regexp_replace(c, r"^\[[^\]\n]{1,120}\]\s+", "")
    return F.endswith(c, F.lit("-")) & F.regexp_like(body, F.lit(r"[A-Za-z0-9]-$"))


def stitch(pages: Column) -> Column:
    """Clean ``array<struct<page:int,text:string>>`` and rejoin words cut by a page's end.

    The word's rest leaves the next page; a lower-case rest joins without the
    hyphen. Blank pages go; next to one nothing is joined.
    """
    tail, head = r"(?U)(\b[A-Za-z]+)-\s*$", r"(?U)^\s*([A-Za-z]+)\b"
    kind = "array<struct<page:int,text:string>>"
    cleaned = F.transform(pages, lambda p: F.struct(p.getField("page").cast("int").alias("page"), clean(p.getField("text")).alias("text")))
    first = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<page:int,text:string>").alias("held"))

    def step(state: Column, page: Column) -> Column:
        held = state.getField("held")
        before, after = held.getField("text"), page.getField("text")
        joins = F.coalesce(before.rlike(tail) & after.rlike(head), F.lit(False))
        word = F.regexp_extract(after, head, 1)
        link = F.when(word.rlike("^[a-z]"), F.lit("")).otherwise(F.lit("-"))
        left = F.when(joins, F.concat(F.regexp_replace(before, r"(?U)-\s*$", ""), link, word)).otherwise(before)
        right = F.when(joins, strip(F.regexp_replace(after, head, ""))).otherwise(after)
        keep = F.when(F.coalesce(left, F.lit("")) != "", F.array(F.struct(held.getField("page").alias("page"), left.alias("text")))).otherwise(F.array().cast(kind))
        return F.struct(F.concat(state.getField("done"), keep).alias("done"), F.struct(page.getField("page").alias("page"), right.alias("text")).alias("held"))

    def finish(state: Column) -> Column:
        held = state.getField("held")
        return F.when(F.coalesce(held.getField("text"), F.lit("")) != "", F.concat(state.getField("done"), F.array(held))).otherwise(state.getField("done"))

    return F.aggregate(cleaned, first, step, finish)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, accumulated in double; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def require_dimension(c: Column, n: int) -> Column:
    return F.when(F.size(c) == n, c).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} dimensions, got "), F.size(c).cast("string"))))
