"""Document structure by windows: headings open sections, lists stay lists to the paragraph's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text import strip

# The line patterns of the parser.
MARKDOWN = r"^(#{1,6})\s+(.+)$"
NUMBERED = r"(?i)^(?:(?:SECTION|CHAPTER|PART)\s+\d+|\d+(?:\.\d+)*)\s+([A-Z0-9].{2,80})$"
CAPITALS = r"^[A-Z0-9\s&/\-,:|]{3,65}$"
BULLET_ITEM = r"^[-*\x{2022}\x{25AA}\x{25AB}\x{25BA}\x{203A}]\s+(.+)$"
NUMBERED_ITEM = r"^(\d+|[a-zA-Z])[.)]\s+(.+)$"


def heading_level(line: Column) -> Column:
    """0: not a heading; Markdown gives its own level, other headings 1."""
    n = F.char_length(line)
    return (
        F.when((n == 0) | (n > 85), 0)
        .when(line.rlike(MARKDOWN), F.char_length(F.regexp_extract(line, MARKDOWN, 1)))
        .when(line.rlike(r"[.,;:?!]$") | line.rlike(r"[|@]|https?://"), 0)
        .when(line.rlike(NUMBERED), 1)
        .when(line.rlike(CAPITALS) & (F.char_length(F.regexp_replace(line, "[^A-Z]", "")) >= 3), 1)
        .otherwise(0)
        .cast("int")
    )


def heading_title(line: Column) -> Column:
    return F.when(line.rlike(MARKDOWN) & (F.char_length(line) <= 85), F.regexp_extract(line, MARKDOWN, 2)).otherwise(line)


def is_list_line(line: Column) -> Column:
    return line.rlike(BULLET_ITEM) | line.rlike(NUMBERED_ITEM)


def lines(pages: DataFrame) -> DataFrame:
    """``(doc, page, text)`` to non-blank stripped lines with paragraph and line numbers."""
    paras = pages.select("doc", "page", F.posexplode(F.split("text", r"(?U)\n\s*\n")).alias("para", "body"))
    rows = paras.select("doc", "page", "para", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", strip(F.col("line"))).where("line <> ''")
    return rows.withColumn("level", heading_level(F.col("line"))).withColumn("is_list", is_list_line(F.col("line")))


def section_lines(pages: DataFrame) -> DataFrame:
    """Lines with their section number: 0 before the first heading."""
    order = W.partitionBy("doc").orderBy("page", "para", "line_no")
    return lines(pages).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def blocks(pages: DataFrame) -> DataFrame:
    """``(doc, section, page, para, block_type, content)``.

    In a paragraph's part within a section, all lines up to the first list line
    make a paragraph and all from it on a list.
    """
    part = W.partitionBy("doc", "page", "para", "section").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = section_lines(pages).where("level = 0").withColumn("in_list", F.max("is_list").over(part))
    join = F.when(F.col("is_list"), "\n").otherwise(" ")
    rows = rows.groupBy("doc", "section", "page", "para", "in_list").agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat(join, F.col("line")).alias("text")))).alias("x"))
    text = F.array_join(F.transform("x", lambda v: v.getField("text")), "")
    return rows.select("doc", "section", "page", "para", F.when(F.col("in_list"), "list_item").otherwise("paragraph").alias("block_type"), F.substring(text, 2, 2**31 - 1).alias("content"))


def sections(pages: DataFrame) -> DataFrame:
    """One row per section: heading, level, page span, blocks, full text.

    ``page_end`` is the last page on which a paragraph ended while the section
    was open. A "Preamble" without blocks is dropped.
    """
    rows = section_lines(pages)
    heads = rows.groupBy("doc", "section").agg(
        F.min_by(heading_title(F.col("line")), F.struct("page", "para", "line_no")).alias("first"), F.max("level").alias("heading_level"), F.min("page").alias("first_page")
    )
    ends = rows.groupBy("doc", "page", "para").agg(F.max("section").alias("section")).groupBy("doc", "section").agg(F.max("page").alias("last_page"))
    packed = blocks(pages).groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("page", "para", F.when(F.col("block_type") == "paragraph", 0).otherwise(1).alias("k"), "block_type", "content"))).alias("b"))
    starts = pages.where(F.col("text").rlike(r"(?U)\S")).groupBy("doc").agg(F.min("page").alias("doc_page"))
    out = heads.join(packed, ["doc", "section"], "left").join(ends, ["doc", "section"], "left").join(starts, "doc")
    title = F.when(F.col("section") == 0, "Preamble").otherwise(F.col("first"))
    body = F.transform(F.coalesce("b", F.array()), lambda x: x.getField("content"))
    start = F.when(F.col("section") == 0, F.col("doc_page")).otherwise(F.col("first_page"))
    out = out.select("doc", "section", title.alias("heading"), "heading_level", start.alias("page_start"), F.coalesce("last_page", start).alias("page_end"), F.coalesce("b", F.array()).alias("blocks"), F.array_join(F.concat(F.when(title != "Preamble", F.array(title)).otherwise(F.array().cast("array<string>")), body), "\n\n").alias("full_text"))
    return out.where((F.size("blocks") > 0) | (F.col("heading") != "Preamble"))
