"""File sources: text, DOCX, and pluggable extractors for PDF and images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import clean

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SPARSE_CHARS, SNIFFED_BYTES = 50, 8000


def sniff(content: Column) -> Column:
    """File type by leading bytes; JPEG content is always JPG; null where unknown."""
    start = F.hex(F.substring(content, 1, 8))
    magic = {"FFD8FF": "JPG", "89504E470D0A1A0A": "PNG", "25504446": "PDF", "504B0304": "DOCX"}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, kind in magic.items():
        out = out.when(start.startswith(prefix), kind)
    return out.when(is_text_like(content), "TXT")


def is_text_like(content: Column) -> Column:
    """No NUL and under 1 % control bytes in the first 8,000; empty is not text."""
    head = F.hex(F.substring(content, 1, SNIFFED_BYTES))
    pairs = F.regexp_extract_all(head, F.lit("(..)"), 1)
    n = F.size(pairs)
    control = F.size(F.filter(pairs, lambda x: x.rlike("^(0[1-8BCEF]|1.|7F)$")))
    return (n > 0) & ~F.array_contains(pairs, "00") & (control / F.nullif(n, F.lit(0)) < 0.01)


def accepts(kind: Column, name: Column) -> Column:
    """Whether the sniffed type and the name's extension go together."""
    ext = F.upper(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce((ext == kind) | (kind == "JPG") & (ext == "JPEG"), F.lit(False))


def docx_text(content: bytes) -> str:
    """The body's own paragraphs, judged by style name (by id without a style sheet); headings and titles between blank lines, list items with "- "."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        sheet = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names = {}
    for style in sheet.iter(f"{WORD}style") if sheet is not None else ():
        name = style.find(f"{WORD}name")
        names[style.get(f"{WORD}styleId")] = name.get(f"{WORD}val") if name is not None else None
    out = []
    for p in root.findall(f"{WORD}body/{WORD}p"):
        text = "".join(t.text or "" for t in p.iter(f"{WORD}t")).strip()
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        key = style.get(f"{WORD}val") if style is not None else None
        name = (names.get(key, key) or "").lower()
        if text:
            out.append(f"\n{text}\n" if "heading" in name or "title" in name else f"- {text}" if "list" in name or "bullet" in name else text)
    return "\n\n".join(out)


def unavailable(kind: str) -> Callable[[bytes], list[tuple[int, str]]]:
    def run(content: bytes) -> list[tuple[int, str]]:
        raise NotImplementedError(f"register an extractor for {kind}: EXTRACTORS[{kind!r}] = function")

    return run


#: Type to function(bytes) -> [(page, text)]; PDF and image readers are to be registered by the user.
EXTRACTORS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {
    "TXT": lambda b: [(1, b.decode("utf-8", "replace"))],
    "DOCX": lambda b: [(1, docx_text(b))],
    **{k: unavailable(k) for k in ("PDF", "PNG", "JPG", "JPEG")},
}


def needs_scan_reader(page_text: Column) -> Column:
    """A PDF page with under 50 characters of text goes to the image reader."""
    return F.char_length(F.trim(F.coalesce(page_text, F.lit("")))) < SPARSE_CHARS


def routed(pages: list[tuple[int, str]], read_scan: Callable[[int], str]) -> list[tuple[int, str]]:
    """Pages of a PDF: one with under 50 characters is read as an image instead.

    Where that fails or gives nothing the sparse text stays.
    """
    out = []
    for page, text in pages:
        if len((text or "").strip()) < SPARSE_CHARS:
            try:
                text = read_scan(page) or text
            except Exception:  # one bad image must not lose the document
                pass
        out.append((page, text or ""))
    return out


def resolve(spark: SparkSession, path: str, roots: tuple[str, ...] = ()) -> str:
    """The first of ``path`` and ``path`` below each root that exists, in any store that the session reads; else its absolute form."""
    paths, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for candidate in (path, *(f"{r.rstrip('/')}/{path.lstrip('/')}" for r in roots)):
        place = paths(candidate)
        store = place.getFileSystem(conf)
        if store.exists(place):
            return store.makeQualified(place).toString()
    place = paths(path)
    return place.getFileSystem(conf).makeQualified(place).toString()


def storage_name(name: Column) -> Column:
    """A fresh name for an upload: a random identifier and the file's own name without folders."""
    return F.concat_ws("-", F.expr("uuid()"), F.regexp_extract(name, r"([^/\\]*)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def is_docx(content: bytes | None) -> bool:
    """Whether a zip holds a word-processing document; any other zip does not."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return "word/document.xml" in z.namelist()
    except zipfile.BadZipFile:
        return False


def extract_each(files: DataFrame) -> DataFrame:
    """``(document_id, file_type, content)`` to ``(document_id, pages, error)``: a document that
    cannot be read keeps its message and does not stop the others."""
    extractors = dict(EXTRACTORS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, kind, content in zip(frame["document_id"], frame["file_type"], frame["content"]):
                try:
                    if (kind or "").upper() not in extractors:
                        raise ValueError(f"unsupported file type {kind}")
                    rows.append((doc, [{"page": p, "text": t} for p, t in extractors[kind.upper()](bytes(content))], None))
                except Exception as e:  # kept with the document
                    rows.append((doc, [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["document_id", "pages", "error"])

    return files.select("document_id", "file_type", "content").mapInPandas(run, "document_id long, pages array<struct<page:int,text:string>>, error string")


def extract(files: DataFrame) -> DataFrame:
    """``(path, file_type, content)`` to cleaned ``(path, page, text)``; an unknown type fails."""
    extractors = dict(EXTRACTORS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.file_type.upper() not in extractors:
                    raise ValueError(f"unsupported file type {r.file_type}")
                rows += [(r.path, page, text) for page, text in extractors[r.file_type.upper()](bytes(r.content))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    pages = files.select("path", "file_type", "content").mapInPandas(run, "path string, page int, text string")
    return pages.withColumn("text", clean(F.col("text")))
