"""Chunk validation: filters, exact and near duplicates, dense numbering, summary."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as T

LEAST_RATIO, TOKEN_LIMIT = 0.97, 500


def judged(chunks: DataFrame) -> DataFrame:
    """``(doc, chunk_index, content)`` with its verdict: ok, empty, noise, broken, long or duplicate.

    Filters come first; of equal normalised texts in a document the first that
    passes them stays. ``n_chars`` is the clean text's length, so that a sum of it
    need not carry the text through the shuffle. Filter on the verdict behind this,
    not before: pushed under the text's columns, the filter would repeat them all.
    """
    rows = chunks.withColumn("clean", T.sanitize(F.col("content"))).withColumn("repaired", F.col("clean") != F.col("content"))
    rows = rows.withColumn("tokens", T.token_count(F.col("clean"))).withColumn("n_chars", F.char_length("clean"))
    c = F.col("clean")
    verdict = F.when(T.is_trivial(c, F.col("tokens")), "empty").when(T.is_noise(c), "noise").when(T.is_broken(c), "broken").when(F.col("tokens") > TOKEN_LIMIT, "long").otherwise("ok")
    rows = rows.withColumn("verdict", verdict).withColumn("key", T.dedup_key(c))
    first = F.row_number().over(W.partitionBy("doc", "key", "verdict").orderBy("chunk_index")) == 1
    return rows.withColumn("verdict", F.when((F.col("verdict") == "ok") & ~first, "duplicate").otherwise(F.col("verdict")))


def resembles(match: SequenceMatcher, before: str, content: str) -> bool:
    """Whether ``content`` (the matcher's second text) is near ``before``; cheap upper bounds of the ratio come first."""
    if abs(len(before) - len(content)) > max(80, int(0.15 * len(content))):
        return False
    match.set_seq1(before)
    return match.real_quick_ratio() >= LEAST_RATIO and match.quick_ratio() >= LEAST_RATIO and match.ratio() >= LEAST_RATIO


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Mark ok chunks as duplicate that resemble an accepted one of their document.

    Texts are compared in lower case with white space as single blanks. Order and argument order matter in the matcher, so a document's ok chunks are
    compared in sequence; a task holds one document.
    """

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_index")
        kept: list[str] = []
        verdicts = []
        for content in frame["clean"]:
            content = re.sub(r"\s+", " ", content.lower())
            match = SequenceMatcher(None, "", content)
            near = any(resembles(match, p, content) for p in kept)
            if not near:
                kept.append(content)
            verdicts.append("duplicate" if near else "ok")
        return pd.DataFrame({"doc": frame["doc"], "chunk_index": frame["chunk_index"], "near": verdicts})

    ok = rows.where("verdict = 'ok'").select("doc", "chunk_index", "clean")
    near = ok.groupBy("doc").applyInPandas(run, "doc long, chunk_index int, near string")
    return rows.join(near, ["doc", "chunk_index"], "left").withColumn("verdict", F.coalesce("near", "verdict")).drop("near")


def reindexed(rows: DataFrame) -> DataFrame:
    """The ok chunks, numbered densely from 0 in their order."""
    number = F.row_number().over(W.partitionBy("doc").orderBy("chunk_index")) - 1
    return rows.where("verdict = 'ok'").select("doc", number.alias("new_index"), "chunk_index", F.col("clean").alias("content"), "tokens")


def summary(rows: DataFrame) -> DataFrame:
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return rows.groupBy("doc").agg(
        F.count("*").alias("n_input"), n("ok").alias("n_valid"), n("empty").alias("n_empty"), n("duplicate").alias("n_duplicates"),
        n("noise", "broken", "long").alias("n_malformed"), n("long").alias("n_over_limit"), F.count_if("repaired").alias("n_repaired"),
    )


def validate(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid chunks and the summary per document."""
    rows = near_duplicates(judged(chunks))
    return reindexed(rows), summary(rows)
