"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and read back as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.jaccard import drop_near_copies
from cairn.llm.packing import pack
from cairn.llm.quality import keep_good
from cairn.llm.scratch import stash
from cairn.llm.toxicity import drop_toxic


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; learned from the labels of two folds of three."""
    return drop_toxic(docs, labels(spark, sf_dir))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of linked documents."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold all documents left."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality), ("toxicity", toxicity), ("deduplicate", deduplicate), ("packing", packing)]

#: SQL can express neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stash(stage(spark, docs, sf_dir), name)
    return docs
