"""The registered queries of this folder: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import encode_media, read_media

    return read_media(encode_media(documents(spark, sf_dir)))


def op2_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score_toxicity, train

    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, train(docs, labels(spark, sf_dir), fold() != 1))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip_digest

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip_digest(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op4_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import token_records

    return token_records(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocab=50_257)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attribution import attribute_tokens

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribute_tokens(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import TURN_SCHEMAS, calls_of_turns, link_calls

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link_calls(*calls_of_turns(turns), TURN_SCHEMAS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_transport_streams, op2_pu_toxicity, op3_byte_bpe, op4_risk_controlled_rules, op5_token_records,
        op6_ngram_jaccard_join, op7_token_attribution, op8_packing, op9_license_scan, op10_tool_call_linking,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from .sql import oracle_sql

    return oracle_sql()
