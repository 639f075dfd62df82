"""The ingestion chain over a batch of files: extract, stitch, structure, chunk, validate, embed, store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import stitch
from cairn.operators import chunking, embedding, lifecycle, structure, telemetry, validation
from cairn.operators.lifecycle import NO_CHUNKS, NO_TEXT
from cairn.sources.files import extract_each


def to_processing(docs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The batch's documents as processing since ``now``."""
    mine = docs.join(ids.select(F.col("document_id").alias("id"), F.lit(True).alias("mine")), "id", "left")
    mine = mine.withColumn("status", F.when(F.col("mine"), "processing").otherwise(F.col("status")))
    return mine.withColumn("processing_started_at", F.when(F.col("mine"), now).otherwise(F.col("processing_started_at"))).drop("mine")


def chunked(files: DataFrame, max_tokens: int = chunking.MAX_TOKENS, overlap_tokens: int = chunking.OVERLAP_TOKENS, counter: str = "whitespace") -> tuple[DataFrame, DataFrame]:
    """Numbered chunks of ``files(document_id, file_type, content)``, and per document the
    characters extracted and the error, if it could not be read."""
    read = extract_each(files).withColumn("pages", stitch("pages"))
    size = F.aggregate(F.transform("pages", lambda p: F.char_length(p.getField("text"))), F.lit(0), lambda s, n: s + n).cast("long")
    seen = read.select("document_id", F.size("pages").alias("n_pages"), size.alias("total_characters"), "error")
    pages = read.select(F.col("document_id").alias("doc"), F.inline("pages"))
    chunks = chunking.chunk_sections(structure.sections(pages), max_tokens, overlap_tokens, counter)
    return chunking.numbered(chunks), seen


def stored_rows(chunks: DataFrame, judged: DataFrame, model: Callable) -> DataFrame:
    """Accepted chunks as rows of the chunk table, with dense numbers, metadata and vectors."""
    kept = validation.reindexed(judged).withColumnRenamed("content", "clean")
    rows = kept.join(chunks, ["doc", "chunk_index"]).withColumn("char_count", F.char_length("clean"))
    index = F.col("new_index").cast("int").alias("chunk_index")
    meta = F.struct("section_heading", "page_number", "page_end", F.col("tokens").alias("token_count"), "char_count", "has_list", "is_continuation", F.col("doc").alias("document_id"), index)
    rows = rows.select(F.col("doc").alias("document_id"), index, F.col("clean").alias("content"), "page_number", meta.alias("metadata"))
    return embedding.embed(rows, F.col("content"), model)


def outcomes(files: DataFrame, seen: DataFrame, summary: DataFrame, dequeued_ms: int, embedded_ms: int) -> DataFrame:
    """``(id, status, error_message, metrics)`` of each document of the batch.

    An exception or a success carries metrics; a document without text or without
    valid chunks fails with its message and keeps the metrics that it has (null here).
    """
    jobs = files.select("document_id", "file_type", "uploaded_at_ms")
    rows = jobs.join(seen, "document_id").join(summary.withColumnRenamed("doc", "document_id"), "document_id", "left")
    n = F.coalesce("n_valid", F.lit(0).cast("long"))
    none = (F.col("n_pages") == 0) | (F.col("total_characters") == 0)
    message = F.when(F.col("error").isNotNull(), F.substring("error", 1, 1000)).when(none, NO_TEXT).when(n == 0, NO_CHUNKS)
    times = telemetry.durations(F.col("uploaded_at_ms"), F.lit(dequeued_ms), F.lit(embedded_ms))
    wait = times["queue_wait_duration_s"].alias("queue_wait_duration_s")
    done = F.to_json(F.struct("document_id", "file_type", "uploaded_at_ms", F.lit(dequeued_ms).alias("dequeued_at_ms"), F.lit(embedded_ms).alias("completed_at_ms"), *[c.alias(k) for k, c in times.items()], n.alias("chunks_count"), "total_characters", F.lit("completed").alias("status")))
    lost = F.to_json(F.struct("uploaded_at_ms", F.lit(dequeued_ms).alias("dequeued_at_ms"), F.lit(embedded_ms).alias("failed_at_ms"), wait, times["worker_pipeline_duration_s"].alias("elapsed_before_failure_s"), F.lit("failed").alias("status"), F.substring("error", 1, 500).alias("error")))
    metrics = F.when(F.col("error").isNotNull(), lost).when(message.isNull(), done)
    return rows.select(F.col("document_id").alias("id"), F.when(message.isNull(), "completed").otherwise("failed").alias("status"), message.alias("error_message"), F.parse_json(metrics).alias("metrics"))


def ingest(files: DataFrame, chunk_path: str, work: str, model: Callable = embedding.hashed_model, now_ms: Callable[[], float] = lambda: 1000 * time.time()) -> DataFrame:
    """Run the chain for ``files(document_id, file_type, content, uploaded_at_ms)``.

    Chunks of the batch's documents are replaced in the table at ``chunk_path``;
    documents that failed keep the chunks they had. ``work`` is a folder that all
    executors share: extracted chunks are written there once, so that neither the
    readers nor the vectors run twice. Returns the outcomes, to be merged into the
    document table. Running a batch again leaves the same chunks.
    """
    spark, begun = files.sparkSession, int(now_ms())
    chunks, seen = chunked(files)
    for name, df in (("chunks", chunks), ("seen", seen)):
        df.write.mode("overwrite").parquet(f"{work}/{name}")
    chunks, seen = (spark.read.parquet(f"{work}/{x}") for x in ("chunks", "seen"))
    judged = validation.near_duplicates(validation.judged(chunks))
    judged.write.mode("overwrite").parquet(f"{work}/judged")
    judged = spark.read.parquet(f"{work}/judged")
    stored_rows(chunks, judged, model).write.mode("overwrite").parquet(f"{work}/stored")
    ready = int(now_ms())
    lifecycle.replace_chunks(spark.read.parquet(f"{work}/stored"), chunk_path)
    return outcomes(files, seen, validation.summary(judged), begun, ready)
