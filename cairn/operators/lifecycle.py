"""Document lifecycle: staging, statuses, stale jobs, idempotent replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STALE_MINUTES = 10
#: The messages that a document's row shows.
NO_TEXT, NO_CHUNKS = "No extractable text found in document", "No valid chunks remained after validation"


def stage(rows: DataFrame, last_id: int) -> DataFrame:
    """New documents as pending, with dense ids after ``last_id`` that depend on their paths alone.

    Rows are dealt to 4,096 groups by a digest of the path and numbered within
    each; only the groups' counts, at most 4,096 rows, are summed in one task. A
    null path counts as empty; rows of one path get successive ids.
    """
    rows = rows.withColumn("_group", F.substring(F.md5(F.coalesce("storage_path", F.lit(""))), 1, 3))
    counts = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1))
    firsts = counts.select("_group", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.row_number().over(W.partitionBy("_group").orderBy("storage_path"))
    numbered = rows.withColumn("_place", place).join(F.broadcast(firsts), "_group")
    return numbered.withColumn("id", F.col("_first") + F.col("_place") + F.lit(last_id).cast("long")).withColumn("status", F.lit("pending")).drop("_group", "_place", "_first")


def stale(docs: DataFrame, now: Column) -> DataFrame:
    """Processing since more than ten minutes; an unknown start never counts."""
    return docs.where((F.col("status") == "processing") & (F.col("processing_started_at") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")))


def sweep(docs: DataFrame, now: Column, message: str = "processing timed out") -> DataFrame:
    old = F.coalesce((F.col("status") == "processing") & (F.col("processing_started_at") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")), F.lit(False))
    return docs.withColumn("error_message", F.when(old, message).otherwise(F.col("error_message"))).withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def outcome(total_chars: Column, n_valid: Column, error: Column) -> tuple[Column, Column]:
    """Final status and message of a run; messages are cut at 1,000 characters."""
    message = F.when(error.isNotNull(), F.substring(error, 1, 1000)).when(total_chars == 0, NO_TEXT).when(n_valid == 0, NO_CHUNKS)
    return F.when(message.isNull(), "completed").otherwise("failed"), message


def latest_status(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: a maximum by struct, partial before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in rest])


def without_children(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: children of the deleted parents go."""
    return children.join(gone.select(key), key, "left_anti")


def replace_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace all chunks of the batch's documents: overwrite of their buckets only.

    Writing the same batch again leaves the same table.
    """
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    new = chunks.withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = old.join(new.select("bucket").distinct(), "bucket", "left_semi")
        kept = touched.join(new.select("document_id").distinct(), "document_id", "left_anti")
        new = new.unionByName(kept.select(*new.columns))
    landing = f"{path.rstrip('/')}-landing"
    new.write.mode("overwrite").parquet(landing)
    spark.read.schema(new.schema).parquet(landing).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
