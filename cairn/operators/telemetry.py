"""Ingestion telemetry from the metrics document (a variant column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Into how many ranges the values of a series are dealt to find its median.
RANGES = 256
#: Parts of one that ``steady_sum`` adds as whole numbers, and the size from which it does not.
PARTS, PLAIN = 10_000.0, 1e6

STAGES = ("text_extraction_s", "structure_parsing_s", "section_chunking_s", "chunk_validation_s", "embedding_generation_s", "database_persistence_s")


def present(path: str) -> Column:
    """Whether the path is there, JSON null included."""
    return F.try_variant_get("metrics", path, "variant").isNotNull()


def number(path: str) -> Column:
    """A finite number; JSON null counts as 0, a missing path as null."""
    value = F.try_variant_get("metrics", path, "variant")
    x = F.when(F.is_variant_null(value), F.lit(0.0)).otherwise(F.try_variant_get("metrics", path, "double"))
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def has_telemetry() -> Column:
    return F.coalesce(present("$.worker_pipeline_duration_s") | present("$.stage_timings"), F.lit(False))


def mean4(x: Column) -> Column:
    return F.round(F.avg(x), 4)


def medians(docs: DataFrame, series: dict[str, Column]) -> DataFrame:
    """One row with the exact median of each column; rounded only where two middle values are averaged.

    Distinct values are counted, dealt to ranges of about equally many of them, and
    only the ranges that hold a middle value are ordered. What meets in one task is
    a count a range, and one range's distinct values. Without values: null.
    """
    values = docs.select(F.inline(F.array(*[F.struct(F.lit(k).alias("series"), c.alias("x")) for k, c in series.items()]))).where("x IS NOT NULL")
    values = values.groupBy("series", "x").agg(F.count("*").alias("n"))
    bounds = values.groupBy("series").agg(F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)]).alias("bounds"))
    dealt = values.join(F.broadcast(bounds), "series").withColumn("range", F.size(F.filter("bounds", lambda y: y < F.col("x")))).drop("bounds")
    counts = dealt.groupBy("series", "range").agg(F.sum("n").alias("in_range"))
    upto = W.partitionBy("series").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("in_range").over(upto), F.lit(0))).withColumn("total", F.sum("in_range").over(W.partitionBy("series")))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    middle = counts.where((F.col("first") <= high) & (F.col("first") + F.col("in_range") > low)).drop("in_range")
    below = W.partitionBy("series", "range").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    ranked = dealt.join(F.broadcast(middle), ["series", "range"]).withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(below), F.lit(0)))
    holds = lambda k: (F.col("first") <= k) & (F.col("first") + F.col("n") > k)
    a, b = F.max(F.when(holds(low), F.col("x"))), F.max(F.when(holds(high), F.col("x")))
    found = ranked.groupBy("series").agg(F.when(F.max("total") % 2 == 1, a).otherwise(F.round((a + b) / 2, 4)).alias("x"))
    return found.agg(*[F.max(F.when(F.col("series") == k, F.col("x"))).alias(k) for k in series])


def summary(docs: DataFrame) -> DataFrame:
    """One row over ``(id, status, metrics)``: counts and duration statistics in one aggregation, and exact medians."""
    run = has_telemetry()
    of = lambda path: F.when(run, number(path))
    worker, e2e, queue = of("$.worker_pipeline_duration_s"), of("$.upload_to_completion_duration_s"), of("$.queue_wait_duration_s")
    chunks = F.when(F.col("status") == "completed", F.coalesce(number("$.chunks_count"), F.lit(0.0)))
    rows = docs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("pending", "processing")).alias("pending"), F.count_if(run).alias("runs_with_metrics"), (F.count_if(run) > 0).alias("sufficient_data"),
        F.coalesce(F.sum(chunks), F.lit(0.0)).cast("long").alias("total_chunks"),
        mean4(worker).alias("avg_worker_s"), F.min(worker).alias("min_worker_s"), F.max(worker).alias("max_worker_s"),
        mean4(e2e).alias("avg_e2e_s"), F.min(e2e).alias("min_e2e_s"), F.max(e2e).alias("max_e2e_s"),
        mean4(queue).alias("avg_queue_s"),
        mean4(of("$.stage_timings.embedding_generation_s")).alias("avg_embedding_s"), mean4(of("$.stage_timings.database_persistence_s")).alias("avg_persistence_s"), mean4(of("$.stage_timings.text_extraction_s")).alias("avg_extraction_s"),
    )
    middle = medians(docs, {"median_worker_s": worker, "median_e2e_s": e2e, "median_queue_s": queue})
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(middle.withColumn("one", F.lit(1))), "one").drop("one")


def history(docs: DataFrame) -> DataFrame:
    """Newest first; a chunk count of 0 shows as null."""
    chunks = F.nullif(number("$.chunks_count").cast("long"), F.lit(0).cast("long"))
    return docs.select("id", "status", chunks.alias("chunks_count"), number("$.queue_wait_duration_s").alias("queue_wait_s"), number("$.worker_pipeline_duration_s").alias("worker_s"), number("$.upload_to_completion_duration_s").alias("e2e_s")).orderBy(F.desc_nulls_last("id"))


def steady_sum(x: Column) -> Column:
    """A sum that does not depend on the order of the rows.

    Ten-thousandths are added as whole numbers, so decimals of up to four places
    sum to the double nearest to their true sum; only what is left of other
    numbers, and numbers from a million, are added as doubles.
    """
    whole = F.when(F.abs(x) < PLAIN, F.rint(x * PARTS).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.sum(whole) / PARTS + F.sum(x - whole / PARTS)


def stage_shares(stages: dict[str, Column]) -> list[Column]:
    """Each stage's share in per cent, one place; missing is 0, a zero sum counts as 1."""
    filled = {k: F.coalesce(c, F.lit(0.0)) for k, c in stages.items()}
    total = sum(filled.values(), F.lit(0.0))
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return [F.round(100 * c / total, 1).alias(f"{k}_pct") for k, c in filled.items()]


def queue_wait_s(dequeued_ms: Column, uploaded_ms: Column) -> Column:
    return F.when(F.coalesce(uploaded_ms, F.lit(0)) == 0, F.lit(0.0)).otherwise((dequeued_ms - uploaded_ms) / 1000)


def queue_efficiency(queue: Column, e2e: Column) -> Column:
    return 1 - queue / F.nullif(e2e, F.lit(0.0))


def eta_s(pages: Column, page_s: Column, chars: Column, embed_s: Column) -> Column:
    """Pages times extraction, plus embeddings of 2,000 characters each."""
    return pages * page_s + chars / 2000 * embed_s


def durations(uploaded_ms: Column, dequeued_ms: Column, embedded_ms: Column) -> dict[str, Column]:
    """Queue wait, worker time up to the start of persistence, and upload to that instant, in seconds.

    Without an upload time nothing was waited for, and the worker's time stands for the whole.
    """
    worker = (embedded_ms - dequeued_ms) / 1000
    whole = F.when(F.coalesce(uploaded_ms, F.lit(0)) == 0, worker).otherwise((embedded_ms - uploaded_ms) / 1000)
    four = {"queue_wait_duration_s": queue_wait_s(dequeued_ms, uploaded_ms), "worker_pipeline_duration_s": worker, "upload_to_completion_duration_s": whole}
    return {k: F.round(c, 4) for k, c in four.items()}


def stage_timings(seconds: dict[str, Column]) -> Column:
    """The six stages' seconds, four places each; a stage that was not measured is null."""
    return F.struct(*[F.round(seconds.get(k, F.lit(None).cast("double")), 4).alias(k) for k in STAGES])


def size_kb(size: Column) -> Column:
    """Kilobytes with one decimal, halves upwards."""
    return F.printf(F.lit("%.1f"), size / 1024)


def shown(value: Column, enough: Column | None = None) -> Column:
    """A number as text; ``--`` for null, or a note where there are no runs yet."""
    text = F.coalesce(value.cast("string"), F.lit("--"))
    return text if enough is None else F.when(enough, text).otherwise("Insufficient data")


def embed_ms_per_chunk(elapsed_s: Column, chunks: Column) -> Column:
    """Mean milliseconds a chunk over all rows; null without chunks."""
    return 1000 * F.sum(elapsed_s) / F.nullif(F.sum(chunks), F.lit(0))
