"""The job queue as a stream: JSON files in, chunks replaced per batch, checkpointed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.schemas import JOBS


def enqueue(jobs: DataFrame, landing: str) -> None:
    jobs.write.mode("append").json(landing)


def job_stream(spark: SparkSession, landing: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", files_per_batch).json(landing)


def run_jobs(jobs: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process micro-batches until the queue is drained. A batch may run twice after
    a failure; ``process`` must replace, not add (see ``replace_chunks``)."""
    return jobs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame, delay: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """Latest state per document of an event stream ``(document_id, ts, status)``.

    Batch: over all events. Stream: the latest within each window of ``keep``, so
    state is dropped once the watermark has passed the window's end; the newest
    window of a document holds its state (see ``lifecycle.latest_status``).
    """
    last = [F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts")]
    if not events.isStreaming:
        return events.groupBy("document_id").agg(*last)
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", keep).alias("w"), "document_id").agg(*last)
    return rows.select("document_id", F.col("w.start").alias("since"), "status", "ts")


def sweep_stream(ticks: DataFrame, sweep: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """Call ``sweep`` for stuck jobs at each tick of a stream (a rate source, say)."""
    return ticks.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_with_restarts(start: Callable[[], StreamingQuery], tries: int = 3, pause_s: float = 1.0) -> None:
    """Await a query; after a failure wait and start it again from its checkpoint."""
    for k in range(tries):
        try:
            start().awaitTermination()
            return
        except StreamingQueryException:
            if k == tries - 1:
                raise
            time.sleep(pause_s)


def rate_windows(requests: DataFrame, minutes: int = 15, most: int = 300) -> DataFrame:
    """Requests per client and fixed window, and whether they exceed the limit."""
    return requests.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "client").agg(F.count("*").alias("n")).select("client", F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))
