"""Tables kept between steps in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
and the master is one machine's a private one is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A plan's shuffle files go when it ends, not when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.conf.set(KEY, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/cairn-{tag}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans run inside delete their shuffle files when they end."""
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, was)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Plans run inside hand Python at most ``rows`` rows at once (null: as the session has it)."""
    was = spark.conf.get(BATCH)
    if rows:
        spark.conf.set(BATCH, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def stash(df: DataFrame, tag: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    A lost executor then costs a reread of files, not a recomputation. ``rows``
    bounds the Arrow batches of the write, for rows that hold whole texts. The
    shuffle files of the write are deleted after it.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with arrow_rows(spark, rows), own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
