"""Connected components by least labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stash


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label: the least node reachable.

    Each round takes the least label among neighbours and then that label's own
    label. Rounds are written to the shared folder, so lineage stays short and a
    lost executor costs one round. Aggregations are partial before the shuffle,
    and a node of very many links is split by adaptive skew handling.
    """
    spark = edges.sparkSession
    ends, ends_at = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    first = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"), F.lit(True).alias("moved"))
    labels, at = stash(first, "labels")
    while labels.where("moved").limit(1).count():
        now = labels.select("node", "label")
        near = ends.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        hooked = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = hooked.join(jump, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved"))
        old, (labels, at) = at, stash(new, "labels")
        drop(spark, old)
    drop(spark, ends_at)
    return labels.select("node", "label")
