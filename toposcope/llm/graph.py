"""Intermediate tables in the shared folder, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.settings import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (``a``, ``b``, both long): the smallest node it can reach.

    Alternates the large-star and small-star steps, which keep the edges' number and halve the paths; each
    round is written to the shared folder, and only its edge count and checksum come to the driver.
    """
    now, before = stored(_both(edges).where("a > b").distinct()), None
    for _ in range(max_rounds):
        near = _both(now)
        large = near.join(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        now = stored(small.where("a > b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    labels = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct()
    return stored(labels.unionByName(roots.join(labels, "node", "left_anti").withColumn("label", F.col("node"))))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
