"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the smallest node of its component) for every node but the labels themselves.

    ``edges`` has columns a and b. Each round is written to the shared folder; rounds grow with
    the logarithm of the longest chain. Only counts reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.write(e, f"{name}-0")
    state, k = None, 0
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or now[0] == 0:
            break
        state, k = now, k + 1
        e = scratch.write(_small_star(_large_star(e)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
