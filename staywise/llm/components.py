"""Connected components of a link table, by large-star / small-star rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node it reaches.

    Each round links the neighbours of a node to the smallest of them, so the
    depth halves; rounds grow with the logarithm of the longest path. A hub
    costs one row per neighbour: minima are aggregated before the shuffle and
    no neighbour list is gathered. Every round is checkpointed.
    """
    edges = checkpoint(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    )
    state = None
    while True:
        # large star: larger neighbours of u point to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = checkpoint(large.distinct())
        # small star: smaller neighbours of u, and u, point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        edges = checkpoint(
            small.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
            .filter("a != b").distinct()
        )
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
