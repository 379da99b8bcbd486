"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.sources.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(a, b)`` (longs) with the smallest node it reaches.

    Returns ``(node, component)``. Alternates large-star and small-star steps: each step is a
    min-aggregation per node with map-side combine, written as a table, and one join of two scans, whose
    skewed keys Spark splits, so a node with very many neighbours is never gathered in one task. The
    number of rounds grows with the logarithm of the longest chain. The edge list shrinks to stars and
    is cut off by a stored table each round. Null ends and loops are no edges.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour; edges hold the larger end as a
        upward = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = stored(upward.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        # small star: a node and its smaller neighbours are tied to the smallest of them
        down = stored(large.groupBy("a").agg(F.min("b").alias("low")))
        small = (
            large.join(down, "a")
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = stored(small)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
