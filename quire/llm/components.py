"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``node, comp`` for every node of the edges ``a, b``; ``comp`` is one node of the component, the same for all of it (the smallest,
    unless the edges already are stars from ``a`` to ``b``).

    Each round aggregates a node's smallest neighbour before joining it back, so a node with very many
    edges is not gathered in one task, and stores its edges, so a lost executor repeats one round at
    most. The rounds end when the edges are stars: every node has one parent and no parent has a parent. An edge
    list without rows gives none; loops and repeated edges do no harm; null ends are ignored."""
    now = stored(edges.filter("a is not null and b is not null and a != b").select("a", "b").distinct(), f"{tag}-edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), f"{tag}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = stored(small, f"{tag}-small")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _stars(edges: DataFrame) -> bool:
    seen = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per_node = seen.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
