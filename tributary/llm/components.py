"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import discard, settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for all nodes of edges (a, b): root is the least node that a node reaches.

    Each round joins every node to the least of its neighbours; after a few, all edges lead to roots.
    Rounds are of the order of the logarithm of a component's size. Minima are combined before
    they are shuffled and joined back by key, so a node with very many neighbours is no single task's load.
    """
    now = settle(edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = settle(large, "large_star")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        old, now = now, settle(
            small.filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(down.select("hi", F.col("m").alias("lo"))).distinct(), "small_star"
        )
        discard(old, large)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    else:
        raise RuntimeError("components: no end after the allowed rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
