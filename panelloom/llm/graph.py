"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stages


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has columns a, b of one ordered type; direction, repeats, self-loops
    and nulls do not matter.  Large-star and small-star steps alternate until
    nothing changes; both replace edges one for one, so the table never grows, a
    minimum per node is combined before the shuffle, and every round is a stage.
    """
    pair = edges.where("a IS NOT NULL AND b IS NOT NULL")
    current = stages.put(
        pair.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), f"{name}-0"
    )
    step, before = 0, None
    while True:
        both = current.select("v", "u").unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        smallest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # Large star: every larger neighbour is tied to the smallest one.
        large = both.where("u > v").join(smallest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        )
        step += 1
        following = stages.put(small, f"{name}-{step}")
        # Each node with exactly one edge to a node without one: all trees are stars.
        stats = following.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")
        ).first()  # one row
        stages.drop(f"{name}-{step - 1}")
        current = following
        if (stats.n, stats.h) == before:
            break
        before = (stats.n, stats.h)
    nodes = current.select("v", F.col("u").alias("c"))
    roots = current.select(F.col("u").alias("v"), F.col("u").alias("c")).distinct()
    return nodes.unionByName(roots).select(F.col("v").alias("node"), F.col("c").alias("component"))
