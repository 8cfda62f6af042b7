"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; aggregated before the shuffle, whatever u's degree."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to the least neighbour of u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.where("v > u").join(_least_neighbour(both), "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` are pairs (u, v) of numbers.

    The steps shorten paths until each node is linked to the least node of its component: a number of
    rounds that grows with the logarithm of the longest path. Loops (u = u) are ignored.
    """
    now = scratch.write(edges.select("u", "v").where("u <> v").distinct(), "edges_0")
    before, step = None, 0
    while True:
        step += 1
        now = scratch.write(_small_star(_large_star(now)), f"edges_{step}")
        scratch.drop(f"edges_{step - 1}")
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
