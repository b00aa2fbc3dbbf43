"""Connected components of an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    linked = joined.where("b <> m").select(F.col("m").alias("a"), "b")
    return linked.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge joins a root with a node of that root alone."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("below")))
    roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("n"))
    return roles.where("below > 1 or (below = 1 and n > 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); the root is the smallest node of its component.

    Each round is a written table, and only whether it has stars alone reaches the
    driver.  The joins are on a node: a hub with very many edges is one side's
    single row, and the other side can be split.
    """
    now = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    for k in range(1, most + 2):
        if _stars(now):
            break
        if k > most:
            raise RuntimeError(f"no components after {most} rounds")
        now = scratch.table(_small_star(_large_star(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
