"""Connected components by alternating large and small stars, each a partial aggregation and a join that Spark can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, standing_for, stash


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) but the roots themselves; the root is the least node.

    Rounds go on until one changes no edge: as many edges as before, and none of them new. The result is a scratch table.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    n, settled = now.count(), False
    while n and not settled:
        before, m = now, n
        now = stash(_small(_large(before)), "edges")
        n = now.count()
        settled = n == m and not now.join(before, ["a", "b"], "left_anti").limit(1).count()
        discard(before)
    return standing_for(now.select(F.col("a").alias("node"), F.col("b").alias("root")), now)
