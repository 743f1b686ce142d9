"""Connected components of a graph of any size, by alternating large and small stars (Kiveris et al., 2014).

All nodes of a component end up linked to its smallest node. The driver sees one row of sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest neighbour (or the node itself, if it is smaller)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node, and its neighbours below it, are linked to the smallest of these neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    below = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return below.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with ``a > b``, links between bigint nodes, become ``(a, b)``: each node and its component's least node.

    The least node itself has no row. Every round is written to the shared folder and read again.
    """
    state, before = materialize(edges.select("a", "b").where("a > b").distinct(), "links"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first()
        if not now[0] or now == before:
            return state
        before = now
        state = materialize(_small_star(_large_star(state)), "links")
