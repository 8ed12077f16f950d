"""Connected components of an edge table by alternating star contractions.

A large star links every larger neighbour of a node to the node's smallest neighbour, a
small star every smaller one. Both only aggregate and join edges by node, so no
neighbourhood is ever gathered; a few rounds, about the logarithm of the longest chain,
leave one star per component. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millgauge.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(lowest, "a").where("b > a").select(F.col("low").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    lowest = down.groupBy("b").agg(F.min("a").alias("low"))
    linked = down.join(lowest, "b")
    kept = linked.where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return kept.unionByName(lowest.select(F.col("low").alias("a"), "b"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
