"""Connected components of an edge list, as rounds of joins.

The alternating large-star / small-star scheme: every round hangs each node's
neighbours on the least node it knows, so paths shorten by a factor and a star
per component is left after O(log^2 n) rounds.  Each node's part is one row per
edge, never a collected neighbour list, so a node with very many neighbours is
only a skewed join key, which adaptive execution splits.  Every round is written
to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): least of a node and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the component's least node.

    ``edges`` has two bigint columns ``u`` and ``v``; loops and repeats are allowed.
    """
    def mark(df):
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        return tuple(row)

    edges = common.stored(edges.where("u <> v"), "edges")
    seen = mark(edges)
    for _ in range(max_rounds):
        edges = common.stored(_small_star(_large_star(edges)), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
