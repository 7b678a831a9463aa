"""Connected components of an edge table, by alternating stars.

Each round hangs the larger neighbours of every node on its smallest neighbour
(large star), then the smaller ones (small star), until nothing changes; every
node then hangs on the smallest of its component. Rounds grow with the logarithm
of the longest path. A round is an aggregation with partial sums on the map side
and an equi-join, so a node with very many edges is never gathered in one place:
its edges are rows that a skewed join may split. Rounds are written to the shared
checkpoint folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node that an edge joins to another; the
    component is its smallest node. Edges with a null end or with equal ends
    say nothing and are left out; repeated edges count once. No edges, no rows."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), name)
    before = None
    while True:
        # an order-free digest of the edge set tells whether a round changed it
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        large = materialize(_large_star(now), name)
        discard(now)
        now = materialize(_small_star(large), name)
        discard(large)
