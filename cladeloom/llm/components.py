"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins on node id.  No adjacency list, component
or edge set is gathered in one task or on the driver: the minimum of a neighbourhood is a
map-side combined aggregate, so a hub with millions of neighbours is no hot group, and the
join that hands it back is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _written(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and a hash of them all, taken while it is written."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x"))
    out = scratch.table(marked, name)
    return out, (seen.get["n"], seen.get["x"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "u", dst: str = "v", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge; component is its smallest node.

    Self-loops, repeated edges and either direction are fine; null ends are left out.  An
    empty edge table gives an empty result.
    """
    pair = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    now, before = _written(pair.filter("u <> v").distinct(), scratch, "cc0")
    for k in range(1, rounds + 1):
        if before[0] == 0:
            break
        now, after = _written(_small_star(_large_star(now)), scratch, f"cc{k}")
        scratch.drop(f"cc{k - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
