"""Connected components of a graph held in DataFrames, by alternating large-star and small-star steps.

Each round is two grouped minimums with their joins; states are written to the shared folder, so lineage stays
short and lost executors cost no recomputation. Edges never reach the driver, only a count and a checksum.
Minimums are dealt apart before they are joined, so Spark can split the arcs of a component's root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, drop, materialize

#: Far above what the steps need (about the logarithm of the longest path); a safeguard against an endless loop.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node link to the least node around it. Small star: those below, and the node itself."""
    if large:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return arcs.filter("v > u").join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    links = down.join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of comparable ids -> (node, root), root the least node of the component; nodes without edges are absent."""
    state = materialize(edges.filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        fresh = materialize(_star(_star(state, True), False), "edges")
        drop(state)
        state = fresh
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
