"""Connected components of a distributed edge list by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a
pre-aggregated minimum per node and an equi-join; hubs, of which there are few, are joined by a
broadcast, so their edges stay spread over tasks and no node's neighbours are ever gathered. Each
round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hub_join


def _star(pairs: DataFrame, small: bool, total: int) -> DataFrame:
    """pairs (a, b), about total: b is a neighbour of a. Neighbours move to the least of a and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    moved = hub_join(pairs, least, "a", "n", total)
    if small:
        return moved.select(F.col("b").alias("v"), "m").unionByName(least.select(F.col("a").alias("v"), "m")).where("v != m")
    return moved.where("b > a").select(F.col("b").alias("v"), "m").where("v != m")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return tuple(row)


def _tasks(rows: int) -> int:
    """Few files for few edges: a round's table has a file for each of so many rows."""
    return max(4, -(-rows // 200_000))


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """edges (u, v) of any orderable type -> (node, component), for every node of an edge.

    The component is its smallest node. Loops, repeated and reversed edges are fine, rows with a null
    end are dropped, and no edges give no rows.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    start = edges.where("u is not null and v is not null and u != v")
    edges = scratch.save(start.select(high.alias("v"), low.alias("m")).distinct(), f"{name}-0")
    before = _state(edges)
    for k in range(1, rounds + 1):
        both = edges.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(edges.select(F.col("m").alias("a"), F.col("v").alias("b")))
        large = _star(both, small=False, total=2 * before[0]).distinct()
        after = _star(large.select(F.col("v").alias("a"), F.col("m").alias("b")), small=True, total=before[0]).distinct()
        edges = scratch.save(after.coalesce(_tasks(before[0])), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return nodes.unionByName(edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
