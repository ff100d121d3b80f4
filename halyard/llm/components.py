"""Connected components by alternating star joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.sources.scratch import drop_written, written

MOST_ROUNDS = 100


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, consume: Sequence[DataFrame] = ()) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Each round every node hands its larger neighbours, then itself and its smaller
    ones, to the smallest node it sees; all components are stars after a few
    rounds. A minimum per node is summed up before the shuffle, and edges stay
    as many as the nodes or fewer after it, so no group is gathered.
    Null ends and edges of a node to itself are left out. ``consume`` names written tables to delete once the edges are read.
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    state = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    for table in consume:
        drop_written(table)
    digest = _digest(state)
    for _ in range(MOST_ROUNDS):
        around = _both_ways(state)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where(F.col("u") != F.col("v")).distinct(), "star-large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        after = written(small.where(F.col("u") != F.col("v")).distinct(), "star-edges")
        drop_written(large)
        drop_written(state)
        state = after
        new = _digest(state)
        if new == digest:
            break
        digest = new
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
