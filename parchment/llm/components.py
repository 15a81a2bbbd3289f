"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components by alternating large-star and small-star steps (Kiveris and others, 2014).

    ``edges`` has two long columns ``a`` and ``b``. Returns ``node, component`` for every node of an
    edge, component being the smallest node that can be reached. Self-loops and repeated edges are
    allowed, null ends are dropped; no edges give no rows. Each half step is a map-side combined minimum by node and a
    join on node, which adaptive execution can split where a node is very common. Nothing but two
    numbers per round comes to the driver; every round is checkpointed.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpointed(now)
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where(F.col("u") != F.col("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where(F.col("u") != F.col("v")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), "component").union(roots.join(stars.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
