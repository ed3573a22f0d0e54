"""Connected components on long ids, by label contraction.

Every round each node takes the least label around it; groups of nodes with one
label become one node.  Edges shrink geometrically, minima are combined map-side and
joins split hot keys (adaptive skew join), so a hub that touches a third of all
edges is no task of its own.  Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` for every ``node``; component is the least node reachable over ``edges`` (a, b)."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each node points at its least neighbour or itself; pointing is followed to the end, which is a local minimum
        step = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            jumped = stored(step.join(onward, "to", "left").select("node", F.coalesce("_next", "to").alias("to"), (F.col("_next") != F.col("to")).alias("_moved")))
            moved = not jumped.where("_moved").isEmpty()
            step = jumped.select("node", "to")
            if not moved:
                break
        maps.append(step)
        u, v = (step.select(F.col("node").alias(x), F.col("to").alias(f"_{x}")) for x in "uv")
        edges = stored(edges.join(u, "u").join(v, "v").where("_u <> _v").select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
    out = nodes.select("node", F.col("node").alias("component"))
    for step in maps:
        out = out.join(step.select(F.col("node").alias("component"), F.col("to").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return out
