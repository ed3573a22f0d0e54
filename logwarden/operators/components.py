"""Connected components by alternating large-star and small-star steps.

Edges are rewired towards the smallest neighbour until every node points at its
component's smallest id.  Each step is a grouped minimum (combined map-side) and a
join of the edges with those minima; lineage is cut by a checkpoint in the shared
folder every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import lookup


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "_n"))
    joined = lookup(both, low, [("u", "_n")], how="inner")
    if large:
        # larger neighbours are linked to the smallest node around u
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        # u and its smaller neighbours are linked to the smallest of them
        linked = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(low.select(F.col("_n").alias("u"), F.col("_m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of undirected ``edges (a, b)``; component = smallest node."""
    ensure_checkpoint_dir(edges.sparkSession)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    work = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        work = _star(_star(work, True), False).checkpoint()
        # exact fingerprint of the edge set: count and sums of both ends
        state = tuple(work.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return nodes.join(work.select(F.col("u").alias("node"), F.col("v").alias("_root")), "node", "left").select(
        "node", F.coalesce("_root", "node").alias("component")
    )
