"""Dimension lookups that hold up against hot keys and large dimensions.

A dimension that is small by construction (a row per task, feature or rule) is
broadcast.  Any other join is left to the optimiser: it broadcasts by measured size,
and a key that holds a third of the facts is split by the adaptive skew join, which
repeats only that key's dimension rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cidr_bounds, ip_to_long

BLOCK_BITS = 16


def lookup(facts: DataFrame, dim: DataFrame, on: list[tuple[str, str]], *, extra: Column | None = None, how: str = "left", small: bool = False) -> DataFrame:
    """Join ``dim`` to ``facts`` on (fact column, dim column) pairs; dim columns must not clash.

    ``small`` promises that ``dim`` does not grow with the log.
    """
    conds = [F.col(f) == F.col(d) for f, d in on]
    if extra is not None:
        conds.append(extra)
    return facts.join(F.broadcast(dim) if small else dim, reduce(lambda a, b: a & b, conds), how)


def per_block(ranges: DataFrame, *, clip: bool = False) -> DataFrame:
    """Repeat each range once per /16 block it touches, for an equi join on ``block``."""
    size = 1 << BLOCK_BITS
    out = ranges.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {size}"), F.expr(f"hi div {size}"))))
    if not clip:
        return out
    return out.withColumns(
        {"lo": F.greatest("lo", F.col("block") * size), "hi": F.least("hi", F.col("block") * size + (size - 1))}
    )


def merge_intervals(networks: DataFrame, by: str) -> DataFrame:
    """Disjoint ``(by, block, lo, hi)`` ranges: overlapping and adjacent ones merged within each /16 block."""
    clipped = per_block(networks.select(by, "lo", "hi"), clip=True)
    w = Window.partitionBy(by, "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = clipped.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    grouped = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(by, "block", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def parse_networks(lists: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Valid IPv4 networks of ``lists`` with their bounds; invalid lines are dropped."""
    lo, hi = cidr_bounds(F.col(cidr))
    return lists.withColumns({"lo": lo, "hi": hi}).where(F.col("lo").isNotNull())


def in_ranges(facts: DataFrame, ranges: DataFrame, flag: str, *, ip: str = "ip", number: str | None = None) -> DataFrame:
    """Add boolean ``flag``: the address lies in one of the merged ``ranges`` (block, lo, hi).

    ``number`` names a column that already holds the numeric address.
    """
    dim = ranges.select(
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("block").alias("_block")
    )
    keyed = facts.withColumn("_ipn", F.col(number) if number else ip_to_long(F.col(ip))).withColumn("_at", F.expr(f"_ipn div {1 << BLOCK_BITS}"))
    out = lookup(keyed, dim, [("_at", "_block")], extra=F.col("_ipn").between(F.col("_lo"), F.col("_hi")))
    return out.withColumn(flag, F.col("_lo").isNotNull()).drop("_ipn", "_at", "_lo", "_hi", "_block")


def range_attributes(facts: DataFrame, ranges: DataFrame, columns: list[str], *, ip: str = "ip") -> DataFrame:
    """Attach ``columns`` of the range that contains the address (ranges must be disjoint)."""
    dim = per_block(ranges).select(
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("block").alias("_block"), *columns
    )
    keyed = facts.withColumn("_ipn", ip_to_long(F.col(ip))).withColumn("_at", F.expr(f"_ipn div {1 << BLOCK_BITS}"))
    out = lookup(keyed, dim, [("_at", "_block")], extra=F.col("_ipn").between(F.col("_lo"), F.col("_hi")))
    return out.drop("_ipn", "_at", "_lo", "_hi", "_block")
