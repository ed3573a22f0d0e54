"""Exact quantiles per key by rank, without holding a key's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup
from .running import Running, running
from .slicing import DEFAULT_SLICE_ROWS


def exact_quantiles(df: DataFrame, key: str, value: str, qs: list[float], *, discrete: bool = False, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``key, q ARRAY<DOUBLE>``: quantiles of the non-null values, linearly interpolated or,
    if ``discrete``, the smallest value whose share reaches q.

    Equal values are counted first, so ranks run over distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("_n"))
    return counted_quantiles(counts, key, value, "_n", qs, discrete=discrete, slice_rows=slice_rows)


def counted_quantiles(counted: DataFrame, key: str, value: str, n: str, qs: list[float], *, discrete: bool = False, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """The same from a row per key and value with the number ``n`` of its rows; it is read several times."""
    counts = counted.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(n).alias("_n"))
    ranked = running(counts, ["_k"], ["_v"], [Running("_upto", "sum", F.col("_n"), "upto")], slice_rows=slice_rows)
    totals = counts.groupBy(F.col("_k").alias("_t")).agg(F.sum("_n").alias("_total"))
    both = lookup(ranked, totals, [("_k", "_t")], how="inner")

    def at(position):
        # value whose block of equal values covers the 0-based position
        covers = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(covers, F.col("_v")))

    last = F.col("_total") - 1
    parts = []
    for q in qs:
        if discrete:
            parts.append(at(F.greatest(F.ceil(F.col("_total") * F.lit(q)) - 1, F.lit(0))))
            continue
        lo, hi = F.floor(last * q), F.ceil(last * q)
        weight = F.max(last * q - F.floor(last * q))
        parts.append(at(lo) + (at(hi) - at(lo)) * weight)
    return both.groupBy(F.col("_k").alias(key)).agg(F.array(*parts).alias("q"))
