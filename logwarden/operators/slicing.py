"""Cut the rows of over-full keys into time slices.

A window over one key runs in one task, so a key that holds a third of the log
would make one task read a third of the log.  ``slice_rows`` finds the keys with
more than ``slice_rows`` rows and gives only those a slice number along the
ordering column; every other key keeps slice 0.  Slice borders are quantiles of
the hot rows themselves, so bursts are cut as finely as quiet stretches.

Two columns are added:

``_slice``  0 for ordinary keys, the slice number for hot keys, and a spread hash
            for NULL keys (whose rows belong to no group and only need balancing);
``_hot``    true for rows of hot keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SLICE = "_slice"
HOT = "_hot"

DEFAULT_SLICE_ROWS = 4_000_000
MAX_SLICES = 8_192
NULL_SPREAD = 65_536
# A hot key has more than ``slice_rows`` rows, so there are at most rows/slice_rows
# of them; up to this many the list is broadcast, beyond it Spark joins by shuffle.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Sliced:
    """A DataFrame with ``_slice``/``_hot`` and whether any key was actually cut."""

    df: DataFrame
    cut: bool


def settle(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the shared checkpoint folder.

    Every sliced step reads its input twice (rows and per-slice totals); without a cut
    a chain of steps would recompute its beginnings exponentially often.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bucket_of(value: Column, borders: list) -> Column:
    """How many of the ascending ``borders`` are <= value, by binary search.

    ``borders`` is a literal array; a fold over halving strides needs log2(n) steps.
    """
    if not borders:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in borders])
    n = len(borders)
    strides = [1 << k for k in range(n.bit_length() - 1, -1, -1)]

    def step(pos: Column, stride: Column) -> Column:
        nxt = pos + stride
        reaches = (nxt <= F.lit(n)) & (F.try_element_at(arr, nxt) <= value)
        return F.when(F.coalesce(reaches, F.lit(False)), nxt).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in strides]), F.lit(0), step)


def quantile_borders(df: DataFrame, at: str, n: int) -> list:
    """Ascending borders that cut the rows into about ``n`` equal parts along ``at``."""
    if n < 2:
        return []
    cuts = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
    number = float if dict(df.dtypes)[at] in ("double", "float") else int
    return sorted({number(c) for c in cuts or []})


def slice_hot_keys(
    df: DataFrame,
    keys: list[str],
    at: str,
    *,
    slice_rows: int = DEFAULT_SLICE_ROWS,
    total_rows: int | None = None,
    spread_by: str | None = None,
    census: DataFrame | None = None,
) -> Sliced:
    """Add ``_slice`` and ``_hot``.  ``at`` is the ordering column (a number).

    ``census`` has the ``keys`` and ``at`` of the same rows and is cheap to compute (a scan):
    keys are counted there, and ``df`` is written only if one of them is hot.
    """
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(F.col(spread_by or at)), F.lit(NULL_SPREAD)).cast("int")

    rows = df.count() if total_rows is None else total_rows
    if rows <= slice_rows:
        return Sliced(df.withColumns({SLICE: F.when(any_null, spread).otherwise(F.lit(0)), HOT: F.lit(False)}), False)

    if census is None:
        df = census = settle(df)
    counts = census.where(~any_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    n_hot, hot_rows = counts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_hot:
        return Sliced(df.withColumns({SLICE: F.when(any_null, spread).otherwise(F.lit(0)), HOT: F.lit(False)}), False)

    hot = counts.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_is_hot"))
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    on = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    borders = quantile_borders(census.join(hot, on, "left_semi"), at, min(MAX_SLICES, max(2, math.ceil(hot_rows / slice_rows))))
    if census is not df:
        df = settle(df)
    marked = df.join(hot, on, "left").drop(*[f"_h_{k}" for k in keys])
    hot_flag = F.coalesce(F.col("_is_hot"), F.lit(False))
    out = marked.withColumns(
        {
            SLICE: F.when(any_null, spread).when(hot_flag, bucket_of(F.col(at), borders)).otherwise(F.lit(0)),
            HOT: hot_flag,
        }
    ).drop("_is_hot")
    return Sliced(out, True)
