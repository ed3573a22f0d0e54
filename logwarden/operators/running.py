"""Running totals per key that survive a hot key.

For ordinary keys this is one Spark window per ordering.  Rows of keys that
``slicing`` cut are windowed per slice, and the totals of the earlier slices of the
same key - one pre-aggregated row per slice - are joined back in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slicing import DEFAULT_SLICE_ROWS, HOT, SLICE, Sliced, settle, slice_hot_keys

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}

# frame name -> (uses value ordering, upper bound)
_FRAMES = {"before": (True, -1), "upto": (True, 0), "prior_rows": (False, -1), "through_row": (False, 0)}


@dataclass(frozen=True)
class Running:
    """One running aggregate.

    ``frame``: ``before`` = strictly smaller order value, ``upto`` = smaller or equal
    (same-instant rows see each other), ``prior_rows`` / ``through_row`` = row order.
    """

    name: str
    op: str
    value: Column
    frame: str = "before"


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    return (F.least if op == "min" else F.greatest)(carry, local) if op in ("min", "max") else local


def running_over(sliced: Sliced, keys: list[str], order: list[str], aggs: list[Running], sub: list[str] | None = None) -> DataFrame:
    """Running aggregates on an already sliced frame.

    ``order[0]`` is the value the slices were cut on; the rest breaks ties.  ``sub``
    refines the key without a further exchange.
    """
    part = [*keys, *(sub or []), SLICE]
    by_value = Window.partitionBy(*part).orderBy(order[0])
    by_row = Window.partitionBy(*part).orderBy(*order)
    columns = {}
    for a in aggs:
        value_order, upper = _FRAMES[a.frame]
        w = by_value.rangeBetween(Window.unboundedPreceding, upper) if value_order else by_row.rowsBetween(Window.unboundedPreceding, upper)
        columns[a.name] = _FOLD[a.op](a.value).over(w)
    out = sliced.df.withColumns(columns)
    if not sliced.cut:
        return out

    totals = sliced.df.where(HOT).groupBy(*part).agg(*[_FOLD[a.op](a.value).alias(a.name) for a in aggs])
    earlier = Window.partitionBy(*keys, *(sub or [])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(p).alias(f"_k_{p}") for p in part],
        *[_FOLD[a.op](F.col(a.name)).over(earlier).alias(f"_c_{a.name}") for a in aggs],
    )
    on = reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(f"_k_{p}")) for p in part])
    return settle(
        out.join(carry, on, "left")
        .withColumns({a.name: _combine(a.op, F.col(f"_c_{a.name}"), F.col(a.name)) for a in aggs})
        .drop(*[f"_k_{p}" for p in part], *[f"_c_{a.name}" for a in aggs])
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: list[Running],
    *,
    slice_rows: int = DEFAULT_SLICE_ROWS,
    total_rows: int | None = None,
    census: DataFrame | None = None,
) -> DataFrame:
    """Running aggregates per ``keys`` (an empty list means one global order)."""
    work, names = df, list(keys)
    if not names:
        work, names = df.withColumn("_all", F.lit(1)), ["_all"]
        census = None if census is None else census.withColumn("_all", F.lit(1))
    sliced = slice_hot_keys(work, names, order[0], slice_rows=slice_rows, total_rows=total_rows, spread_by=order[-1], census=census)
    out = running_over(sliced, names, order, aggs)
    return out.drop(SLICE, HOT, "_all")


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    *,
    name: str = "prev",
    when: Column | None = None,
    slice_rows: int = DEFAULT_SLICE_ROWS,
    total_rows: int | None = None,
) -> DataFrame:
    """The latest earlier row of the same key (for which ``when`` holds) as a struct."""
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns if c not in order])
    value = packed if when is None else F.when(when, packed)
    return running(df, keys, order, [Running(name, "max", value, "prior_rows")], slice_rows=slice_rows, total_rows=total_rows)
