"""The distinct values seen in a window, newest first."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slicing import HOT, SLICE, slice_hot_keys


def sliding_values(
    df: DataFrame,
    key: str,
    value: Column,
    window_us: int,
    *,
    limit: int | None = None,
    when: Column | None = None,
    slice_rows: int = 500_000,
    total_rows: int | None = None,
) -> DataFrame:
    """``row_id, values``: the distinct values with a sighting in (t-w, t], newest first (ties by ``row_id``); with ``limit`` only so many.

    A group is one key, or one time slice of a hot key.  What a slice must know of the
    past are the values still alive at its start; those are handed on from per-slice
    summaries of one row per value.
    """
    live = value.isNotNull() if when is None else value.isNotNull() & when
    base = df.where(F.col(key).isNotNull()).select("row_id", "t", F.col(key).alias("k"), F.when(live, value.cast("string")).alias("v"))
    sliced = slice_hot_keys(base, ["k"], "t", slice_rows=slice_rows, total_rows=total_rows, spread_by="row_id")
    rows = sliced.df.withColumnRenamed(SLICE, "s").withColumnRenamed(HOT, "hot")

    def walk(pdf: pd.DataFrame, seed: list[tuple[str, int]]) -> list[list[str]]:
        recent: OrderedDict[str, int] = OrderedDict(seed)
        out = []
        for t, v in zip(pdf["t"], pdf["v"]):
            if v is not None:
                recent.pop(v, None)
                recent[v] = t
                if limit is not None and len(recent) > limit:
                    recent.popitem(last=False)
            while recent and next(iter(recent.values())) <= t - window_us:
                recent.popitem(last=False)
            out.append(list(reversed(recent)))
        return out

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "row_id"])
        return pd.DataFrame({"row_id": pdf["row_id"], "values": walk(pdf, [])})

    schema = "row_id bigint, values array<string>"
    if not sliced.cut:
        return rows.select("row_id", "t", "k", "s", "v").groupBy("k", "s").applyInPandas(alone, schema)

    latest = rows.where("hot AND v IS NOT NULL").groupBy("k", "s", "v").agg(F.max(F.struct("t", "row_id")).alias("m")).select("k", "s", "v", "m.t", "m.row_id")
    newest = Window.partitionBy("k", "s").orderBy(F.desc("t"), F.desc("row_id"))
    summary = latest if limit is None else latest.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= limit).drop("r")
    slices = rows.where("hot").select(F.col("k").alias("k"), F.col("s").alias("s")).distinct()

    def hand_on(key_, summaries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        recent: OrderedDict[str, tuple[int, int]] = OrderedDict()
        by_slice = {s: g.sort_values(["t", "row_id"]) for s, g in summaries.groupby("s")}
        out = []
        for s in sorted(targets["s"]):
            out += [(key_[0], s, v, t, r) for v, (t, r) in recent.items()]
            if s in by_slice:
                seen = by_slice[s]
                for v, t, r in zip(seen["v"], seen["t"], seen["row_id"]):
                    recent.pop(v, None)
                    recent[v] = (t, r)
                newest_t = int(seen["t"].max())
                while recent and (next(iter(recent.values()))[0] <= newest_t - window_us or (limit is not None and len(recent) > limit)):
                    recent.popitem(last=False)
        return pd.DataFrame(out, columns=["k", "s", "v", "t", "row_id"])

    key_type = dict(rows.dtypes)["k"]
    seeds = summary.groupBy("k").cogroup(slices.groupBy("k")).applyInPandas(hand_on, f"k {key_type}, s int, v string, t bigint, row_id bigint")

    def seeded(pdf: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "row_id"])
        seed = seed.sort_values(["t", "row_id"])
        return pd.DataFrame({"row_id": pdf["row_id"], "values": walk(pdf, list(zip(seed["v"], seed["t"])))})

    return rows.select("row_id", "t", "k", "s", "v").groupBy("k", "s").cogroup(seeds.groupBy("k", "s")).applyInPandas(seeded, schema)
