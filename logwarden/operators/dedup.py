"""Anchored de-duplication: merge into the open group until ``window`` after its first event.

The group is anchored at its first event, so it is not a gap session: the next group
starts at the first event later than anchor + window.  Chains are followed per key and
time chunk in parallel; between chunks only each chunk's entry -> exit step function is
handed on (how the anchor that is open on entry decides the anchor open on exit).  Python sees
distinct times only; rows get their anchor by a running maximum.

A call of Python per key and chunk costs a millisecond whatever it holds, and most keys hold a
few times: keys of at most ``fold_times`` distinct times are followed by one fold over their
sorted times inside the aggregation, only longer keys go to Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import Running, running
from .slicing import DEFAULT_SLICE_ROWS

NONE = -(1 << 62)  # no open anchor yet
FOLD_TIMES = 2_000


def _next_after(t: np.ndarray, window: int) -> np.ndarray:
    """Index of the first event later than each event's time + window (len(t) if none)."""
    return np.searchsorted(t, t + window, side="right")


def _exits(t: np.ndarray, window: int) -> np.ndarray:
    """The last anchor of the chain that starts at each event."""
    nxt = _next_after(t, window)
    out = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if nxt[i] < len(t):
            out[i] = out[nxt[i]]
    return out


def _fold(times: str, window: int) -> Column:
    """The anchors among the ascending ``times`` of one key."""

    def step(found: Column, t: Column) -> Column:
        inside = F.coalesce(t <= F.try_element_at(found, F.lit(-1)) + window, F.lit(False))
        return F.when(inside, found).otherwise(F.concat(found, F.array(t)))

    return F.aggregate(times, F.array().cast("array<bigint>"), step)


def anchors(df: DataFrame, keys: list[str], window_us: int, *, chunk_us: int | None = None, t: str = "t", row_id: str = "row_id", slice_rows: int = DEFAULT_SLICE_ROWS, total_rows: int | None = None, fold_times: int = FOLD_TIMES) -> DataFrame:
    """``row_id, anchor_t``: the time of the first event of the group each row belongs to."""
    chunk = chunk_us or 96 * window_us
    slim = df.select(row_id, t, *keys).withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    slim = slim.select(F.col(row_id).alias("row_id"), F.col(t).alias("t"), F.col("_k").alias("k"), F.expr(f"{t} div {chunk}").alias("c"))

    # identical instants do not change the chain: one row per (key, time) is enough
    distinct = slim.select("k", "c", "t").distinct()
    long_keys = distinct.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_times).select("k")
    few = distinct.join(long_keys, "k", "left_anti").groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("_ts"))
    folded = few.select("k", F.explode(_fold("_ts", window_us)).alias("anchor_t"))
    times = distinct.join(long_keys, "k", "left_semi")

    def step_function(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["t"].to_numpy(np.int64))
        start = int(pdf["c"].iloc[0]) * chunk
        exits = _exits(ts, window_us)
        # an entry anchor lies before the chunk: it can only hide events up to start + window
        last = int(np.searchsorted(ts, start + window_us, side="left"))
        reach = ts[: min(last + 1, len(ts))]
        ex = exits[: len(reach)]
        keep = np.append(ex[1:] != ex[:-1], True)  # one row per run of equal exits
        return pd.DataFrame({"k": pdf["k"].iloc[0], "c": pdf["c"].iloc[0], "upto": reach[keep], "exit": ex[keep]})

    steps = times.groupBy("k", "c").applyInPandas(step_function, "k string, c bigint, upto bigint, exit bigint")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["k"].iloc[0]
        entry, out = NONE, []
        for c, g in pdf.sort_values(["c", "upto"]).groupby("c", sort=True):
            out.append((k, c, entry))
            upto, ex = g["upto"].to_numpy(), g["exit"].to_numpy()
            # the first event later than entry + window belongs to the first run reaching beyond it
            i = int(np.searchsorted(upto, entry + window_us, side="right"))
            if i < len(upto):
                entry = int(ex[i])
        return pd.DataFrame(out, columns=["k", "c", "entry"])

    entries = steps.groupBy("k").applyInPandas(chain, "k string, c bigint, entry bigint")

    def starts(key, pdf: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["t"].to_numpy(np.int64))
        entry = int(seed["entry"].iloc[0])
        found = []
        i = int(np.searchsorted(ts, entry + window_us, side="right")) if entry != NONE else 0
        nxt = _next_after(ts, window_us)
        while i < len(ts):
            found.append(int(ts[i]))
            i = int(nxt[i])
        return pd.DataFrame({"k": key[0], "anchor_t": np.array(found, dtype=np.int64)})

    begun = times.groupBy("k", "c").cogroup(entries.groupBy("k", "c")).applyInPandas(starts, "k string, anchor_t bigint").unionByName(folded)
    # rows take the latest start so far; a hot key is sliced like any other running value
    rows = slim.select("k", "t", "row_id", F.lit(None).cast("bigint").alias("_start"))
    marks = begun.select("k", F.col("anchor_t").alias("t"), F.lit(None).cast("bigint").alias("row_id"), F.col("anchor_t").alias("_start"))
    total = total_rows if total_rows is not None else df.count()
    out = running(rows.unionByName(marks), ["k"], ["t", "row_id"], [Running("anchor_t", "max", F.col("_start"), "upto")], slice_rows=slice_rows, total_rows=total, census=slim.select("k", "t"))
    return out.where("row_id IS NOT NULL").select("row_id", "anchor_t")
