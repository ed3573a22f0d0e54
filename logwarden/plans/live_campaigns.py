"""Live campaigns: alerts get a campaign in the order in which they come.

An alert is linked to the earlier alerts of other accounts on its address or network
within the window (alerts of unknown accounts are others to everybody).  If one of them
has a campaign by then, the alert joins the campaign of the earliest such; if they have
none, it opens one.  Either way, linked alerts without a campaign are pulled in.  Two
campaigns are never merged, so the result depends on the order of the alerts.

The order is resolved without replaying it.  Within one address (or network), in time
order, a *run* is a stretch of rows of one account:

* an alert has links if the row before its run is inside the window;
* an alert without links is pulled in by the first later row outside its run;
* all linked rows before the run that directly precedes an alert have a campaign by
  then, because a row of that run (or one in between) linked them.  Rows of that very
  run have one if they have links themselves or were pulled in through the other key.

So every alert points to one alert that decides its campaign, and pointers end at the
alerts that opened one.  Runs, their neighbours and the earliest row of a window are
running values (a hot address is sliced); a run is followed by one alert only, so the
rows looked at twice are at most all rows; pointers are followed by doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import DAY
from ..operators.running import Running, running_over
from ..operators.slicing import DEFAULT_SLICE_ROWS, HOT, SLICE, Sliced, settle, slice_hot_keys

KEYS = ("ip", "asn")


def _account() -> Column:
    """Rows of unknown accounts are accounts of their own."""
    return F.coalesce(F.concat(F.lit("u"), F.col("uid").cast("string")), F.concat(F.lit("?"), F.col("row_id").cast("string")))


def _before(a: Column, b: Column) -> Column:
    """a stands before b, for (t, row_id) structs."""
    return (a["t"] < b["t"]) | ((a["t"] == b["t"]) & (a["row_id"] < b["row_id"]))


def neighbours(alerts: DataFrame, key: str, window_us: int, *, slice_rows: int, total_rows: int) -> DataFrame:
    """``row_id, linked, next, early`` within one key.

    ``linked``: an earlier row of another account lies in the window.  ``next``: the first later row of another account
    (t, row_id).  ``early``: the earliest row of another account in the window that stands before the directly preceding run.
    """
    rows = alerts.where(F.col(key).isNotNull()).select("row_id", "t", F.col(key).alias("k"), _account().alias("acct"))
    place = F.struct("t", "row_id")
    sliced = slice_hot_keys(rows, ["k"], "t", slice_rows=slice_rows, total_rows=total_rows, spread_by="row_id")

    def step(df: DataFrame, aggs: list[Running]) -> DataFrame:
        return running_over(Sliced(df, sliced.cut), ["k"], ["t", "row_id"], aggs)

    work = step(sliced.df, [Running("_prev", "max", F.struct("t", "row_id", "acct"), "prior_rows")])
    starts = F.col("_prev").isNull() | (F.col("_prev.acct") != F.col("acct"))
    work = step(work, [Running("_run", "max", F.when(starts, F.struct("t", "row_id", "_prev")), "through_row")])
    work = step(work, [Running("_back", "max", F.struct("t", "row_id", F.struct("_run.t", "_run.row_id").alias("start")), "prior_rows")])
    first = F.col("_run.row_id") == F.col("row_id")
    known = work.select(
        "row_id", "t", "k", "acct", first.alias("first"),
        F.coalesce(F.col("_run._prev.t") >= F.col("t") - window_us, F.lit(False)).alias("linked"),
        F.when(first, F.col("_back.start")).alias("run_before"),
    )
    if sliced.cut:
        known = settle(known)

    # backwards in time; a question about the window's start stands behind the rows of that instant
    seen = known.select("k", (-F.col("t")).alias("at"), F.lit(0).alias("ask"), (-F.col("row_id")).alias("back"), "row_id", "t", "acct", "first", "linked", "run_before")
    asked = known.select("k", (F.lit(window_us) - F.col("t")).alias("at"), F.lit(1).alias("ask"), (-F.col("row_id")).alias("back"), "row_id", "t", "acct", "first", "linked", "run_before")
    late = slice_hot_keys(seen.unionByName(asked), ["k"], "at", slice_rows=slice_rows, total_rows=2 * total_rows, spread_by="row_id")
    order = ["at", "ask", "back"]
    row = F.col("ask") == 0
    both = running_over(late, ["k"], order, [Running("_next", "min", F.when(row & F.col("first"), place), "prior_rows")])
    both = running_over(Sliced(both, late.cut), ["k"], order, [Running("_e", "min", F.when(row, F.struct("t", "row_id", "acct", F.col("_next").alias("next"))), "prior_rows")])
    own = F.struct("t", "row_id")
    other = F.when(F.col("_e.acct") != F.col("acct"), F.struct("_e.t", "_e.row_id")).otherwise(F.when(_before(F.col("_e.next"), own), F.col("_e.next")))
    # in the run directly before the alert not every row has a campaign yet
    early = F.when(F.col("run_before").isNull() | _before(other, F.col("run_before")), other)
    nexts = both.where("ask = 0").select("row_id", "linked", F.col("_next").alias("next"))
    earliest = both.where("ask = 1").select("row_id", early.alias("early"))
    return nexts.join(earliest, "row_id").drop(SLICE, HOT)


def pointers(alerts: DataFrame, window_us: int = DAY, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``row_id, t, linked, to``: the alert that decides the alert's campaign, itself if it opens one, null without a campaign."""
    n = alerts.count()
    facts = [
        neighbours(alerts, key, window_us, slice_rows=slice_rows, total_rows=n).select("row_id", *[F.col(c).alias(f"{key}_{c}") for c in ("linked", "next", "early")])
        for key in KEYS
    ]
    place = F.struct("t", "row_id")
    rows = reduce(lambda df, f: df.join(f, "row_id", "left"), facts, alerts.select("row_id", "t"))
    linked = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{k}_linked"), F.lit(False)) for k in KEYS])
    near = [F.when(F.col(f"{k}_next.t") <= F.col("t") + window_us, F.col(f"{k}_next")) for k in KEYS]
    rows = settle(rows.select("row_id", "t", linked.alias("linked"), F.least(*near).alias("pulled_by"), *[x.alias(f"{k}_near") for k, x in zip(KEYS, near)], *[f"{k}_early" for k in KEYS]))
    # rows of the run before an alert that have a campaign when the alert comes
    runs = [rows.where((F.col(f"{k}_near").isNotNull()) & (F.col("linked") | _before(F.col("pulled_by"), F.col(f"{k}_near")))).select(F.col(f"{k}_near.row_id").alias("row_id"), place.alias("place")) for k in KEYS]
    recent = reduce(DataFrame.unionByName, runs).groupBy("row_id").agg(F.min("place").alias("recent"))
    joined = rows.join(recent, "row_id", "left")
    decided = F.least(*[F.col(f"{k}_early") for k in KEYS], F.col("recent"))
    to = F.when(F.col("linked"), F.coalesce(decided["row_id"], F.col("row_id"))).otherwise(F.col("pulled_by.row_id"))
    return joined.select("row_id", "t", "linked", to.alias("to"))


def _followed(pointed: DataFrame) -> DataFrame:
    """``row_id, campaign``: pointers followed to the end by doubling."""
    step = settle(pointed.where("to IS NOT NULL").select("row_id", "to"))
    while True:
        onward = step.select(F.col("row_id").alias("to"), F.col("to").alias("_far"))
        step = settle(step.join(onward, "to").select("row_id", F.col("_far").alias("to"), (F.col("_far") != F.col("to")).alias("_moved")))
        if step.where("_moved").isEmpty():
            return step.select("row_id", F.col("to").alias("campaign"))
        step = step.select("row_id", "to")


def assign(alerts: DataFrame, window_us: int = DAY, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``row_id, t, linked, to, campaign`` for alerts (``row_id, t, uid?, ip?, asn?``); the campaign is the id of the alert that opened it.

    Alerts that nothing links have none.  ``linked`` tells alerts that joined or opened a campaign from those pulled in,
    ``to`` is the alert that decided.
    """
    pointed = settle(pointers(alerts, window_us, slice_rows=slice_rows))
    return pointed.join(_followed(pointed), "row_id", "left")


def campaigns(alerts: DataFrame, assigned: DataFrame) -> DataFrame:
    """``campaign, label, first_seen, last_seen, alerts, accounts``.

    A campaign is first seen with the earliest alert that its opener pulled in, and last seen with the last alert that
    joined by a link.  It is named after the opener's network, or its address if the network is unknown.  Unknown accounts
    count as one.
    """
    members = assigned.where("campaign IS NOT NULL").join(alerts.select("row_id", "uid", "ip", "asn"), "row_id")
    opener = F.col("row_id") == F.col("campaign")
    label = F.when(F.col("asn").isNotNull(), F.concat(F.lit("ASN "), F.col("asn").cast("string"))).otherwise(F.concat(F.lit("IP "), F.col("ip")))
    per_account = members.groupBy("campaign", "uid").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(opener, label)).alias("label"),
        F.min(F.when(~F.col("linked") & (F.col("to") == F.col("campaign")), F.col("t"))).alias("first"),
        F.max(F.when(F.col("linked"), F.col("t"))).alias("last"),
    )
    return per_account.groupBy("campaign").agg(
        F.max("label").alias("label"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.sum("n").alias("alerts"),
        (F.count_if(F.col("uid").isNotNull()) + F.max(F.col("uid").isNull().cast("int"))).cast("bigint").alias("accounts"),
    )
