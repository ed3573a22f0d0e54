"""Campaigns: attempts linked by shared infrastructure within a time window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import DAY
from ..operators.components import connected_components
from ..operators.joins import lookup
from ..operators.running import Running, running
from ..operators.slicing import DEFAULT_SLICE_ROWS
from ..operators.sweep import Count, sweep

TAGS = {"ip": 0, "asn": 1}


def _sessions(nodes: DataFrame, key: str, window_us: int, *, slice_rows: int) -> DataFrame:
    """``row_id, session``: runs of the key whose consecutive gaps are at most the window.

    Within one key, being linked by some chain of steps <= window is the same as having
    no larger gap in between, so no pairs are needed.
    """
    own = nodes.where(F.col(key).isNotNull()).select("row_id", "t", F.col(key).alias("k"))
    own = running(own, ["k"], ["t", "row_id"], [Running("_prev", "max", F.col("t"), "prior_rows")], slice_rows=slice_rows)
    start = F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > window_us)
    opened = F.when(start, F.struct("t", "row_id"))
    own = running(own, ["k"], ["t", "row_id"], [Running("_open", "max", opened, "through_row")], slice_rows=slice_rows)
    return own.select("row_id", F.col("_open.row_id").alias("session"))


def correlate(nodes: DataFrame, windows_us: list[int], *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``window_us, row_id, campaign`` for nodes (``row_id, t, ip?, asn?``).

    Two nodes share a campaign if a chain of nodes connects them, each step on the same
    ip or the same asn and at most the window apart.  The campaign id is its smallest
    row id.  Events collapse to sessions first, so the graph holds one edge per pair of
    overlapping sessions rather than per event.
    """
    linked = []
    for i, w in enumerate(windows_us):
        by = {key: _sessions(nodes, key, w, slice_rows=slice_rows) for key in TAGS}

        def node_id(key: str, i=i):
            return (F.col("session") * 2 + TAGS[key]) * len(windows_us) + i

        ip = by["ip"].select("row_id", node_id("ip").alias("ip_node"))
        asn = by["asn"].select("row_id", node_id("asn").alias("asn_node"))
        linked.append(nodes.select("row_id").join(ip, "row_id", "left").join(asn, "row_id", "left").withColumn("window_us", F.lit(w)))
    events = reduce(DataFrame.unionByName, linked)
    events = events.withColumn("node", F.coalesce("ip_node", "asn_node"))
    edges = events.where("node IS NOT NULL").select(F.col("node").alias("a"), F.coalesce("asn_node", "node").alias("b")).distinct()
    comp = connected_components(edges)
    smallest = events.where("node IS NOT NULL").groupBy("node").agg(F.min("row_id").alias("first_row"))
    named = comp.join(smallest, "node", "left")
    names = named.groupBy("component").agg(F.min("first_row").alias("campaign"))
    table = lookup(named.select("node", "component"), names.withColumnRenamed("component", "_c"), [("component", "_c")], how="inner")
    table = table.select(F.col("node").alias("_node"), "campaign")
    out = lookup(events, table, [("node", "_node")])
    return out.select("window_us", "row_id", F.coalesce("campaign", "row_id").alias("campaign"))


def summary(nodes: DataFrame, correlated: DataFrame) -> DataFrame:
    """Per window: campaigns, those with several victims, covered share, size of the largest, sizes of the three largest with several victims."""
    who = nodes.select("row_id", "uid")
    joined = correlated.join(who, "row_id")
    per = joined.groupBy("window_us", "campaign").agg(F.count(F.lit(1)).alias("n"))
    victims = joined.groupBy("window_us", "campaign", "uid").agg(F.lit(1).alias("x")).groupBy("window_us", "campaign").agg(
        (F.count_if(F.col("uid").isNotNull()) + F.max(F.col("uid").isNull().cast("int"))).alias("victims")
    )
    both = per.join(victims, ["window_us", "campaign"])
    multi = F.col("victims") >= 2
    # the rank filter keeps three rows per window and task before anything is shuffled
    rank = F.row_number().over(Window.partitionBy("window_us").orderBy(F.desc("n"), "campaign"))
    best = both.where(multi).withColumn("_r", rank).where(F.col("_r") <= 3)
    top = best.groupBy(F.col("window_us").alias("_w")).agg(F.sort_array(F.collect_list("n"), asc=False).alias("top"))
    sizes = both.groupBy("window_us").agg(
        F.count(F.lit(1)).alias("campaigns"),
        F.count_if(multi).alias("multi_victim"),
        F.round(F.sum(F.when(multi, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 6).alias("coverage_pct"),
        F.max("n").alias("largest"),
    )
    return sizes.join(F.broadcast(top), F.col("window_us") == F.col("_w"), "left").drop("_w").withColumn("top", F.coalesce("top", F.array().cast("array<bigint>")))


def infra_links(alerts: DataFrame, window_us: int = DAY, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """How many earlier alerts on other accounts share an alert's ip or network.

    Alerts on unknown accounts always count as others.  Counted by sliding windows:
    all alerts on the ip, minus those of the same account, and likewise for the
    network; an alert sharing both is counted once.
    """
    df = alerts.select("row_id", "t", "uid", "ip", "asn")
    n = df.count()
    kw = {"slice_rows": slice_rows, "total_rows": n, "boundary": "trailing"}
    w = window_us + 1  # the old end is closed: [t - w, t]
    df = sweep(df, "ip", [Count("_ip", w)], **kw)
    df = sweep(df, "asn", [Count("_asn", w)], **kw)
    df = sweep(df, ["ip", "asn"], [Count("_both", w)], **kw)
    df = sweep(df, ["uid", "ip"], [Count("_u_ip", w)], **kw)
    df = sweep(df, ["uid", "asn"], [Count("_u_asn", w)], **kw)
    df = sweep(df, ["uid", "ip", "asn"], [Count("_u_both", w)], **kw)

    # the alert itself is in every count; for an unknown account no count of its own applies
    def others(total: str, own: str):
        return F.coalesce(F.col(total), F.lit(0)) - F.when(F.col("uid").isNotNull(), F.coalesce(F.col(own), F.lit(0))).otherwise(
            F.when(F.col(total).isNotNull(), 1).otherwise(0)
        )

    by_ip, by_asn, by_both = others("_ip", "_u_ip"), others("_asn", "_u_asn"), others("_both", "_u_both")
    return df.select("row_id", by_ip.alias("same_ip"), by_asn.alias("same_asn"), (by_ip + by_asn - by_both).alias("linked"))


def targeted_accounts(members: DataFrame) -> DataFrame:
    """Per campaign: alerts, distinct accounts plus one bucket for unknown accounts, first and last time."""
    per_user = members.groupBy("campaign", "uid").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return per_user.groupBy("campaign").agg(
        F.sum("n").alias("alerts"),
        (F.count_if(F.col("uid").isNotNull()) + F.max(F.col("uid").isNull().cast("int"))).cast("bigint").alias("accounts"),
        F.min("a").alias("first_seen"),
        F.max("b").alias("last_seen"),
    )


def graph(members: DataFrame) -> DataFrame:
    """Distinct edges account - ip / asn / device per campaign."""
    account = F.when(F.col("uid").isNotNull(), F.col("username")).otherwise(F.concat(F.lit("? "), F.col("username")))
    targets = F.array_compact(
        F.array(
            F.when(F.col("ip").isNotNull(), F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("value"))),
            F.when(F.col("asn").isNotNull(), F.struct(F.lit("asn").alias("kind"), F.col("asn").cast("string").alias("value"))),
            F.when(F.col("device_type") != "unknown", F.struct(F.lit("device").alias("kind"), F.col("device_type").alias("value"))),
        )
    )
    return members.select("campaign", account.alias("account"), F.explode(targets).alias("x")).select("campaign", "account", "x.kind", "x.value").distinct()
