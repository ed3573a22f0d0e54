"""Blocklist matching and maintenance.

Entries: ``kind (ip|cidr|asn|username), value, reason, added_by, expires_at BIGINT µs?``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cidr_bounds, ip_to_long, long_to_ip
from ..functions.timefn import MINUTE
from ..operators.joins import BLOCK_BITS, lookup, per_block

KINDS = ("ip", "cidr", "asn", "username")
LOCK_TTL_US = 30 * MINUTE


def active(entries: DataFrame, now_us: Column) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now_us))


def normalize(kind: Column, value: Column) -> Column:
    v = F.trim(value)
    lo, hi = cidr_bounds(v)
    bits = F.lit(32) - F.bround(F.log2((hi - lo + 1).cast("double")), 0).cast("int")
    return (
        F.when(kind == "cidr", F.concat(long_to_ip(lo), F.lit("/"), bits.cast("string")))
        .when(kind == "asn", F.regexp_replace(F.upper(v), "^AS", "").try_cast("bigint").cast("string"))
        .when(kind == "username", F.lower(v))
        .otherwise(v)
    )


def match(attempts: DataFrame, entries: DataFrame) -> DataFrame:
    """The live entry each attempt matches, by priority ip, cidr, asn, username.

    Only matched attempts are returned: ``row_id, kind, value, reason, expires_at``.
    """
    facts = attempts.select("row_id", "t", "ip", "asn", "username")
    e = entries.select("kind", "value", "reason", "expires_at")
    live = F.col("expires_at").isNull() | (F.col("t") < F.col("expires_at"))
    cols = ["row_id", "rank", "kind", "value", "reason", "expires_at"]

    # one equi join for the three exact kinds: each attempt offers one candidate per kind
    offers = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("ip").alias("k"), F.col("ip").alias("v")),
        F.struct(F.lit(2).alias("rank"), F.lit("asn").alias("k"), F.col("asn").cast("string").alias("v")),
        F.struct(F.lit(3).alias("rank"), F.lit("username").alias("k"), F.lower("username").alias("v")),
    )
    offered = facts.select("row_id", "t", F.explode(offers).alias("o")).select("row_id", "t", "o.*").where("v IS NOT NULL")
    exact = lookup(offered, e.where("kind <> 'cidr'"), [("k", "kind"), ("v", "value")], extra=live, how="inner").select(*cols)

    lo, hi = cidr_bounds(F.col("value"))
    nets = per_block(e.where("kind = 'cidr'").withColumns({"lo": lo, "hi": hi}).where("lo IS NOT NULL"))
    placed = facts.select("row_id", "t", ip_to_long(F.col("ip")).alias("_ipn")).withColumn("_at", F.expr(f"_ipn div {1 << BLOCK_BITS}"))
    by_net = lookup(placed, nets, [("_at", "block")], extra=live & F.col("_ipn").between(F.col("lo"), F.col("hi")), how="inner")
    found = exact.unionByName(by_net.withColumn("rank", F.lit(1)).select(*cols))
    best = found.groupBy("row_id").agg(F.min(F.struct("rank", "value", "kind", "reason", "expires_at")).alias("m"))
    return best.select("row_id", "m.kind", "m.value", "m.reason", "m.expires_at")


def lock_entries(locks: DataFrame) -> DataFrame:
    """Blocklist entries for lock actions: the account if it exists, else the address.

    ``locks``: ``t, uid, username, ip`` of attempts whose lock is new or escalated.
    Repeated locks extend the entry and never shorten it.
    """
    keyed = locks.select(
        F.when(F.col("uid").isNotNull(), "username").otherwise("ip").alias("kind"),
        F.when(F.col("uid").isNotNull(), F.col("username")).otherwise(F.col("ip")).alias("value"),
        (F.col("t") + LOCK_TTL_US).alias("until"),
    )
    return keyed.groupBy("kind", "value").agg(F.max("until").alias("expires_at"), F.count(F.lit(1)).alias("locks"))


def extend(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Merge new entries into existing ones: later expiry wins, no expiry is final."""
    cols = ["kind", "value", "expires_at"]
    both = entries.select(*cols).unionByName(new.select(*cols))
    forever = F.max(F.col("expires_at").isNull())
    return both.groupBy("kind", "value").agg(F.when(~forever, F.max("expires_at")).alias("expires_at"))


def apply_operations(entries: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply add/remove operations (``t, seq, op, kind, value, reason, actor, expires_at``).

    Returns the resulting entries and one audit row per operation.
    """
    keys = ["kind", "value"]
    latest = (
        ops.groupBy(*keys)
        .agg(F.max(F.struct("t", "seq", "op", "reason", F.col("actor").alias("added_by"), "expires_at")).alias("o"))
        .select(*keys, "o.op", "o.reason", "o.added_by", "o.expires_at")
    )
    kept = entries.join(latest.select(*keys), keys, "left_anti").select(*keys, "reason", "added_by", "expires_at")
    added = latest.where("op = 'add'").select(*keys, "reason", "added_by", "expires_at")
    audit = ops.select(
        "t", F.col("actor"), F.concat(F.lit("blocklist_"), F.col("op")).alias("action"), F.concat_ws(":", "kind", "value").alias("target")
    )
    return kept.unionByName(added), audit
