"""Counterfactual logins: what an attacker's login would have looked like.

A legitimate login (the anchor) is replaced by one with attributes of a donor - the next
success of another user - and its features are computed in a history without the anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import DAY, HOUR
from ..operators.asof import first_match
from ..operators.sweep import Count, sweep
from .features import Options, compute_features
from .quality import uniform

KINDS = {"naive": [], "vpn": ["country"], "targeted": ["asn"]}
ROW_ID_BASE = 1 << 40
COLUMNS = ["row_id", "t", "uid", "ip", "asn", "country", "ua", "browser", "os", "device_type", "success"]


def select_anchors(attempts: DataFrame, *, share: float, seed: int = 7, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Legitimate successes of accounts with an earlier success, uniform by row."""
    seen = sweep(attempts.select("row_id", "t", "uid", "success"), "uid", [Count("_n", None, F.col("success"))], boundary="open")
    out = attempts.join(seen.where("success AND _n >= 1").select("row_id"), "row_id", "left_semi")
    out = out.where("success AND NOT is_attack_ip AND NOT is_ato AND uid IS NOT NULL")
    if start_us is not None:
        out = out.where(F.col("t") >= start_us)
    if end_us is not None:
        out = out.where(F.col("t") < end_us)
    return out.where(uniform(F.col("row_id"), seed) < share)


def donors_for(anchors: DataFrame, attempts: DataFrame, *, kind: str, end_us: int | None = None) -> DataFrame:
    """Injected rows: the anchor's time and user with the donor's attributes.

    A targeted attacker copies the session profile and shows only a new address.
    Anchors without a donor within a day are dropped.  Every kind has row ids of its own.
    """
    same = KINDS[kind]
    pool = attempts.where("success AND uid IS NOT NULL")
    for c in same:
        pool = pool.where(F.col(c).isNotNull())
        anchors = anchors.where(F.col(c).isNotNull())
    end = None if end_us is None else F.lit(end_us)
    found = first_match(anchors.select("row_id", "t", "uid", *same), pool.select("row_id", "t", "uid", *same), same=same, horizons=[HOUR, DAY], period_end=end)
    found = found.where("donor_id IS NOT NULL").select("anchor_id", "donor_id", "tier")
    donor = pool.select(F.col("row_id").alias("donor_id"), *[F.col(c).alias(f"d_{c}") for c in COLUMNS[3:10]])
    anchor = anchors.select(F.col("row_id").alias("anchor_id"), *[c for c in COLUMNS if c != "row_id"])
    both = found.join(donor, "donor_id").join(anchor, "anchor_id")
    copied = ("country", "ua", "browser", "os", "device_type") if kind == "targeted" else ()
    attrs = [F.col(c if c in copied else f"d_{c}").alias(c) for c in COLUMNS[3:10]]
    return both.select(
        (F.col("anchor_id") + ROW_ID_BASE * (1 + list(KINDS).index(kind))).alias("row_id"), "t", "uid", *attrs, F.lit(True).alias("success"), "anchor_id", F.lit(kind).alias("attacker_type"), "tier"
    )


def counterfactual_features(attempts: DataFrame, injected: DataFrame, *, opt: Options = Options()) -> DataFrame:
    """Features of the injected rows over the log without the replaced anchors."""
    kept = attempts.join(injected.select(F.col("anchor_id").alias("row_id")), "row_id", "left_anti").select(*COLUMNS)
    combined = kept.unionByName(injected.select(*COLUMNS))
    return compute_features(combined, injected.select("row_id"), opt=opt)
