"""From scored attempts to ranked, de-duplicated alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import action_rank
from ..functions.text import percent_text
from ..functions.timefn import MINUTE
from ..operators.dedup import anchors
from ..operators.joins import lookup
from ..operators.running import Running, running_over
from ..operators.slicing import DEFAULT_SLICE_ROWS, SLICE, Sliced, slice_hot_keys
from ..session import ensure_checkpoint_dir
from .hybrid import reasons

DEDUP_WINDOW_US = 15 * MINUTE
NOVELTY_ATTRS = ("country", "asn", "device")


def novelty(attempts: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``row_id, attribute, new_value, usual_value, usual_count`` per attribute never used before.

    The usual value is the most frequent one among earlier successes (the one seen first
    on a tie).  Counts only grow, so it is the running maximum over the counts each
    success reached - no per-account value table is collected.
    """
    value = {
        "country": F.col("country"),
        "asn": F.concat(F.lit("AS"), F.col("asn").cast("string")),
        "device": F.when(F.col("device_type") != "unknown", F.col("device_type")),
    }
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), value[a].alias("value")) for a in NOVELTY_ATTRS])
    long = attempts.where("uid IS NOT NULL").select("row_id", "t", "uid", "success", F.explode(pairs).alias("p"))
    long = long.select("row_id", "t", "uid", "success", "p.attribute", "p.value")
    keys, order = ["uid", "attribute"], ["t", "row_id"]
    ok = F.col("success")
    sliced = slice_hot_keys(long, keys, "t", slice_rows=slice_rows, spread_by="row_id", census=long.select(*keys, "t"))
    sliced = Sliced(sliced.df.repartition(*keys, SLICE), sliced.cut)
    counted = running_over(
        sliced,
        keys,
        order,
        [
            Running("_seen", "sum", ok.cast("int"), "before"),
            Running("_count", "sum", ok.cast("int"), "upto"),
            Running("_first", "min", F.when(ok, F.struct("t", "row_id")), "upto"),
        ],
        sub=["value"],
    )
    reached = F.when(
        ok & F.col("value").isNotNull(),
        F.struct(F.col("_count").alias("n"), (-F.col("_first.t")).alias("ft"), (-F.col("_first.row_id")).alias("fr"), F.col("value").alias("value")),
    )
    out = running_over(
        Sliced(counted, sliced.cut), keys, order, [Running("_usual", "max", reached, "before"), Running("_successes", "sum", ok.cast("int"), "before")]
    )
    new = F.col("value").isNotNull() & (F.coalesce(F.col("_seen"), F.lit(0)) == 0) & (F.col("_successes") > 0)
    return out.where(new).select(
        "row_id",
        "attribute",
        F.col("value").alias("new_value"),
        F.col("_usual.value").alias("usual_value"),
        F.coalesce(F.col("_usual.n"), F.lit(0)).alias("usual_count"),
    )


def novelty_text(f: Column) -> Column:
    first = F.concat(F.lit("First time with this "), f["attribute"], F.lit(" ("), f["new_value"], F.lit(")"))
    return F.when(f["usual_value"].isNull(), first).otherwise(
        F.concat(first, F.lit(", before "), f["usual_value"], F.lit(" "), f["usual_count"].cast("string"), F.lit(" times"))
    )


def with_novelty(scored: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach novelty facts as an ordered array (country, network, device)."""
    rank = F.when(F.col("attribute") == "country", 0).when(F.col("attribute") == "asn", 1).otherwise(2)
    packed = facts.withColumn("rank", rank).groupBy(F.col("row_id").alias("_n")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "attribute", "new_value", "usual_value", "usual_count"))).alias("novelty")
    )
    empty = F.array().cast("array<struct<rank:int,attribute:string,new_value:string,usual_value:string,usual_count:bigint>>")
    return scored.join(packed, F.col("row_id") == F.col("_n"), "left").withColumn("novelty", F.coalesce("novelty", empty)).drop("_n")


def priority(n_novel: Column, confidence: Column, importance: Column) -> Column:
    """(1 + novel facets) x confidence x importance, 4 decimals."""
    return F.bround((n_novel + 1) * F.coalesce(confidence, F.lit(0.0)) * importance, 4)


def message(occurrences: Column) -> Column:
    """Alert sentence: score, top reasons, first novelty fact, family, repeats."""
    head = F.concat(
        F.lit("Risk "), F.col("score").cast("string"), F.lit("/100, suggested action '"), F.col("action"), F.lit("': "), reasons(3), F.lit(".")
    )
    fact = F.when(F.size("novelty") > 0, F.concat(novelty_text(F.try_element_at(F.col("novelty"), F.lit(1))), F.lit(".")))
    fam = F.when(
        F.col("family").isNotNull(),
        F.concat(F.lit("Suggested family: "), F.col("family"), F.coalesce(F.concat(F.lit(" ("), percent_text(F.col("confidence")), F.lit(")")), F.lit("")), F.lit(".")),
    )
    repeat = F.when(occurrences > 1, F.concat(F.lit("Repeated "), occurrences.cast("string"), F.lit(" times within 15 minutes.")))
    return F.concat_ws(" ", head, fact, fam, repeat)


def group_key() -> Column:
    """Alerts are merged per account, or per address when the account is unknown."""
    return F.coalesce(F.concat(F.lit("u:"), F.col("uid").cast("string")), F.concat(F.lit("ip:"), F.col("ip")))


def _anchored(alerts: DataFrame, chunk_us: int | None = None) -> tuple[DataFrame, int]:
    """Alerts with their group's first time, and how many there are.

    Alerts are few next to the attempts they come from and are read several times here,
    so they are written once to the shared checkpoint folder instead of rescoring the log.
    """
    ensure_checkpoint_dir(alerts.sparkSession)
    keyed = alerts.where("family IS NOT NULL").withColumn("dedup_key", group_key()).checkpoint()
    rows = keyed.count()
    return keyed.join(anchors(keyed, ["dedup_key", "family"], DEDUP_WINDOW_US, chunk_us=chunk_us, total_rows=rows), "row_id"), rows


def dedup(alerts: DataFrame, *, chunk_us: int | None = None) -> DataFrame:
    """Merge alerts of one key and family until 15 minutes after the group's first event.

    ``alerts``: ``row_id, t, uid, ip, family, score, action, priority``.
    """
    joined, _ = _anchored(alerts.select("row_id", "t", "uid", "ip", "family", "score", "action", "priority"), chunk_us)
    worst = F.max(F.struct(action_rank(F.col("action")).alias("r"), F.col("action").alias("a")))
    merged = joined.groupBy("dedup_key", "family", "anchor_t").agg(
        F.min(F.struct("t", "row_id")).alias("_f"),
        F.max("t").alias("last_seen_t"),
        F.count(F.lit(1)).alias("occurrences"),
        F.max("score").alias("risk_score"),
        worst.alias("_w"),
        F.max("priority").alias("priority"),
    )
    return merged.select(
        F.col("_f.row_id").alias("alert_id"), "dedup_key", "family", F.col("anchor_t").alias("first_seen_t"), "last_seen_t",
        "occurrences", "risk_score", F.col("_w.a").alias("action"), "priority",
    )


def escalations(alerts: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Alerts that open a group or raise its action: the ones that trigger a response."""
    anchored, rows = _anchored(alerts)
    keys = ["dedup_key", "family", "anchor_t"]
    sliced = slice_hot_keys(anchored, keys, "t", slice_rows=slice_rows, total_rows=rows, spread_by="row_id")
    out = running_over(sliced, keys, ["t", "row_id"], [Running("_worst", "max", action_rank(F.col("action")), "prior_rows")])
    rank = action_rank(F.col("action"))
    return out.where(F.col("action").isin("step_up", "lock") & (F.col("_worst").isNull() | (rank > F.col("_worst")))).select(*alerts.columns)


def occurrences(alerts: DataFrame, *, chunk_us: int | None = None, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``row_id, occurrences``: which alert of its group (see ``dedup``) each one is, counted in the order of time."""
    anchored, rows = _anchored(alerts.select("row_id", "t", "uid", "ip", "family"), chunk_us)
    keys = ["dedup_key", "family", "anchor_t"]
    sliced = slice_hot_keys(anchored, keys, "t", slice_rows=slice_rows, total_rows=rows, spread_by="row_id")
    return running_over(sliced, keys, ["t", "row_id"], [Running("occurrences", "sum", F.lit(1), "through_row")]).select("row_id", "occurrences")


def with_occurrences(alerts: DataFrame, *, chunk_us: int | None = None, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Add ``occurrences``; an alert without a family is merged with no other."""
    ensure_checkpoint_dir(alerts.sparkSession)
    kept = alerts.checkpoint()  # read twice: the log is not scored again
    counted = occurrences(kept, chunk_us=chunk_us, slice_rows=slice_rows).withColumnRenamed("row_id", "_o")
    return kept.join(counted, F.col("row_id") == F.col("_o"), "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(1))).drop("_o")


def apply_verdicts(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Alert status from the latest verdict (``alert_id, verdict, t``); open when there is none."""
    latest = verdicts.groupBy(F.col("alert_id").alias("_a")).agg(F.max_by("verdict", F.struct("t", "verdict")).alias("_v"))
    status = F.when(F.col("_v") == "false_positive", "false_positive").when(F.col("_v") == "correct", "resolved").otherwise("open")
    return alerts.join(latest, F.col("alert_id") == F.col("_a"), "left").withColumn("status", status).drop("_a", "_v")


def verdict_audit(verdicts: DataFrame) -> DataFrame:
    """One audit row per verdict."""
    return verdicts.select(
        F.lit("admin").alias("actor"), F.concat(F.lit("alert_feedback_"), F.col("verdict")).alias("action"), F.col("alert_id").alias("target_id"), "t"
    )


# ---------------------------------------------------------------------- views


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def events_view(
    attempts: DataFrame, *, name_like: str | None = None, success: bool | None = None, band: str | None = None, number: int = 1, size: int = 50
) -> DataFrame:
    """Filtered attempts, newest first, one page, with the total number of matches."""
    out = attempts
    if name_like is not None:
        out = out.where(F.col("username").ilike(f"%{name_like}%"))
    if success is not None:
        out = out.where(F.col("success") == success)
    if band == "low":
        out = out.where("score < 40")
    elif band == "medium":
        out = out.where("score BETWEEN 40 AND 70")
    elif band == "high":
        out = out.where("score > 70")
    total = out.agg(F.count(F.lit(1)).alias("total"))
    return page(out, [F.desc("t"), F.desc("row_id")], number, size).join(F.broadcast(total))


def alerts_view(alerts: DataFrame, *, sort: str = "priority", filters: dict[str, str] | None = None, number: int = 1, size: int = 50) -> DataFrame:
    out = alerts
    for column, value in (filters or {}).items():
        out = out.where(F.col(column) == value)
    newest = [F.desc("last_seen_t"), F.desc("alert_id")]
    order = [F.desc_nulls_last("priority"), *newest] if sort == "priority" else newest
    return page(out, order, number, size)


def newest_per_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n newest rows of each key, found in two rounds so that a hot key is not one sort."""
    part = F.pmod(F.xxhash64("row_id"), F.lit(32))
    local = Window.partitionBy(key, "_part").orderBy(F.desc("t"), F.desc("row_id"))
    total = Window.partitionBy(key).orderBy(F.desc("t"), F.desc("row_id"))
    first = df.withColumn("_part", part).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    return first.withColumn("rank", F.row_number().over(total)).where(F.col("rank") <= n).drop("_part", "_r")


def user_profile(attempts: DataFrame, alerts: DataFrame, *, n_attempts: int = 50, n_alerts: int = 20) -> DataFrame:
    """One row per account: its newest attempts and alerts, devices, locations, counts."""
    known = attempts.where("uid IS NOT NULL")
    recent = newest_per_key(known.select("uid", "t", "row_id"), "uid", n_attempts).groupBy("uid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("recent_attempts")
    )
    flagged = newest_per_key(alerts.where("uid IS NOT NULL").select("uid", "t", "row_id"), "uid", n_alerts).groupBy("uid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("recent_alerts")
    )
    ok = known.where("success")
    devices = ok.where("ua IS NOT NULL").select("uid", "ua").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("devices"))
    places = ok.where("country IS NOT NULL").select("uid", "country").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("locations"))
    out = recent.join(flagged, "uid", "left").join(devices, "uid", "left").join(places, "uid", "left")
    return out.withColumns(
        {
            "recent_alerts": F.coalesce("recent_alerts", F.array().cast("array<bigint>")),
            "devices": F.coalesce("devices", F.lit(0)),
            "locations": F.coalesce("locations", F.lit(0)),
        }
    )
