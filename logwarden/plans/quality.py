"""Log integrity, sampling, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import splits as sp
from ..operators.joins import lookup
from ..operators.running import Running, running



def log_integrity(df: DataFrame) -> DataFrame:
    """One row: counts, row-id range and gaps, backward time steps, contiguity."""
    prev = F.struct(F.col("row_id"), F.col("t"))
    out = running(df, [], ["row_id"], [Running("p", "max", prev, "prior_rows")])
    gap = F.col("row_id") - F.col("p.row_id") - 1
    back = F.col("p.t") - F.col("t")
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("row_id").alias("first_id"),
        F.max("row_id").alias("last_id"),
        F.coalesce(F.sum(F.when(gap > 0, gap)), F.lit(0)).alias("missing_ids"),
        F.count_if(gap > 0).alias("gaps"),
        F.count_if(back > 0).alias("backward_steps"),
        F.coalesce(F.max(F.when(back > 0, back)), F.lit(0)).alias("max_backward_us"),
        (F.max("row_id") - F.min("row_id") + 1 == F.count(F.lit(1))).alias("contiguous"),
    )


def first_gaps(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n ranges of missing row ids (a report)."""
    out = running(df, [], ["row_id"], [Running("p", "max", F.col("row_id"), "prior_rows")])
    gaps = out.where(F.col("row_id") - F.col("p") > 1).select((F.col("p") + 1).alias("gap_from"), (F.col("row_id") - 1).alias("gap_to"))
    return gaps.orderBy("gap_from").limit(n)


def user_stats(df: DataFrame) -> DataFrame:
    return df.where("uid IS NOT NULL").groupBy("uid").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_ato").alias("n_ato"))


def uniform(key: Column, seed: int) -> Column:
    """A reproducible uniform number in [0, 1) per key: 48 bits of an MD5 digest, which other engines can repeat."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def pick_users(stats: DataFrame, *, seed: int = 20260920, exclude_from: int | None = None) -> DataFrame:
    """Stratified sample of users; users with takeovers always.  ``exclude_from`` leaves out users of that many rows on; it is off."""
    s = (stats if exclude_from is None else stats.where(F.col("n_events") < exclude_from)).withColumns({"stratum": sp.stratum(F.col("n_events")), "forced": F.col("n_ato") > 0})
    s = s.withColumn("sample_rate", F.when(F.col("forced"), 1.0).otherwise(sp.stratum_rate(F.col("stratum"))))
    return s.where(F.col("forced") | (uniform(F.col("uid"), seed) < F.col("sample_rate"))).select("uid", "stratum", "sample_rate", "forced")


def sample_rows(df: DataFrame, picked: DataFrame) -> DataFrame:
    """Whole histories of the picked users."""
    return lookup(df, picked.withColumnRenamed("uid", "_u"), [("uid", "_u")], how="inner").drop("_u")


def with_partition(df: DataFrame, cut: sp.Cutoffs) -> DataFrame:
    out = df.withColumns({"split_time": sp.time_split(F.col("t"), cut), "ip_group": sp.ip_group(F.col("ip"))})
    out = out.withColumn("partition", sp.partition(F.col("split_time"), F.col("ip_group"), F.col("is_attack_ip"), F.col("is_ato")))
    return out.withColumn("weight", sp.row_weight(F.col("partition"), F.col("ip_group"), F.col("is_attack_ip")))


def violations(df: DataFrame, picked: DataFrame, stats: DataFrame, exclude_from: int | None = None) -> DataFrame:
    """Sample invariants as counts; every count must be 0."""
    kept = df.where(F.col("partition").isin("train", "val", "test", "late"))
    ips = kept.where("is_attack_ip").select("partition", "ip").distinct()
    # a shared ip between test and late is allowed: both use the test group
    side = F.when(F.col("partition") == "late", "test").otherwise(F.col("partition"))
    shared = ips.select(side.alias("side"), "ip").distinct().groupBy("ip").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    expected = picked.join(stats, "uid").agg(F.sum("n_events").alias("v"))
    bounds = kept.groupBy("partition").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    before, after = bounds.alias("x"), bounds.alias("y")
    order = lambda c: F.when(c == "train", 0).when(c == "val", 1).when(c == "test", 2).otherwise(3)
    wrong = before.join(F.broadcast(after), order(F.col("x.partition")) < order(F.col("y.partition"))).where("x.hi >= y.lo")
    checks = [
        ("shared_attack_ips", shared.agg(F.count(F.lit(1)).alias("v"))),
        ("missing_events", df.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(expected)).select(F.abs(F.col("v") - F.col("n")).alias("v"))),
        ("time_order", wrong.agg(F.count(F.lit(1)).alias("v"))),
        ("misplaced_takeovers", df.where("is_ato AND partition <> 'ato'").agg(F.count(F.lit(1)).alias("v"))),
        # without a limit no user is too large
        ("mega_users", picked.join(stats.where(F.lit(False) if exclude_from is None else F.col("n_events") >= exclude_from), "uid", "left_semi").agg(F.count(F.lit(1)).alias("v"))),
    ]
    out = None
    for name, frame in checks:
        row = frame.select(F.lit(name).alias("check"), F.col("v").cast("bigint").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def partition_summary(df: DataFrame) -> DataFrame:
    attack = F.col("is_attack_ip")
    return df.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("uid").alias("users"),
        F.count_if(attack).alias("attack_rows"),
        F.count_distinct(F.when(attack, F.col("ip"))).alias("attack_ips"),
        F.round(F.sum(F.when(attack, F.col("weight")).otherwise(0.0)) / F.sum("weight"), 6).alias("attack_share"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
    )


def attack_ip_stats(df: DataFrame) -> DataFrame:
    """Behaviour of each attacking address over the whole log (takeovers have their own label)."""
    rows = df.where("is_attack_ip AND NOT is_ato")
    per_user = rows.groupBy("ip", "uid").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("s"))
    return per_user.groupBy("ip").agg(F.sum("n").alias("attempts"), F.sum("s").alias("successes"), F.count("uid").alias("users"))


def attack_families(df: DataFrame, stats: DataFrame, *, dominant_asn: int, home_country: str) -> DataFrame:
    """Eight family flags per attack row."""
    joined = lookup(df, stats.withColumnRenamed("ip", "_ip"), [("ip", "_ip")]).drop("_ip")
    asn, tail = F.col("asn"), F.col("asn") != dominant_asn
    flags = {
        "few_attempts": F.col("attempts") <= 10,
        "wide_spread": F.col("users") > 30,
        "dominant_network": asn == dominant_asn,
        "abroad": F.coalesce(F.col("country"), F.lit("?")) != home_country,
        **{f"tail_network_{i}": tail & (asn % 3 == i) for i in range(3)},
        "desktop": F.col("device_type").isin("desktop", "tablet"),
    }
    return joined.withColumns({f"fam_{k}": F.col("is_attack_ip") & F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("attempts", "successes", "users")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share per column in one pass."""
    wide = df.agg(*[F.round(F.avg((F.col(c).isNull() | F.isnan(c)).cast("double")), 6).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in columns]))
    return wide.select(pairs.alias("p")).select("p.*")


def ua_dimension(df: DataFrame) -> DataFrame:
    """Distinct user agents with browser, system and device class by ordered pattern rules."""
    ua = F.col("ua")
    low = F.lower(ua)
    is_bot = low.rlike("bot|crawler|spider|curl/|wget/|python|headless")
    mobile = low.rlike("mobile|iphone|android")
    tablet = low.rlike("ipad|tablet")
    browser = (
        F.when(low.contains("edg/"), "Edge").when(low.contains("opr/"), "Opera").when(low.contains("chrome/"), "Chrome").when(low.contains("firefox/"), "Firefox")
        .when(low.contains("safari/"), "Safari").when(low.contains("curl/"), "curl").otherwise("Other")
    )
    system = (
        F.when(low.contains("windows"), "Windows").when(low.contains("android"), "Android").when(low.rlike("iphone|ipad|ios"), "iOS").when(low.contains("mac os"), "macOS")
        .when(low.contains("linux"), "Linux").otherwise("Other")
    )
    device = F.when(is_bot, "bot").when(tablet, "tablet").when(mobile, "mobile").when(low.rlike("windows|mac os|linux"), "desktop").otherwise("unknown")
    seen = df.where(ua.isNotNull()).groupBy("ua").agg(F.count(F.lit(1)).alias("attempts"))
    return seen.withColumns({"browser_name": browser, "system_name": system, "device_class": device})
