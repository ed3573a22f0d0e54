"""The three earlier detection tiers: fixed rules, additive behaviour score, nine-feature profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.scoring import severity
from ..functions.timefn import DAY, HOUR, MINUTE, circular_hours, hour_cos, hour_of_day, hour_sin, weekday
from ..operators.running import Running, running_over
from ..operators.slicing import DEFAULT_SLICE_ROWS, HOT, SLICE, Sliced, slice_hot_keys
from ..operators.sweep import Count, Distinct, sweep
from .rules import account_history, prepare

FAIL_WINDOW = 5 * MINUTE
BRUTE_FORCE = 5
STUFFING_FAILS, STUFFING_NAMES = 10, 5
MAX_SPEED_KMH = 900.0
LEARNING_LOGINS, LEARNING_DAYS = 10, 7

TIER3_FEATURES = (
    "hour_sin", "hour_cos", "day_of_week", "hour_deviation_from_avg", "is_new_location", "is_new_device",
    "minutes_since_last_login", "logins_last_24h", "distance_km_from_home",
)


def tier1(attempts: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``row_id, alerts ARRAY<STRING>`` of the three fixed rules."""
    df = prepare(attempts).select("row_id", "t", "user_key", "username", "ip", "country", "lat", "lon", "ua_hash", "success")
    rows = df.count()
    kw = {"slice_rows": slice_rows, "total_rows": rows}
    fail = ~F.col("success")
    df = sweep(df, "username", [Count("_fu", FAIL_WINDOW, fail)], **kw)
    df = sweep(df, "ip", [Count("_fp", FAIL_WINDOW, fail), Distinct("_up", FAIL_WINDOW, F.col("username"), fail)], **kw)
    df = account_history(df, **kw)
    hours = (F.col("t") - F.col("prev.t")) / F.lit(float(HOUR))
    km = haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    fast = (hours > 0) & (km / hours > MAX_SPEED_KMH)
    alerts = F.array_compact(
        F.array(
            F.when(fail & (F.col("_fu") >= BRUTE_FORCE), "brute_force"),
            F.when(fail & (F.col("_fp") >= STUFFING_FAILS) & (F.col("_up") >= STUFFING_NAMES), "credential_stuffing"),
            F.when(F.coalesce(fast, F.lit(False)), "impossible_travel"),
        )
    )
    return df.select("row_id", alerts.alias("alerts"))


def baseline(attempts: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Running login-hour statistics over the account's earlier successes.

    The hour is kept as whole minutes, so the running sums are exact.
    """
    ok = F.col("success")
    df = attempts.withColumn("login_hour", hour_of_day(F.col("t")))
    minutes = F.round(F.col("login_hour") * 60).cast("bigint")
    df = df.withColumns({"_m": F.when(ok, minutes), "_m2": F.when(ok, minutes * minutes), "_ok_t": F.when(ok, F.col("t")), "_one": ok.cast("int")})
    sliced = slice_hot_keys(df, ["uid"], "t", slice_rows=slice_rows, spread_by="row_id")
    out = running_over(
        sliced,
        ["uid"],
        ["t", "row_id"],
        [
            Running("successes_so_far", "sum", F.col("_one"), "prior_rows"),
            Running("_s1", "sum", F.col("_m"), "prior_rows"),
            Running("_s2", "sum", F.col("_m2"), "prior_rows"),
            Running("first_login_t", "min", F.col("_ok_t"), "prior_rows"),
        ],
    )
    n = F.col("successes_so_far")
    # population variance from exact integers: (n*S2 - S1^2) / n^2, in hours
    spread = n.cast("decimal(38,0)") * F.col("_s2") - F.col("_s1").cast("decimal(38,0)") * F.col("_s1")
    return out.withColumns(
        {
            "successes_so_far": F.coalesce(n, F.lit(0)),
            "avg_hour": F.when(n > 0, F.col("_s1") / n / F.lit(60.0)),
            "sd_hour": F.when(n > 0, F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n / F.lit(60.0)),
        }
    ).drop("_m", "_m2", "_ok_t", "_one", "_s1", "_s2", SLICE, HOT)


def learning() -> Column:
    """Too few successes or too young an account, in event time."""
    age_days = F.floor((F.col("t") - F.col("first_login_t")) / F.lit(float(DAY)))
    return F.coalesce((F.col("successes_so_far") < LEARNING_LOGINS) | (age_days < LEARNING_DAYS), F.lit(True))


def tier2(attempts: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Additive behaviour score of attempts on known accounts."""
    df = attempts.where("uid IS NOT NULL").select("row_id", "t", "uid", "username", "country", "success")
    rows = df.count()
    kw = {"slice_rows": slice_rows, "total_rows": rows}
    # failures are counted per name over all attempts, also those on unknown accounts
    fails = attempts.select("row_id", "t", "username", "success", "uid")
    fails = sweep(fails, "username", [Count("_fails", FAIL_WINDOW, ~F.col("success"))], slice_rows=slice_rows).where("uid IS NOT NULL")
    scored = baseline(df, slice_rows=slice_rows)
    sliced = slice_hot_keys(scored, ["uid"], "t", spread_by="row_id", **kw)
    scored = running_over(sliced, ["uid"], ["t", "row_id"], [Running("_seen", "sum", F.col("success").cast("int"), "prior_rows")], sub=["country"])
    scored = scored.join(fails.select("row_id", "_fails"), "row_id")
    settled = ~learning()
    limit = F.lit(2.5) * F.greatest(F.coalesce(F.col("sd_hour"), F.lit(0.0)), F.lit(0.5))
    unusual = settled & (circular_hours(F.col("login_hour"), F.col("avg_hour")) > limit)
    unknown_place = settled & F.col("country").isNotNull() & (F.coalesce(F.col("_seen"), F.lit(0)) == 0)
    guessing = ~F.col("success") & (F.col("_fails") >= BRUTE_FORCE)
    after_fails = F.col("success") & (F.col("_fails") >= 3)

    def points(flag: Column, n: int) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), n).otherwise(0)

    score = F.least(F.lit(100), points(unusual, 20) + points(unknown_place, 30) + points(guessing, 40) + points(after_fails, 50))
    return scored.withColumn("score", score).withColumn("severity", severity(F.col("score")))


def tier3_features(attempts: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Nine features of every successful login from the account's earlier successes."""
    df = prepare(attempts).where("success AND uid IS NOT NULL")
    df = df.select("row_id", "t", "uid", "user_key", "country", "lat", "lon", "ua_hash", "success")
    rows = df.count()
    kw = {"slice_rows": slice_rows, "total_rows": rows}
    out = account_history(df, **kw)
    out = baseline(out, slice_rows=slice_rows)
    home = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("t", "row_id", "lat", "lon"))
    sliced = slice_hot_keys(out, ["uid"], "t", spread_by="row_id", **kw)
    out = running_over(sliced, ["uid"], ["t", "row_id"], [Running("home", "min", home, "prior_rows")]).drop(SLICE, HOT)
    out = sweep(out, "uid", [Count("logins_last_24h", DAY)], boundary="closed", **kw)
    hour = F.col("login_hour")
    km = haversine_km(F.col("home.lat"), F.col("home.lon"), F.col("lat"), F.col("lon"))
    yes = F.lit(1.0)
    return out.withColumns(
        {
            "hour_sin": hour_sin(hour),
            "hour_cos": hour_cos(hour),
            "day_of_week": weekday(F.col("t")).cast("double"),
            "hour_deviation_from_avg": F.coalesce(circular_hours(hour, F.col("avg_hour")), F.lit(0.0)),
            "is_new_location": F.when(F.col("country").isNotNull() & (F.col("country_seen") == 0), yes).otherwise(0.0),
            "is_new_device": F.when((F.col("ua_hash") != "") & (F.col("device_seen") == 0), yes).otherwise(0.0),
            "minutes_since_last_login": F.coalesce((F.col("t") - F.col("last_success_t")) / F.lit(float(MINUTE)), F.lit(1440.0)),
            "logins_last_24h": F.col("logins_last_24h").cast("double"),
            "distance_km_from_home": F.coalesce(km, F.lit(0.0)),
        }
    )


def tier3_explain(features: DataFrame, top: int = 3) -> DataFrame:
    """Up to ``top`` features that deviate most from the population mean, with their direction."""
    aggs = []
    for c in TIER3_FEATURES:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    stats = features.agg(*aggs)
    joined = features.join(F.broadcast(stats))

    def z(c: str) -> Column:
        sd = F.when(F.col(f"_s_{c}") > 1e-6, F.col(f"_s_{c}")).otherwise(1.0)
        return (F.col(c) - F.col(f"_m_{c}")) / sd

    parts = F.array(*[F.struct((-F.abs(z(c))).alias("o"), z(c).alias("z"), F.lit(c).alias("name")) for c in TIER3_FEATURES])
    strongest = F.filter(F.slice(F.sort_array(parts), 1, top), lambda p: F.abs(p["z"]) >= 0.5)
    text = F.transform(strongest, lambda p: F.concat(p["name"], F.when(p["z"] > 0, F.lit(" ↑")).otherwise(F.lit(" ↓"))))
    return joined.select("row_id", F.when(F.size(text) == 0, "nothing stands out").otherwise(F.array_join(text, ", ")).alias("explanation"))
