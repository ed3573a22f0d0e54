"""The attempts relation: typed login attempts from a generic event table.

``attempts_from_events`` maps the supplied ``events`` table to login attempts.
``pace`` compresses time: 1 keeps days (24 h / 7 d windows), 720 packs the same log
into an hour so that minute-scale rules have something to see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ua_hash

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01 UTC

COLUMNS = [
    "row_id", "t", "uid", "username", "ip", "asn", "country", "ua", "browser", "os",
    "device_type", "success", "is_attack_ip", "is_ato",
]
LABELS = ["is_attack_ip", "is_ato"]


def _txt(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def attempts_from_events(events: DataFrame, pace: int = 1) -> DataFrame:
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.col("_k")
    base = events.select("event_id", "user_id", "event_type", ts_us.alias("_us"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("_k"))
    ghost = e % 7 == 0
    variant = (u + e % 3)
    return base.select(
        e.alias("row_id"),
        F.expr(f"{ORIGIN_US} + ((_us - {ORIGIN_US}) div {pace})").alias("t"),
        F.when(~ghost, u).alias("uid"),
        F.when(ghost, _txt("ghost", u % 50)).otherwise(_txt("u", u)).alias("username"),
        F.concat(F.lit("203.0."), (k % 4).cast("string"), F.lit("."), k.cast("string")).alias("ip"),
        F.when(k % 13 == 0, F.lit(None).cast("bigint"))
        .when(e % 211 == 0, F.lit(65000) + e % 5)
        .otherwise((F.lit(64500) + k % 9).cast("bigint"))
        .alias("asn"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .when((u + e) % 10 == 0, _txt("C", k % 6))
        .otherwise(_txt("C", u % 6))
        .alias("country"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).when(k == 5, "curl/8.7.1").otherwise(_txt("Mozilla/5.0 ua", variant % 12)).alias("ua"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Chrome "), (F.lit(80) + variant % 6).cast("string"), F.lit(".0.1")))
        .alias("browser"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).when(u % 3 == 0, "Windows 10").when(u % 3 == 1, "Android 10.0").otherwise("Linux").alias("os"),
        F.when(k % 25 == 7, "bot")
        .when(k % 19 == 0, F.lit(None).cast("string"))
        .when(u % 3 == 1, "mobile")
        .when(u % 3 == 0, "desktop")
        .otherwise("tablet")
        .alias("device_type"),
        F.when(ghost, F.lit(False))
        .when(k % 10 == 3, (kind == "purchase") & (e % 5 == 0))
        .otherwise(~kind.isin("error", "click"))
        .alias("success"),
        (k % 10 == 3).alias("is_attack_ip"),
        ((e % 7 != 0) & (e % 97 == 5)).alias("is_ato"),
    )


def read_attempts(spark: SparkSession, sf_dir: str, pace: int = 1) -> DataFrame:
    return attempts_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), pace)


# One point per country code used by the geo rules.
GEO_POINTS = [
    ("C0", 21.03, 105.85), ("C1", 48.85, 2.35), ("C2", 40.71, -74.0),
    ("C3", -33.87, 151.21), ("C4", 35.68, 139.69), ("C5", -23.55, -46.63),
]


def with_geo(df: DataFrame) -> DataFrame:
    """Latitude / longitude of the attempt's country (six literal points, folded into the plan)."""
    lat = F.lit(None).cast("double")
    lon = F.lit(None).cast("double")
    for code, la, lo in GEO_POINTS:
        lat = F.when(F.col("country") == code, F.lit(la)).otherwise(lat)
        lon = F.when(F.col("country") == code, F.lit(lo)).otherwise(lon)
    return df.withColumns({"lat": lat, "lon": lon})


def with_keys(df: DataFrame) -> DataFrame:
    """Columns the rules key on: the account (NULL when unknown) and the UA fingerprint."""
    return df.withColumns({"user_key": F.col("uid").cast("string"), "ua_hash": ua_hash(F.col("ua"))})
