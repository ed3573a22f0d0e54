"""Text columns: version suffixes, fingerprints and English message fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "∅"
VERSION_SUFFIX = r" +[0-9][0-9.]*$"


def or_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


def strip_version(c: Column) -> Column:
    return F.regexp_replace(c, VERSION_SUFFIX, "")


def ua_hash(ua: Column) -> Column:
    """12 hex digits of SHA-1; the empty string for a missing user agent."""
    return F.when(ua.isNull() | (ua == ""), F.lit("")).otherwise(F.substring(F.sha1(F.encode(ua, "UTF-8")), 1, 12))


def device_fingerprint(ua: Column) -> Column:
    """32 hex digits of SHA-256; NULL for a missing user agent."""
    return F.when(ua.isNotNull() & (ua != ""), F.substring(F.sha2(F.encode(ua, "UTF-8"), 256), 1, 32))


def short(c: Column, limit: int = 50) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def number_text(x: Column) -> Column:
    """A number without a trailing ``.0`` (up to 6 decimals)."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", ""), r"\.$", "")


def window_text(seconds: Column) -> Column:
    s = seconds.cast("double")
    return (
        F.when(s < 90, F.concat(number_text(s), F.lit(" seconds")))
        .when(s < 5400, F.concat(number_text(s / 60), F.lit(" minutes")))
        .when(s < 129600, F.concat(number_text(s / 3600), F.lit(" hours")))
        .otherwise(F.concat(number_text(s / 86400), F.lit(" days")))
    )


def percent_text(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("bigint").cast("string"), F.lit("%"))
