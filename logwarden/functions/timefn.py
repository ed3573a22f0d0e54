"""Event-time columns.  ``t`` is epoch microseconds, UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3_600 * SECOND
DAY = 24 * HOUR


def to_ts(t: Column) -> Column:
    return F.timestamp_micros(t)


def hour_of_day(t: Column) -> Column:
    """Hour with minutes as a fraction; seconds are ignored."""
    ts = to_ts(t)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def weekday(t: Column) -> Column:
    """Monday = 0."""
    return F.weekday(to_ts(t))


def hour_sin(hour: Column) -> Column:
    return F.sin(hour * (2 * math.pi) / 24)


def hour_cos(hour: Column) -> Column:
    return F.cos(hour * (2 * math.pi) / 24)


def circular_hours(a: Column, b: Column) -> Column:
    """Distance on the 24-hour circle."""
    diff = F.abs(a - b)
    return F.least(diff, F.lit(24.0) - diff)
