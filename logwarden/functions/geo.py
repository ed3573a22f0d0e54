"""Distance and IPv4 network arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
CIDR4 = IPV4[:-1] + r"(/([0-9]|[12][0-9]|3[0-2]))?$"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    # ``least`` skips NULLs, so a missing coordinate has to be kept out explicitly
    return F.when(half.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(half))))


def ip_to_long(ip: Column) -> Column:
    """IPv4 address as a number; NULL for anything else.

    The argument and its four numbers are bound once through one-element ``transform``s:
    pushed-down filters would otherwise split it again for every octet.
    """

    def number(text: Column, n: Column) -> Column:
        canonical = (F.size(n) == 4) & (F.concat_ws(".", n.cast("array<string>")) == text)
        in_range = (F.array_max(n) <= 255) & (F.array_min(n) >= 0)
        return F.when(canonical & in_range, ((F.get(n, F.lit(0)).cast("bigint") * 256 + F.get(n, F.lit(1))) * 256 + F.get(n, F.lit(2))) * 256 + F.get(n, F.lit(3)))

    def bound(text: Column) -> Column:
        octets = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
        return F.element_at(F.transform(F.array(octets), lambda n: number(text, n)), 1)

    return F.element_at(F.transform(F.array(ip), bound), 1)


def long_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftrightunsigned(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last address of an IPv4 network (a bare address is a /32); NULL if invalid."""
    text = F.trim(cidr)
    ok = text.rlike(CIDR4)
    base = ip_to_long(F.substring_index(text, "/", 1))
    bits = F.coalesce(F.regexp_extract(text, "/([0-9]+)$", 1).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    lo = base - base % size
    return F.when(ok, lo), F.when(ok, lo + size - 1)


def is_public_ipv4(n: Column) -> Column:
    """Outside the private, loopback, link-local, shared, multicast and reserved blocks."""
    # The non-routable IPv4 blocks as (first address, prefix length).
    blocks = (
        ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
        ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4),
    )
    inside = F.lit(False)
    for first, bits in blocks:
        a, b, c, d = (int(x) for x in first.split("."))
        lo = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | n.between(lo, lo + (1 << (32 - bits)) - 1)
    return n.isNotNull() & ~inside
