"""Small literal side tables, once for Spark and once for the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORIGIN = 1_704_067_200_000_000
HALF_HOUR = ORIGIN + 1_800_000_000

IP_LISTS = [
    ("tor", "203.0.1.5/32"), ("datacenter", "203.0.2.0/25"), ("datacenter", "203.0.2.64/26"),
    ("vpn", "203.0.3.0/26"), ("vpn", "203.0.3.64/26"),
]
BLOCKLIST = [
    ("ip", "203.0.1.13", "manual", "admin", None), ("ip", "203.0.2.22", "manual", "admin", HALF_HOUR),
    ("cidr", "203.0.3.0/28", "range", "admin", None), ("cidr", "203.0.0.0/26", "range", "admin", HALF_HOUR),
    ("asn", "65001", "network", "admin", None), ("asn", "64505", "network", "admin", HALF_HOUR),
    ("username", "u7", "name", "admin", None), ("username", "ghost3", "name", "admin", HALF_HOUR),
]
IP_RANGES = [
    ("203.0.0.0/24", 64600, "R0"), ("203.0.1.0/24", 64601, "R1"), ("203.0.2.0/24", 64602, "R2"), ("203.0.3.0/24", 64603, "R3"),
]
OVERRIDES = [("country_hop", "enforce", None), ("brute_force", None, {"threshold": "8", "window_s": "300"})]


def ip_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IP_LISTS, "list string, cidr string")


def blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLOCKLIST, "kind string, value string, reason string, added_by string, expires_at bigint")


def ip_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IP_RANGES, "cidr string, range_asn bigint, range_country string")


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "rule_id string, mode string, params map<string,string>")


def _lit(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


IPN = "(CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"


def _net(c: str) -> str:
    a = f"split_part({c}, '/', 1)"
    n = "(" + " + ".join(f"CAST(split_part({a}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"
    size = f"(CAST(1 AS BIGINT) << (32 - CAST(split_part({c}, '/', 2) AS INT)))"
    return f"{n} AS lo, {n} + {size} - 1 AS hi"


LISTS_CTE = f"ip_lists AS (SELECT list, {_net('cidr')} FROM (VALUES {_values(IP_LISTS)}) v(list, cidr))"
BLOCK_CTE = f"""blocked AS (SELECT kind, value, reason, CAST(expires_at AS BIGINT) AS expires_at FROM (VALUES {_values([r[:3] + r[4:] for r in BLOCKLIST])}) v(kind, value, reason, expires_at)),
block_nets AS (SELECT *, {_net('value')} FROM blocked WHERE kind = 'cidr')"""
RANGES_CTE = f"ip_ranges AS (SELECT *, {_net('cidr')} FROM (VALUES {_values(IP_RANGES)}) v(cidr, range_asn, range_country))"
MATCH_CTE = BLOCK_CTE + f""",
block_found AS (
  SELECT row_id, 0 AS rank, b.kind, b.value, b.reason FROM attempts a JOIN blocked b ON b.kind = 'ip' AND b.value = a.ip AND (b.expires_at IS NULL OR a.t < b.expires_at)
  UNION ALL SELECT row_id, 1, b.kind, b.value, b.reason FROM attempts a JOIN block_nets b ON {IPN} BETWEEN b.lo AND b.hi AND (b.expires_at IS NULL OR a.t < b.expires_at)
  UNION ALL SELECT row_id, 2, b.kind, b.value, b.reason FROM attempts a JOIN blocked b ON b.kind = 'asn' AND b.value = CAST(a.asn AS VARCHAR) AND (b.expires_at IS NULL OR a.t < b.expires_at)
  UNION ALL SELECT row_id, 3, b.kind, b.value, b.reason FROM attempts a JOIN blocked b ON b.kind = 'username' AND b.value = lower(a.username) AND (b.expires_at IS NULL OR a.t < b.expires_at)),
block_match AS (
  SELECT row_id, kind, value, reason FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY rank, value) AS rn FROM block_found) WHERE rn = 1)"""
