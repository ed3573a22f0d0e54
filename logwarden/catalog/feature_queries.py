"""Feature groups: prior windows per account, IP and network; value novelty and rarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import features as ft
from ..sources.attempts import read_attempts, with_geo
from .fixture import geo_cte, with_attempts
from .registry import query

H, D = 3_600_000_000, 86_400_000_000
PRIOR = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def within(us: int) -> str:
    return f"RANGE BETWEEN {us - 1} PRECEDING AND 1 PRECEDING"


USER_CTE = f"""usr AS (
  SELECT row_id,
    COUNT(*) OVER wall AS n_att, COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER wall, 0) AS n_ok,
    MIN(t) OVER wall AS first_t, MAX(t) OVER wall AS last_t,
    MAX(CASE WHEN success THEN t END) OVER wall AS last_ok,
    MAX(CASE WHEN success THEN upto END) OVER wall AS at_ok,
    COUNT(*) OVER w1 AS a1, COUNT(*) OVER w24 AS a24,
    COALESCE(SUM(CASE WHEN success THEN 0 ELSE 1 END) OVER w24, 0) AS f24,
    COUNT(DISTINCT ip) OVER w24 AS ips, COUNT(DISTINCT COALESCE(country, '∅')) OVER w7 AS countries
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY uid ORDER BY t) AS upto FROM attempts WHERE uid IS NOT NULL)
  WINDOW wall AS (PARTITION BY uid ORDER BY t {PRIOR}), w1 AS (PARTITION BY uid ORDER BY t {within(H)}),
         w24 AS (PARTITION BY uid ORDER BY t {within(D)}), w7 AS (PARTITION BY uid ORDER BY t {within(7 * D)}))"""

USER_COLS = f"""CAST(u.n_att AS DOUBLE) AS u_n_attempts, CAST(u.n_ok AS DOUBLE) AS u_n_success,
  (a.t - u.first_t) / {D}.0::DOUBLE AS u_age_days"""
RHYTHM_COLS = """(a.t - u.last_t) / 1000000.0::DOUBLE AS u_secs_since_last,
  (a.t - u.last_ok) / 1000000.0::DOUBLE AS u_secs_since_last_success,
  CAST(u.n_att - COALESCE(u.at_ok, 0) AS DOUBLE) AS u_fail_streak,
  CAST(u.a1 AS DOUBLE) AS u_attempts_1h, CAST(u.a24 AS DOUBLE) AS u_attempts_24h, CAST(u.f24 AS DOUBLE) AS u_fails_24h,
  CAST(u.ips AS DOUBLE) AS u_distinct_ips_24h, CAST(u.countries AS DOUBLE) AS u_distinct_countries_7d"""


def infra_cte(name: str, key: str, distinct2: str) -> str:
    return f"""{name} AS (
  SELECT row_id, COUNT(*) OVER w1 AS a1, COUNT(*) OVER w24 AS a24,
    COALESCE(SUM(CASE WHEN success THEN 0 ELSE 1 END) OVER w24, 0) AS f24,
    COUNT(DISTINCT uid) OVER w24 AS users, COUNT(DISTINCT {distinct2}) OVER w24 AS others,
    COALESCE(SUM(CASE WHEN uid IS NULL THEN 1 ELSE 0 END) OVER w24, 0) AS unknown,
    COUNT(*) OVER (PARTITION BY {key} ORDER BY t {PRIOR}) AS prior_all
  FROM attempts
  WINDOW w1 AS (PARTITION BY {key} ORDER BY t {within(H)}), w24 AS (PARTITION BY {key} ORDER BY t {within(D)}))"""


IP_CTE = infra_cte("ipw", "ip", "COALESCE(ua, '∅')")
ASN_CTE = infra_cte("asw", "asn", "ip")
IP_COLS = """CAST(i.a1 AS DOUBLE) AS ip_attempts_1h, CAST(i.a24 AS DOUBLE) AS ip_attempts_24h,
  CASE WHEN i.a24 > 0 THEN CAST(i.f24 AS DOUBLE) / i.a24 END AS ip_fail_ratio_24h,
  CAST(i.users AS DOUBLE) AS ip_distinct_users_24h, CAST(i.unknown AS DOUBLE) AS ip_unknown_attempts_24h,
  CAST(i.others AS DOUBLE) AS ip_distinct_ua_24h, CAST(i.prior_all AS DOUBLE) AS ip_prior_attempts_all"""
_A = "CASE WHEN a.asn IS NOT NULL THEN CAST({} AS DOUBLE) END AS {}"
ASN_COLS = ", ".join(
    [_A.format("n.a1", "asn_attempts_1h"), _A.format("n.a24", "asn_attempts_24h"),
     "CASE WHEN a.asn IS NOT NULL AND n.a24 > 0 THEN CAST(n.f24 AS DOUBLE) / n.a24 END AS asn_fail_ratio_24h",
     _A.format("n.users", "asn_distinct_users_24h"), _A.format("n.others", "asn_distinct_ips_24h"),
     "CASE WHEN a.asn IS NOT NULL AND n.a24 > 0 THEN CAST(n.unknown AS DOUBLE) / n.a24 END AS asn_unknown_share_24h"]
)

KEY = {
    "ip": "ip", "country": "COALESCE(country, '∅')", "asn": "COALESCE(CAST(asn AS VARCHAR), '∅')", "ua": "COALESCE(ua, '∅')",
    "browser": "COALESCE(browser, '∅')", "os": "COALESCE(os, '∅')", "device": "COALESCE(device_type, '∅')",
    "browser_family": "regexp_replace(COALESCE(browser, '∅'), ' +[0-9][0-9.]*$', '')",
    "os_family": "regexp_replace(COALESCE(os, '∅'), ' +[0-9][0-9.]*$', '')",
}
_HIT = "SUM(CASE WHEN success AND uid IS NOT NULL THEN 1 ELSE 0 END)"
COUNTS_CTE = f"""cnt AS (
  SELECT row_id, uid,
    COALESCE({_HIT} OVER (ORDER BY t {PRIOR}), 0) AS g_total,
    {", ".join(f"COALESCE({_HIT} OVER (PARTITION BY {KEY[a]} ORDER BY t {PRIOR}), 0) AS g_{a}" for a in ft.FREEMAN_ATTRS)},
    COALESCE({_HIT} OVER (PARTITION BY uid ORDER BY t {PRIOR}), 0) AS n_ok,
    {", ".join(f"CASE WHEN uid IS NOT NULL THEN COALESCE({_HIT} OVER (PARTITION BY uid, {KEY[a]} ORDER BY t {PRIOR}), 0) END AS c_{a}" for a in ft.NOVELTY_ATTRS)}
  FROM attempts)"""


def pg(a: str) -> str:
    return f"((c.g_{a} + 1.0::DOUBLE) / (c.g_total + 1.0::DOUBLE))"


def llr(a: str) -> str:
    return f"(LN({pg(a)}) - LN((c.c_{a} + {pg(a)}) / (c.n_ok + 1.0::DOUBLE)))"


NOVELTY_COLS = ", ".join(f"CASE WHEN c.c_{a} IS NULL THEN NULL WHEN c.c_{a} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS new_{a}" for a in ft.NOVELTY_ATTRS)
RARITY_COLS = ", ".join(f"round(0.0::DOUBLE - LN({pg(a)}), 6) AS rare_{a}" for a in ft.FREEMAN_ATTRS)
LLR_COLS = ", ".join(f"round({llr(a)}, 6) + 0.0::DOUBLE AS llr_{a}" for a in ft.FREEMAN_ATTRS)
LLR_SUM = "round(" + " + ".join(llr(a) for a in ft.FREEMAN_ATTRS) + ", 6) + 0.0::DOUBLE AS llr_sum"
DEVICE = "CAST(CASE a.device_type WHEN 'mobile' THEN 0 WHEN 'desktop' THEN 1 WHEN 'tablet' THEN 2 WHEN 'bot' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END AS DOUBLE)"
CUR_COLS = f"CASE WHEN a.success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cur_success, {DEVICE} AS cur_device_code"

ALL_CTES = (USER_CTE, IP_CTE, ASN_CTE, COUNTS_CTE)
ALL_SQL = f"""SELECT a.row_id, {CUR_COLS}, {NOVELTY_COLS}, {USER_COLS}, {RHYTHM_COLS}, {LLR_COLS}, {LLR_SUM}, {RARITY_COLS}, {IP_COLS}, {ASN_COLS}
FROM attempts a JOIN cnt c USING (row_id) JOIN ipw i USING (row_id) JOIN asw n USING (row_id) LEFT JOIN usr u USING (row_id)"""
FEATURES_CTE = "feats AS (" + ALL_SQL + ")"


def rounded(df):
    logs = [c for c in df.columns if c.startswith(("llr_", "rare_"))]
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in logs})


def _group(name: str):
    def run(spark, sf):
        return rounded(ft.feature_group(read_attempts(spark, sf), name))

    return run


query("features_cur", with_attempts(f"SELECT a.row_id, {CUR_COLS} FROM attempts a"))(_group("cur"))
query("features_novelty", with_attempts(f"SELECT c.row_id, {NOVELTY_COLS} FROM cnt c", 1, COUNTS_CTE))(_group("novelty"))
query("features_rarity", with_attempts(f"SELECT c.row_id, {RARITY_COLS} FROM cnt c", 1, COUNTS_CTE))(_group("rarity"))
query("features_freeman", with_attempts(f"SELECT c.row_id, {LLR_COLS}, {LLR_SUM} FROM cnt c", 1, COUNTS_CTE))(_group("freeman"))
query("features_ip", with_attempts(f"SELECT a.row_id, {IP_COLS} FROM attempts a JOIN ipw i USING (row_id)", 1, IP_CTE))(_group("infra_ip"))
query("features_asn", with_attempts(f"SELECT a.row_id, {ASN_COLS} FROM attempts a JOIN asw n USING (row_id)", 1, ASN_CTE))(_group("infra_asn"))


@query("features_user", with_attempts(f"SELECT a.row_id, {USER_COLS}, {RHYTHM_COLS} FROM attempts a LEFT JOIN usr u USING (row_id)", 1, USER_CTE))
def features_user(spark, sf):
    cols = ["row_id", "t", "uid", "ip", "country", "success"]
    return ft.user_windows(read_attempts(spark, sf).select(*cols)).select("row_id", *ft.GROUPS["history"], *ft.GROUPS["rhythm"])


@query("features_all", with_attempts(ALL_SQL, 1, *ALL_CTES))
def features_all(spark, sf):
    return rounded(ft.compute_features(read_attempts(spark, sf)))


@query(
    "semi_users",
    with_attempts(
        f"""SELECT a.row_id, {USER_COLS} FROM attempts a JOIN usr u USING (row_id)
        WHERE a.uid IN (SELECT uid FROM attempts WHERE is_ato)""", 1, USER_CTE),
)
def semi_users(spark, sf):
    """Windows of whole histories, for the accounts that have a takeover label."""
    a = read_attempts(spark, sf)
    wanted = a.where("is_ato").select("uid").distinct()
    eligible = a.join(wanted, "uid", "left_semi")
    return ft.user_windows(eligible.select("row_id", "t", "uid", "ip", "country", "success")).select("row_id", *ft.GROUPS["history"])


@query(
    "prior_counts",
    with_attempts(f"SELECT row_id, CAST(g_total AS BIGINT) AS g_total, {', '.join(f'CAST(g_{a} AS BIGINT) AS g_{a}' for a in ft.FREEMAN_ATTRS)} FROM cnt", 1, COUNTS_CTE),
)
def prior_counts(spark, sf):
    return ft.prior_value_counts(read_attempts(spark, sf)).select("row_id", "g_total", *[f"g_{a}" for a in ft.FREEMAN_ATTRS])
