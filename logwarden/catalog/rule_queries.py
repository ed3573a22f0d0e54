"""Each rule, all rules together, reputation lookups, tallies and the earlier tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timefn import DAY, HOUR, SECOND
from ..operators.joins import in_ranges, merge_intervals, parse_networks, range_attributes
from ..plans import blocklist as bl
from ..plans import rules as R
from ..plans import tally, tiers
from ..plans.rulebook import SCRIPT_MARKERS
from ..sources.attempts import read_attempts
from . import side_tables as st
from .fixture import geo_cte, with_attempts
from .registry import query

PACE = 720


def rg(us: int) -> str:
    return f"RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW"


def n(cond: str, key: str, s: int) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY t {rg(s * SECOND)}), 0) AS BIGINT)"


def d(value: str, cond: str, key: str, s: int) -> str:
    return f"COUNT(DISTINCT CASE WHEN {cond} THEN {value} END) OVER (PARTITION BY {key} ORDER BY t {rg(s * SECOND)})"


NF = "NOT success"
UA = "NULLIF(ua, '')"
STATE = f"""st AS (SELECT *,
  {n(NF, 'username', 300)} AS fu5, {n(NF, 'username', 600)} AS fu10, {n(NF, 'username', 3600)} AS fu60,
  {d('ip', NF, 'username', 600)} AS fi10, {d('ip', NF, 'username', 3600)} AS fi60,
  {d('country', 'TRUE', 'username', 86400)} AS cc24,
  {n(NF, 'ip', 300)} AS fp5, {n('success', 'ip', 300)} AS op5, {d('username', NF, 'ip', 300)} AS up5, {d(UA, NF, 'ip', 300)} AS ap5,
  {n(NF, 'ip', 600)} AS fp10, {d(UA, NF, 'ip', 600)} AS ap10, {d('username', NF + ' AND uid IS NULL', 'ip', 600)} AS xp10,
  {n(NF, 'ip', 3600)} AS fp60, {n(NF, 'ip', 86400)} AS fp24, {d('username', NF, 'ip', 86400)} AS up24,
  {n(NF, 'asn', 300)} AS fa5, {n('success', 'asn', 300)} AS oa5, {d('username', NF, 'asn', 300)} AS ua5,
  {n(NF, 'asn', 3600)} AS fa60, {n(NF, 'asn', 86400)} AS fa24, {d('username', NF, 'asn', 86400)} AS ua24,
  CASE WHEN uid IS NOT NULL THEN {d('country', 'success', 'uid', 600)} END AS mc10
  FROM attempts)"""
RELAX = "CASE WHEN ap5 >= 4 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
CS_IP = f"(fp5 >= 10 * {RELAX} AND up5 >= 5 * {RELAX} AND op5 <= 0.5::DOUBLE * (op5 + fp5))"
CS_ASN = "(asn IS NOT NULL AND fa5 >= 40 AND ua5 >= 20 AND oa5 <= 0.5::DOUBLE * (oa5 + fa5))"
PS_IP = "(up24 >= 15 AND fp24 <= 3.0::DOUBLE * up24 AND fp60 <= 120)"
PS_ASN = "(asn IS NOT NULL AND ua24 >= 40 AND fa24 <= 3.0::DOUBLE * ua24 AND fa60 <= 600)"
MARK = "CASE WHEN trim(COALESCE(ua, '')) = '' THEN '(empty)' " + " ".join(f"WHEN contains(lower(ua), '{m}') THEN '{m}'" for m in SCRIPT_MARKERS) + " END"

# rule id -> (severity, mode, scope expression, condition) over the state view
COND = {
    "brute_force": ("high", "enforce", "NULL", "NOT success AND fu5 >= 5"),
    "credential_stuffing": ("high", "enforce", f"CASE WHEN {CS_IP} THEN 'ip' ELSE 'asn' END", f"NOT success AND ({CS_IP} OR {CS_ASN})"),
    "password_spray_slow": ("high", "enforce", f"CASE WHEN {PS_IP} THEN 'ip' ELSE 'asn' END", f"NOT success AND ({PS_IP} OR {PS_ASN})"),
    "distributed_bruteforce": ("high", "enforce", "NULL", "NOT success AND fu60 >= 8 AND fi60 >= 5"),
    "username_enumeration": ("medium", "enforce", "NULL", "NOT success AND uid IS NULL AND xp10 >= 8"),
    "success_after_failures": ("high", "enforce", "NULL", "success AND uid IS NOT NULL AND fu10 >= 5"),
    "bot_user_agent": ("low", "enforce", "NULL", "device_type = 'bot'"),
    "scripted_client": ("medium", "enforce", "NULL", f"({MARK}) IS NOT NULL"),
    "ua_rotation": ("medium", "enforce", "NULL", "NOT success AND ua IS NOT NULL AND fp10 >= 8 AND ap10 >= 5"),
    "multi_context_simultaneous": ("high", "enforce", "NULL", "success AND uid IS NOT NULL AND country IS NOT NULL AND mc10 >= 2"),
    "country_hop": ("medium", "shadow", "NULL", "country IS NOT NULL AND cc24 >= 3"),
}


def _rule_sql(rule_id: str, cols: str, pace: int = PACE) -> str:
    return with_attempts(f"SELECT row_id, {cols} FROM st WHERE {COND[rule_id][3]}", pace, STATE)


def run_rule(rule_id: str, evidence: dict[str, str], pace: int = PACE, params: dict | None = None, scope: bool = False):
    """A query that runs one rule and returns its hits with typed evidence columns."""

    def run(spark, sf):
        config = R.Config.from_dict({"rules": {rule_id: {"params": params}}}) if params else None
        plan = R.Plan.of(config, [rule_id])
        intel = R.Intel(st.ip_lists(spark), ("tor", "datacenter", "vpn"), st.blocklist(spark))
        h = R.hits(R.evaluate(read_attempts(spark, sf, pace), plan, intel))
        cols = [F.col("evidence")[k].cast(t).alias(k) for k, t in evidence.items()]
        return h.select("row_id", *(["scope"] if scope else []), *cols)

    return run


L = "bigint"
query("rule_brute_force", _rule_sql("brute_force", "fu5 AS fails"))(run_rule("brute_force", {"fails": L}))
query(
    "rule_credential_stuffing",
    _rule_sql(
        "credential_stuffing",
        f"""CASE WHEN {CS_IP} THEN 'ip' ELSE 'asn' END AS scope, CASE WHEN {CS_IP} THEN fp5 ELSE fa5 END AS fails,
        CASE WHEN {CS_IP} THEN up5 ELSE ua5 END AS distinct_users, CASE WHEN {CS_IP} THEN op5 ELSE oa5 END AS successes"""),
)(run_rule("credential_stuffing", {"fails": L, "distinct_users": L, "successes": L}, scope=True))
query(
    "rule_password_spray",
    _rule_sql(
        "password_spray_slow",
        f"""CASE WHEN {PS_IP} THEN 'ip' ELSE 'asn' END AS scope, CASE WHEN {PS_IP} THEN up24 ELSE ua24 END AS distinct_users,
        CASE WHEN {PS_IP} THEN fp24 ELSE fa24 END AS fails, CASE WHEN {PS_IP} THEN fp60 ELSE fa60 END AS fails_last_hour"""),
)(run_rule("password_spray_slow", {"distinct_users": L, "fails": L, "fails_last_hour": L}, scope=True))
query("rule_distributed_bf", _rule_sql("distributed_bruteforce", "fu60 AS fails, fi60 AS distinct_ips"))(
    run_rule("distributed_bruteforce", {"fails": L, "distinct_ips": L}))
query("rule_enumeration", _rule_sql("username_enumeration", "xp10 AS distinct_unknown_usernames"))(
    run_rule("username_enumeration", {"distinct_unknown_usernames": L}))
query("rule_success_after_fail", _rule_sql("success_after_failures", "fu10 AS fails_before, fi10 AS distinct_ips_before"))(
    run_rule("success_after_failures", {"fails_before": L, "distinct_ips_before": L}))
query("rule_bot_ua", _rule_sql("bot_user_agent", "COALESCE(ua, '') AS user_agent"))(run_rule("bot_user_agent", {"user_agent": "string"}))
query("rule_scripted", _rule_sql("scripted_client", f"{MARK} AS marker"))(run_rule("scripted_client", {"marker": "string"}))
query("rule_ua_rotation", _rule_sql("ua_rotation", "fp10 AS fails, ap10 AS distinct_user_agents"))(
    run_rule("ua_rotation", {"fails": L, "distinct_user_agents": L}))
query("rule_multi_context", _rule_sql("multi_context_simultaneous", "mc10 AS countries"))(run_rule("multi_context_simultaneous", {"countries": L}))
query("rule_country_hop", _rule_sql("country_hop", "cc24 AS distinct_countries"))(run_rule("country_hop", {"distinct_countries": L}))

RHYTHM_SQL = """SELECT row_id FROM (SELECT row_id, g, list_sum(g) / len(g) / 1000000.0::DOUBLE AS m FROM
        (SELECT row_id, list_transform(range(1, len(ts)), lambda i: ts[i + 1] - ts[i]) AS g FROM
          (SELECT row_id, list(t) OVER (PARTITION BY ip ORDER BY t, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ts FROM attempts WHERE NOT success) WHERE len(ts) = 5))
        WHERE m <= 60 AND (m <= 0 OR sqrt(list_sum(list_transform(g, lambda x: (x / 1000000.0::DOUBLE - m) * (x / 1000000.0::DOUBLE - m))) / len(g)) / m <= 0.4::DOUBLE)"""
#: Parameters under which the rules with a long memory fire on the small log.
FIXTURE = {
    "regular_rhythm": {"samples": 5, "max_mean_interval_s": 60.0, "max_cv": 0.4}, "dormant_account_login": {"dormant_days": 1},
    "rare_network_login": {"max_share": 0.01, "min_total": 100},
}
query("rule_rhythm", with_attempts(RHYTHM_SQL, PACE))(run_rule("regular_rhythm", {}, params=FIXTURE["regular_rhythm"]))

HAV = "2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2))))"
TRAVEL_SQL = f"""SELECT row_id, round(km, 1) AS distance_km FROM (SELECT x.row_id, {HAV} AS km, (x.t - x.pt) / {HOUR}.0::DOUBLE AS h
          FROM (SELECT *, LAG(t) OVER w AS pt, LAG(country) OVER w AS pc FROM attempts WHERE uid IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY t, row_id)) x
          JOIN geo g ON g.country = x.country JOIN geo p ON p.country = x.pc) WHERE h > 0 AND km / h > 900"""
query("rule_impossible_travel", with_attempts(TRAVEL_SQL, 1, geo_cte()))(run_rule("impossible_travel", {"distance_km": "double"}, pace=1))

_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_OKSUM = "COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY uid, {} ORDER BY t, row_id " + _PRIOR + "), 0)"
DORMANT_SQL = f"""SELECT row_id, round((t - last_ok) / {DAY}.0::DOUBLE, 1) AS idle_days, new_country, new_device FROM (
          SELECT row_id, t, success, MAX(CASE WHEN success THEN t END) OVER (PARTITION BY uid ORDER BY t, row_id {_PRIOR}) AS last_ok,
            (country IS NOT NULL AND {_OKSUM.format('country')} = 0) AS new_country, (ua IS NOT NULL AND {_OKSUM.format('ua')} = 0) AS new_device
          FROM attempts WHERE uid IS NOT NULL) WHERE success AND (t - last_ok) / {DAY}.0::DOUBLE >= 1 AND (new_country OR new_device)"""
query("rule_dormant", with_attempts(DORMANT_SQL, 1))(run_rule("dormant_account_login", {"idle_days": "double", "new_country": "boolean", "new_device": "boolean"}, pace=1, params=FIXTURE["dormant_account_login"]))

_REAL = "success AND uid IS NOT NULL AND asn IS NOT NULL"
RARE_SQL = f"""SELECT row_id, seen AS asn_successes, total AS total_successes FROM (SELECT row_id, {_REAL} AS ok,
          CAST(COALESCE(SUM(CASE WHEN {_REAL} THEN 1 ELSE 0 END) OVER (ORDER BY t, row_id {_PRIOR}), 0) AS BIGINT) AS total,
          CAST(COALESCE(SUM(CASE WHEN {_REAL} THEN 1 ELSE 0 END) OVER (PARTITION BY asn ORDER BY t, row_id {_PRIOR}), 0) AS BIGINT) AS seen
          FROM attempts) WHERE ok AND total >= 100 AND CAST(seen AS DOUBLE) / total <= 0.01::DOUBLE"""
query("rule_rare_network", with_attempts(RARE_SQL, 1))(run_rule("rare_network_login", {"asn_successes": L, "total_successes": L}, pace=1, params=FIXTURE["rare_network_login"]))

_IN = "EXISTS (SELECT 1 FROM ip_lists l WHERE l.list = '{}' AND " + st.IPN + " BETWEEN l.lo AND l.hi)"
REP_SQL = " UNION ALL ".join(
    f"SELECT row_id, '{rid}' AS rule_id, '{sev}' AS severity, '{mode}' AS mode FROM attempts WHERE {_IN.format(name)}"
    for rid, sev, mode, name in (("tor_exit", "medium", "enforce", "tor"), ("datacenter_ip", "low", "shadow", "datacenter"), ("vpn_ip", "low", "shadow", "vpn"))
)


@query("rule_reputation", with_attempts(REP_SQL, PACE, st.LISTS_CTE))
def rule_reputation(spark, sf):
    plan = R.Plan.of(None, ["tor_exit", "datacenter_ip", "vpn_ip"])
    intel = R.Intel(st.ip_lists(spark), ("tor", "datacenter", "vpn"))
    return R.hits(R.evaluate(read_attempts(spark, sf, PACE), plan, intel)).select("row_id", "rule_id", "severity", "mode")


query("rule_blocklist", with_attempts("SELECT row_id, kind, value FROM block_match", PACE, st.MATCH_CTE))(
    run_rule("blocklist_hit", {"kind": "string", "value": "string"}))


@query("blocklist_match", with_attempts("SELECT row_id, kind, value, reason FROM block_match", PACE, st.MATCH_CTE))
def blocklist_match(spark, sf):
    return bl.match(read_attempts(spark, sf, PACE), st.blocklist(spark)).select("row_id", "kind", "value", "reason")


@query(
    "blocklist_active",
    with_attempts("SELECT kind, value, expires_at FROM blocked, (SELECT MAX(t) AS now_t FROM attempts) WHERE expires_at IS NULL OR expires_at > now_t", PACE, st.BLOCK_CTE),
)
def blocklist_active(spark, sf):
    """Entries still live at the end of the log."""
    now = read_attempts(spark, sf, PACE).agg(F.max("t").alias("now_t"))
    entries = st.blocklist(spark).join(F.broadcast(now))
    return bl.active(entries, F.col("now_t")).select("kind", "value", "expires_at")


@query(
    "cidr_member",
    with_attempts(f"SELECT row_id, {_IN.format('tor')} AS in_tor, {_IN.format('datacenter')} AS in_datacenter, {_IN.format('vpn')} AS in_vpn FROM attempts", 1, st.LISTS_CTE),
)
def cidr_member(spark, sf):
    merged = merge_intervals(parse_networks(st.ip_lists(spark)), "list")
    out = read_attempts(spark, sf).select("row_id", "ip")
    for name in ("tor", "datacenter", "vpn"):
        out = in_ranges(out, merged.where(F.col("list") == name), f"in_{name}")
    return out.drop("ip")


@query(
    "cidr_normalize",
    with_attempts(
        f"""SELECT cidr, MIN(lo) AS lo, MIN(hi) AS hi, COUNT(*) AS attempts FROM (
        SELECT concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3), '.0/24') AS cidr, {st.IPN} // 256 * 256 AS lo, {st.IPN} // 256 * 256 + 255 AS hi FROM attempts) GROUP BY 1"""),
)
def cidr_normalize(spark, sf):
    """Addresses rolled up to their /24 network with its bounds."""
    raw = read_attempts(spark, sf).groupBy("ip").agg(F.count(F.lit(1)).alias("k"))
    raw = raw.withColumn("net", F.concat("ip", F.lit("/24")))
    lo, hi = geo.cidr_bounds(F.col("net"))
    raw = raw.withColumns({"cidr": bl.normalize(F.lit("cidr"), F.col("net")), "lo": lo, "hi": hi})
    return raw.groupBy("cidr").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.sum("k").alias("attempts"))


@query(
    "geo_enrich",
    with_attempts(f"SELECT row_id, range_asn, range_country FROM attempts LEFT JOIN ip_ranges ON {st.IPN} BETWEEN lo AND hi", 1, st.RANGES_CTE),
)
def geo_enrich(spark, sf):
    ranges = parse_networks(st.ip_ranges(spark)).select("lo", "hi", "range_asn", "range_country")
    return range_attributes(read_attempts(spark, sf).select("row_id", "ip"), ranges, ["range_asn", "range_country"]).drop("ip")


# ------------------------------------------------------------------ all rules

ALL_HITS = " UNION ALL ".join(
    [f"SELECT row_id, '{rid}' AS rule_id, '{sev}' AS severity, '{mode}' AS mode, CAST({scope} AS VARCHAR) AS scope FROM st WHERE {cond}" for rid, (sev, mode, scope, cond) in COND.items()]
    + [f"SELECT row_id, '{rid}', '{sev}', '{mode}', NULL FROM ({sql})" for rid, sev, mode, sql in (
        ("regular_rhythm", "medium", "shadow", RHYTHM_SQL), ("impossible_travel", "high", "enforce", TRAVEL_SQL),
        ("dormant_account_login", "medium", "enforce", DORMANT_SQL), ("rare_network_login", "medium", "shadow", RARE_SQL))]
    + [f"SELECT row_id, rule_id, severity, mode, NULL AS scope FROM ({REP_SQL})", "SELECT row_id, 'blocklist_hit', 'high', 'enforce', kind FROM block_match"]
)
ALL_HITS_CTES = (geo_cte(), STATE, st.LISTS_CTE, st.MATCH_CTE, f"hits AS ({ALL_HITS})")
HIT_RULES = [*COND, *FIXTURE, "impossible_travel", "tor_exit", "datacenter_ip", "vpn_ip", "blocklist_hit"]

FIXTURE_RULES = {k: {"params": v} for k, v in FIXTURE.items()}


def evaluated(spark, sf, keep=None, rules=None):
    intel = R.Intel(st.ip_lists(spark), ("tor", "datacenter", "vpn"), st.blocklist(spark))
    return R.evaluate(read_attempts(spark, sf, PACE), R.Plan.of(R.Config.from_dict({"rules": FIXTURE_RULES}), rules or HIT_RULES), intel, keep=keep)


@query("rule_hits", with_attempts("SELECT row_id, rule_id, severity, mode, scope FROM hits", PACE, *ALL_HITS_CTES))
def rule_hits(spark, sf):
    return R.hits(evaluated(spark, sf)).select("row_id", "rule_id", "severity", "mode", "scope")


SKIP_SQL = " UNION ALL ".join(
    f"SELECT row_id, '{rid}' AS rule_id, '{R.NEED_TEXT[need]}' AS reason FROM attempts WHERE {cond}"
    for rid, need, cond in (
        ("success_after_failures", "account", "uid IS NULL"), ("ua_rotation", "user_agent", "ua IS NULL"),
        ("multi_context_simultaneous", "account", "uid IS NULL"), ("multi_context_simultaneous", "country", "uid IS NOT NULL AND country IS NULL"),
        ("country_hop", "country", "country IS NULL"), ("tor_exit", "tor_list", "TRUE"))
)


@query("rule_skipped", with_attempts(SKIP_SQL, PACE))
def rule_skipped(spark, sf):
    """Rules that could not run, with the reason; the Tor list is not loaded here."""
    plan = R.Plan.of(None, ["success_after_failures", "ua_rotation", "multi_context_simultaneous", "country_hop", "tor_exit"])
    return R.skipped(R.evaluate(read_attempts(spark, sf, PACE), plan, R.Intel()))


@query(
    "rules_effective",
    with_attempts(
        """SELECT rule_id, CASE WHEN rule_id = 'country_hop' THEN 'enforce' ELSE MIN(mode) END AS mode, rule_id IN ('country_hop', 'brute_force') AS overridden, COUNT(*) AS hits
        FROM hits WHERE rule_id <> 'brute_force' GROUP BY rule_id
        UNION ALL SELECT 'brute_force', 'enforce', TRUE, COUNT(*) FROM st WHERE NOT success AND fu5 >= 8""", PACE, *ALL_HITS_CTES),
)
def rules_effective(spark, sf):
    """Modes and hit counts per rule after configuration overrides."""
    config = R.Config.from_dict({"rules": {**FIXTURE_RULES, "country_hop": {"mode": "enforce"}, "brute_force": {"params": {"threshold": 8}}}})
    intel = R.Intel(st.ip_lists(spark), ("tor", "datacenter", "vpn"), st.blocklist(spark))
    h = R.hits(R.evaluate(read_attempts(spark, sf, PACE), R.Plan.of(config, HIT_RULES), intel)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    eff = R.effective(spark, st.overrides(spark))
    return eff.join(h, "rule_id").select("rule_id", "mode", "overridden", "hits")


# -------------------------------------------------------------------- tallies

TALLY_SQL = """SELECT h.rule_id, COUNT(*) AS hits, COUNT(*) FILTER (WHERE a.success) AS success_hits,
  COUNT(*) FILTER (WHERE a.is_attack_ip) AS attack_hits, COUNT(*) FILTER (WHERE a.is_ato) AS ato_hits,
  COUNT(*) FILTER (WHERE NOT a.is_attack_ip AND NOT a.is_ato) AS unlabelled_hits,
  COUNT(DISTINCT CASE WHEN a.is_attack_ip THEN a.ip END) AS attack_ips, COUNT(DISTINCT CASE WHEN NOT a.is_attack_ip THEN a.ip END) AS other_ips,
  COUNT(*) FILTER (WHERE h.scope = 'ip') AS ip_scope_hits, COUNT(*) FILTER (WHERE h.scope = 'asn') AS asn_scope_hits,
  round(10000.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM attempts), 6) AS per_10k
  FROM hits h JOIN attempts a USING (row_id) GROUP BY 1"""


@query("rule_tally", with_attempts(TALLY_SQL, PACE, *ALL_HITS_CTES))
def rule_tally(spark, sf):
    return tally.per_rule(*tally.labelled_hits(read_attempts(spark, sf, PACE), evaluated(spark, sf)))


@query(
    "rule_tally_any",
    with_attempts(
        """SELECT (SELECT COUNT(*) FROM attempts) AS events, COUNT(DISTINCT row_id) AS any_rule, COUNT(DISTINCT CASE WHEN mode = 'enforce' THEN row_id END) AS any_enforced FROM hits""",
        PACE, *ALL_HITS_CTES),
)
def rule_tally_any(spark, sf):
    return tally.any_rule(evaluated(spark, sf))


@query(
    "rule_samples",
    with_attempts(
        """SELECT rule_id, row_id, ip FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY row_id) AS rn FROM
          (SELECT h.rule_id, a.ip, MIN(h.row_id) AS row_id FROM hits h JOIN attempts a USING (row_id) GROUP BY 1, 2)) WHERE rn <= 3""", PACE, *ALL_HITS_CTES),
)
def rule_samples(spark, sf):
    """Up to three example hits per rule, from distinct addresses (a report feature)."""
    return tally.samples(evaluated(spark, sf, keep=["ip"]), 3)


# ---------------------------------------------------------------- tiers 1 - 3

_U5 = "COUNT(DISTINCT CASE WHEN NOT success THEN username END) OVER (PARTITION BY ip ORDER BY t " + rg(300 * SECOND) + ")"
TIER1 = f"""t1 AS (SELECT a.*, {n(NF, 'username', 300)} AS fu5, {n(NF, 'ip', 300)} AS fp5, {_U5} AS up5,
  LAG(t) OVER (PARTITION BY uid ORDER BY t, row_id) AS pt, LAG(country) OVER (PARTITION BY uid ORDER BY t, row_id) AS pc FROM attempts a)"""
TIER1_SQL = f"""SELECT row_id, 'brute_force' AS alert_type FROM t1 WHERE NOT success AND fu5 >= 5
 UNION ALL SELECT row_id, 'credential_stuffing' FROM t1 WHERE NOT success AND fp5 >= 10 AND up5 >= 5
 UNION ALL SELECT row_id, 'impossible_travel' FROM (SELECT x.row_id, {HAV} AS km, (x.t - x.pt) / {HOUR}.0::DOUBLE AS h FROM t1 x JOIN geo g ON g.country = x.country JOIN geo p ON p.country = x.pc WHERE x.uid IS NOT NULL) WHERE h > 0 AND km / h > 900"""


@query("tier1_alerts", with_attempts(TIER1_SQL, PACE, geo_cte(), TIER1))
def tier1_alerts(spark, sf):
    return tiers.tier1(read_attempts(spark, sf, PACE)).select("row_id", F.explode("alerts").alias("alert_type"))


_HR = "(hour(make_timestamp(t)) + minute(make_timestamp(t)) / 60.0::DOUBLE)"
BASE = f"""bs AS (SELECT a.*, {_HR} AS hr,
   COUNT(*) FILTER (WHERE success) OVER w AS n_ok, AVG(CASE WHEN success THEN {_HR} END) OVER w AS avg_hr,
   STDDEV_POP(CASE WHEN success THEN {_HR} END) OVER w AS sd_hr, MIN(CASE WHEN success THEN t END) OVER w AS first_ok
   FROM attempts a WHERE uid IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY t, row_id {_PRIOR}))"""


@query(
    "baseline_so_far",
    with_attempts("SELECT row_id, round(hr, 6) AS login_hour, n_ok AS successes_so_far, round(avg_hr, 9) AS avg_hour, round(sd_hr, 9) AS sd_hour, first_ok AS first_login_t FROM bs WHERE success", 1, BASE),
)
def baseline_so_far(spark, sf):
    out = tiers.baseline(read_attempts(spark, sf).where("uid IS NOT NULL")).where("success")
    return out.select("row_id", F.round("login_hour", 6).alias("login_hour"), "successes_so_far", F.round("avg_hour", 9).alias("avg_hour"), F.round("sd_hour", 9).alias("sd_hour"), "first_login_t")


_LEARN = f"(n_ok < 10 OR (t - first_ok) // {DAY} < 7)"


@query("learning_mode", with_attempts(f"SELECT row_id, {_LEARN} AS learning FROM bs", 1, BASE))
def learning_mode(spark, sf):
    return tiers.baseline(read_attempts(spark, sf).where("uid IS NOT NULL")).select("row_id", tiers.learning().alias("learning"))


TIER2 = f"""t2 AS (SELECT bs.*, {_LEARN} AS learning, {_OKSUM.format('country')} AS loc_seen, {n(NF, 'username', 300)} AS fu5 FROM bs),
t2s AS (SELECT row_id, CAST(LEAST(100,
   20 * CAST(NOT learning AND least(abs(hr - avg_hr), 24 - abs(hr - avg_hr)) > 2.5::DOUBLE * greatest(COALESCE(sd_hr, 0), 0.5::DOUBLE) AS INT)
   + 30 * CAST(NOT learning AND country IS NOT NULL AND loc_seen = 0 AS INT)
   + 40 * CAST(NOT success AND fu5 >= 5 AS INT) + 50 * CAST(success AND fu5 >= 3 AS INT)) AS INT) AS score FROM t2)"""


@query(
    "tier2_score",
    with_attempts("SELECT row_id, COALESCE(score, 0) AS score, CASE WHEN COALESCE(score, 0) < 40 THEN 'low' WHEN score <= 70 THEN 'medium' ELSE 'high' END AS severity FROM t2s", 24, BASE, TIER2),
)
def tier2_score(spark, sf):
    return tiers.tier2(read_attempts(spark, sf, 24)).select("row_id", F.col("score").cast("int").alias("score"), "severity")


@query(
    "features_tier3",
    with_attempts(
        f"""SELECT x.row_id, round(sin(2 * pi() * hr / 24), 6) + 0.0::DOUBLE AS hour_sin, round(cos(2 * pi() * hr / 24), 6) + 0.0::DOUBLE AS hour_cos,
        CAST((dayofweek(make_timestamp(t)) + 6) % 7 AS DOUBLE) AS day_of_week,
        round(CASE WHEN avg_hr IS NULL THEN 0 ELSE least(abs(hr - avg_hr), 24 - abs(hr - avg_hr)) END, 9) + 0.0::DOUBLE AS hour_deviation_from_avg,
        CASE WHEN x.country IS NULL OR loc_seen > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_new_location,
        CASE WHEN x.ua IS NULL OR dev_seen > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS is_new_device,
        COALESCE((t - last_ok) / 60000000.0::DOUBLE, 1440.0::DOUBLE) AS minutes_since_last_login, CAST(last24 AS DOUBLE) AS logins_last_24h,
        round(CASE WHEN g.lat IS NULL OR p.lat IS NULL THEN 0 ELSE {HAV} END, 6) AS distance_km_from_home
        FROM (SELECT bs.*, {_OKSUM.format('country')} AS loc_seen, {_OKSUM.format('ua')} AS dev_seen,
           MAX(CASE WHEN success THEN t END) OVER (PARTITION BY uid ORDER BY t, row_id {_PRIOR}) AS last_ok,
           COUNT(*) FILTER (WHERE success) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND 1 PRECEDING) AS last24,
           arg_min(country, (t, row_id)) FILTER (WHERE success AND country IS NOT NULL) OVER (PARTITION BY uid ORDER BY t, row_id {_PRIOR}) AS home FROM bs) x
        LEFT JOIN geo g ON g.country = x.country LEFT JOIN geo p ON p.country = x.home WHERE success""", 1, geo_cte(), BASE),
)
def features_tier3(spark, sf):
    out = tiers.tier3_features(read_attempts(spark, sf))
    digits = {"hour_sin": 6, "hour_cos": 6, "hour_deviation_from_avg": 9, "distance_km_from_home": 6}
    return out.select("row_id", *tiers.TIER3_FEATURES).withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in digits.items()})


@query("tier3_explain")
def tier3_explain(spark, sf):
    """The up to three most deviating tier-3 features of each login against the population."""
    feats = tiers.tier3_features(read_attempts(spark, sf))
    return tiers.tier3_explain(feats)
