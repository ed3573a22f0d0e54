"""Hybrid score, thresholds, response, alerts and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import Bands, action_rank, band_action, interpolate, noisy_or
from ..functions.text import percent_text, window_text
from ..functions.timefn import DAY, MINUTE
from ..plans import alerts as al
from ..plans import blocklist as bl
from ..plans import campaigns as cp
from ..plans import live_campaigns as lc
from ..plans import hybrid as hy
from ..plans import rules as R
from ..sources.attempts import read_attempts
from . import side_tables as st
from .fixture import with_attempts
from .registry import query
from .rule_queries import ALL_HITS_CTES, HIT_RULES, PACE, evaluated

WEIGHTS = {
    "brute_force": 0.3, "credential_stuffing": 0.4, "password_spray_slow": 0.15, "distributed_bruteforce": 0.25,
    "username_enumeration": 0.2, "success_after_failures": 0.35, "tor_exit": 0.45, "datacenter_ip": 0.1, "vpn_ip": 0.08,
}
XS, YS = [0.0, 20.0, 40.0, 70.0, 95.0], [0.0, 0.02, 0.1, 0.5, 0.9]


def model_score():
    """A stand-in model score: any column of scores can be calibrated."""
    return (F.col("row_id") % 37) * 2.5 + F.when(F.col("is_attack_ip"), 7.5).otherwise(0.0)


MODEL_SQL = "((row_id % 37) * 2.5::DOUBLE + CASE WHEN is_attack_ip THEN 7.5::DOUBLE ELSE 0.0::DOUBLE END)"
CAL_SQL = "CASE WHEN s <= 0 THEN 0.0::DOUBLE WHEN s <= 20 THEN 0.0::DOUBLE + (s - 0) * (0.02::DOUBLE / 20) WHEN s <= 40 THEN 0.02::DOUBLE + (s - 20) * (0.08::DOUBLE / 20) WHEN s <= 70 THEN 0.1::DOUBLE + (s - 40) * (0.4::DOUBLE / 30) WHEN s <= 95 THEN 0.5::DOUBLE + (s - 70) * (0.4::DOUBLE / 25) ELSE 0.9::DOUBLE END"


@query("calibrate_interp", with_attempts(f"SELECT row_id, round({CAL_SQL}, 9) AS p FROM (SELECT row_id, {MODEL_SQL} AS s FROM attempts)"))
def calibrate_interp(spark, sf):
    return read_attempts(spark, sf).select("row_id", F.round(interpolate(model_score(), XS, YS), 9).alias("p"))


@query(
    "noisy_or",
    with_attempts("SELECT row_id, round(1 - (CASE WHEN success THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) * (CASE WHEN uid IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN is_attack_ip THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS p FROM attempts"),
)
def noisy_or_query(spark, sf):
    ps = F.array(F.when(~F.col("success"), 0.2), F.when(F.col("uid").isNull(), 0.3), F.when(F.col("is_attack_ip"), 1.7))
    return read_attempts(spark, sf).select("row_id", F.round(noisy_or(ps), 9).alias("p"))


@query("severity_bands", with_attempts("SELECT CASE WHEN s < 40 THEN 'low' WHEN s <= 70 THEN 'medium' ELSE 'high' END AS severity, COUNT(*) AS n FROM (SELECT " + MODEL_SQL + " AS s FROM attempts) GROUP BY 1"))
def severity_bands(spark, sf):
    from ..functions.scoring import severity

    return read_attempts(spark, sf).groupBy(severity(model_score()).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("action_bands", with_attempts("SELECT row_id, CASE WHEN s >= 70 THEN 'lock' WHEN s >= 58 THEN 'step_up' WHEN s >= 32 THEN 'alert' ELSE 'allow' END AS action FROM (SELECT row_id, " + MODEL_SQL + " AS s FROM attempts)"))
def action_bands(spark, sf):
    return read_attempts(spark, sf).select("row_id", band_action(model_score()).alias("action"))


# ------------------------------------------------------------------ hybrid

_W = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 0.05::DOUBLE END"
_REP = "rule_id IN ('tor_exit', 'datacenter_ip', 'vpn_ip', 'blocklist_hit')"
_CAT = f"CASE WHEN {_REP} THEN 'infrastructure reputation' WHEN rule_id IN ('bot_user_agent', 'scripted_client', 'ua_rotation', 'regular_rhythm') THEN 'automation' WHEN rule_id IN ('impossible_travel', 'multi_context_simultaneous', 'country_hop', 'dormant_account_login', 'rare_network_login') THEN 'account context' ELSE 'password guessing' END"
_ORDER = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate([
    "brute_force", "credential_stuffing", "password_spray_slow", "distributed_bruteforce", "username_enumeration", "success_after_failures",
    "bot_user_agent", "scripted_client", "ua_rotation", "regular_rhythm", "impossible_travel", "multi_context_simultaneous", "country_hop",
    "dormant_account_login", "rare_network_login", "tor_exit", "datacenter_ip", "vpn_ip", "blocklist_hit"])) + " END"
_FOLD = "list_reduce(list_prepend(1.0::DOUBLE, COALESCE(list(1 - {w} ORDER BY {o}) FILTER (WHERE {c}), []::DOUBLE[])), lambda a, b: a * b)"
HYBRID = f"""agg AS (SELECT row_id, 1 - {_FOLD.format(w=_W, o=_ORDER, c=f"NOT ({_REP})")} AS rule_p, 1 - {_FOLD.format(w=_W, o=_ORDER, c=_REP)} AS rep_p,
   bool_or(rule_id = 'blocklist_hit') AS over FROM hits GROUP BY 1),
top AS (SELECT row_id, rule_id AS top_rule, {_W} AS confidence, {_CAT} AS family FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY {_W} DESC, {_ORDER}) AS rn FROM hits) WHERE rn = 1),
hyb AS (SELECT m.row_id, m.t, m.uid, m.username, m.ip, m.asn, m.device_type, m.p AS ml_p, COALESCE(a.rule_p, 0) AS rule_p, COALESCE(a.rep_p, 0) AS rep_p, COALESCE(a.over, FALSE) AS over,
   CASE WHEN COALESCE(a.over, FALSE) THEN 1.0::DOUBLE ELSE 1 - (1 - m.p) * (1 - COALESCE(a.rule_p, 0)) * (1 - COALESCE(a.rep_p, 0)) END AS p
   FROM (SELECT *, {CAL_SQL} AS p FROM (SELECT *, {MODEL_SQL} AS s FROM attempts)) m LEFT JOIN agg a USING (row_id)),
scored AS (SELECT h.*, sc AS score, CASE WHEN over THEN 'lock' WHEN sc >= 70 THEN 'lock' WHEN sc >= 58 THEN 'step_up' WHEN sc >= 32 THEN 'alert' ELSE 'allow' END AS action,
   COALESCE(CASE WHEN over THEN 'blocklist_hit' END, t.top_rule) AS top_rule, COALESCE(t.confidence, ml_p) AS confidence, COALESCE(t.family, 'unusual login (model)') AS family
   FROM (SELECT *, CAST(round_even(p * 100, 0) AS INT) AS sc FROM hyb) h LEFT JOIN top t USING (row_id))"""
HYBRID_CTES = (*ALL_HITS_CTES, HYBRID)


def scored_attempts(spark, sf):
    attempts = read_attempts(spark, sf, PACE)
    keep = ["t", "uid", "username", "ip", "asn", "device_type"]
    ev = evaluated(spark, sf, keep=keep)
    # the model score is a column of the attempt; labels are read here only because the stand-in score uses one
    ml = attempts.select(F.col("row_id").alias("_m"), interpolate(model_score(), XS, YS).alias("ml_probability"))
    joined = ev.join(ml, F.col("row_id") == F.col("_m")).drop("_m")
    return hy.family(hy.combine(joined, hy.Weights(WEIGHTS)))


def account_importance():
    return F.coalesce(F.lit(1.0) + F.col("uid") % 3, F.lit(1.0))


def alert_rows(spark, sf, *also):
    """Attempts that raise an alert, with family, confidence and the priority of their evidence alone.

    The SQL of ``alert_dedup``, ``lock_entries`` and ``alerts_page`` is made from these rows; ``ranked_alerts`` counts novel facets as well.
    """
    scored = scored_attempts(spark, sf).where("action <> 'allow'")
    importance = account_importance()
    keep = ["row_id", "t", "uid", "username", "ip", "score", "action", "family", "confidence", "contributions", *also]
    return scored.select(*keep, al.priority(F.lit(0), F.col("confidence"), importance).alias("priority"))


def ranked_alerts(spark, sf):
    """Alerts with their novelty facts and the priority these give them."""
    rows = al.with_novelty(alert_rows(spark, sf).drop("contributions"), al.novelty(read_attempts(spark, sf, PACE)))
    return rows.withColumn("priority", al.priority(F.size("novelty"), F.col("confidence"), account_importance()))


ALERT_CTE = """alert_rows AS (SELECT *, round(confidence * COALESCE(1 + uid % 3, 1), 4) AS priority, COALESCE('u:' || CAST(uid AS VARCHAR), 'ip:' || ip) AS dedup_key FROM scored WHERE action <> 'allow')"""
CHAIN = f"""chain AS (
  SELECT dedup_key, family, MIN(t) AS a FROM alert_rows GROUP BY 1, 2
  UNION ALL
  SELECT c.dedup_key, c.family, (SELECT MIN(x.t) FROM alert_rows x WHERE x.dedup_key = c.dedup_key AND x.family = c.family AND x.t > c.a + {15 * MINUTE}) AS a
  FROM chain c WHERE c.a IS NOT NULL),
merged AS (SELECT r.*, (SELECT MAX(c.a) FROM chain c WHERE c.dedup_key = r.dedup_key AND c.family = r.family AND c.a <= r.t) AS anchor_t FROM alert_rows r),
alerts AS (SELECT arg_min(row_id, (t, row_id)) AS alert_id, dedup_key, family, anchor_t AS first_seen_t, MAX(t) AS last_seen_t, COUNT(*) AS occurrences, MAX(score) AS risk_score,
  arg_max(action, CASE action WHEN 'lock' THEN 3 WHEN 'step_up' THEN 2 ELSE 1 END) AS action, MAX(priority) AS priority, MIN(uid) AS uid FROM merged GROUP BY dedup_key, family, anchor_t)"""


def recursive(sql: str, *ctes: str) -> str:
    return with_attempts(sql, PACE, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


ALERT_CTES = (*HYBRID_CTES, ALERT_CTE, CHAIN)


@query(
    "hybrid_score",
    with_attempts("SELECT row_id, score, action, round(p, 9) AS probability, round(rule_p, 9) AS rule_probability, round(rep_p, 9) AS reputation_probability, over AS overridden FROM scored", PACE, *HYBRID_CTES),
)
def hybrid_score(spark, sf):
    s = scored_attempts(spark, sf)
    return s.select(
        "row_id", "score", "action", F.round("probability", 9).alias("probability"), F.round("rule_probability", 9).alias("rule_probability"),
        F.round("reputation_probability", 9).alias("reputation_probability"), F.col("overridden_by").isNotNull().alias("overridden"))


@query("attack_family", with_attempts("SELECT row_id, family, round(confidence, 9) AS confidence, top_rule FROM scored", PACE, *HYBRID_CTES))
def attack_family(spark, sf):
    return scored_attempts(spark, sf).select("row_id", "family", F.round("confidence", 9).alias("confidence"), "top_rule")


@query("alert_dedup", recursive("SELECT alert_id, dedup_key, family, first_seen_t, last_seen_t, occurrences, risk_score, action, priority FROM alerts", *ALERT_CTES))
def alert_dedup(spark, sf):
    return al.dedup(alert_rows(spark, sf))


@query(
    "lock_entries",
    recursive(
        f"""SELECT kind, value, MAX(t) + {30 * MINUTE} AS expires_at, COUNT(*) AS locks FROM (
          SELECT *, CASE WHEN uid IS NOT NULL THEN 'username' ELSE 'ip' END AS kind, CASE WHEN uid IS NOT NULL THEN username ELSE ip END AS value,
            MAX(CASE action WHEN 'lock' THEN 3 WHEN 'step_up' THEN 2 ELSE 1 END) OVER (PARTITION BY dedup_key, family, anchor_t ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worst
          FROM merged) WHERE action = 'lock' AND (worst IS NULL OR worst < 3) GROUP BY 1, 2""", *ALERT_CTES),
)
def lock_entries(spark, sf):
    # the contributions would be written with every alert, and no later step reads them
    return bl.lock_entries(al.escalations(alert_rows(spark, sf).drop("contributions")).where("action = 'lock'"))


VERDICTS = "verdicts AS (SELECT row_id AS alert_id, uid, CASE row_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'false_positive' END AS status, t FROM attempts WHERE NOT success)"


def verdict_rows(spark, sf):
    r = F.col("row_id") % 4
    status = F.when(r == 0, "open").when(r == 1, "resolved").otherwise("false_positive")
    return read_attempts(spark, sf, PACE).where("NOT success").select(F.col("row_id").alias("alert_id"), "uid", status.alias("status"), "t")


TALLY = "fb AS (SELECT uid, COUNT(*) AS verdicts, COUNT(*) FILTER (WHERE status = 'false_positive') AS false_positives FROM verdicts WHERE uid IS NOT NULL AND status <> 'open' GROUP BY 1)"
DELTA = "fd AS (SELECT *, CASE WHEN verdicts < 3 THEN 0.0::DOUBLE WHEN 2 * false_positives - verdicts <= 0 THEN 0.0::DOUBLE ELSE least(4.0::DOUBLE * (2 * false_positives - verdicts), 20.0::DOUBLE) END AS delta FROM fb)"


@query("feedback_tally", with_attempts("SELECT * FROM fb", PACE, VERDICTS, TALLY))
def feedback_tally(spark, sf):
    return hy.feedback_tally(verdict_rows(spark, sf))


@query("adaptive_delta", with_attempts("SELECT uid, delta FROM fd", PACE, VERDICTS, TALLY, DELTA))
def adaptive_delta(spark, sf):
    return hy.user_bands(hy.feedback_tally(verdict_rows(spark, sf))).select("uid", "delta")


_SHIFT = "CAST(CASE WHEN delta <= 0 THEN 0 ELSE round_even(least(delta, 20.0::DOUBLE, 30.0::DOUBLE), 0) END AS INT)"


@query("adaptive_bands", with_attempts(f"SELECT uid, 32 + {_SHIFT} AS alert_at, 58 + {_SHIFT} AS step_up_at, 70 + {_SHIFT} AS lock_at FROM fd", PACE, VERDICTS, TALLY, DELTA))
def adaptive_bands(spark, sf):
    return hy.user_bands(hy.feedback_tally(verdict_rows(spark, sf))).select("uid", "alert_at", "step_up_at", "lock_at")


@query(
    "adaptive_actions",
    with_attempts(
        f"""SELECT row_id, CASE WHEN over THEN 'lock' WHEN score >= 70 + d THEN 'lock' WHEN score >= 58 + d THEN 'step_up' WHEN score >= 32 + d THEN 'alert' ELSE 'allow' END AS action
        FROM (SELECT s.*, CASE WHEN delta IS NULL THEN 0 ELSE {_SHIFT} END AS d FROM scored s LEFT JOIN fd USING (uid))""", PACE, *HYBRID_CTES, VERDICTS, TALLY, DELTA),
)
def adaptive_actions(spark, sf):
    personal = hy.user_bands(hy.feedback_tally(verdict_rows(spark, sf)))
    return hy.apply_user_bands(scored_attempts(spark, sf), personal).select("row_id", "action")


OPS = f"""ops AS (SELECT t, row_id AS seq, CASE WHEN row_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, 'ip' AS kind, ip AS value, CASE WHEN row_id % 3 = 1 THEN t + {30 * MINUTE} END AS expires_at FROM attempts WHERE is_attack_ip)"""


def block_ops(spark, sf):
    r = F.col("row_id") % 3
    return read_attempts(spark, sf, PACE).where("is_attack_ip").select(
        "t", F.col("row_id").alias("seq"), F.when(r == 0, "remove").otherwise("add").alias("op"), F.lit("ip").alias("kind"), F.col("ip").alias("value"),
        F.lit("auto").alias("reason"), F.lit("system").alias("actor"), F.when(r == 1, F.col("t") + 30 * MINUTE).alias("expires_at"))


@query(
    "blocklist_state",
    with_attempts(
        """SELECT kind, value, expires_at FROM blocked b WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.kind = b.kind AND o.value = b.value)
        UNION ALL SELECT kind, value, expires_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind, value ORDER BY t DESC, seq DESC) AS rn FROM ops) WHERE rn = 1 AND op = 'add'""", PACE, st.BLOCK_CTE, OPS),
)
def blocklist_state(spark, sf):
    state, _ = bl.apply_operations(st.blocklist(spark), block_ops(spark, sf))
    return state.select("kind", "value", "expires_at")


@query("blocklist_audit", with_attempts("SELECT concat('blocklist_', op) AS action, concat(kind, ':', value) AS target, COUNT(*) AS n FROM ops GROUP BY 1, 2", PACE, OPS))
def blocklist_audit(spark, sf):
    _, audit = bl.apply_operations(st.blocklist(spark), block_ops(spark, sf))
    return audit.groupBy("action", "target").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- alerts

NOVEL = """vals AS (SELECT row_id, t, uid, success, 'country' AS attribute, country AS v FROM attempts WHERE uid IS NOT NULL
  UNION ALL SELECT row_id, t, uid, success, 'asn', 'AS' || CAST(asn AS VARCHAR) FROM attempts WHERE uid IS NOT NULL
  UNION ALL SELECT row_id, t, uid, success, 'device', device_type FROM attempts WHERE uid IS NOT NULL),
firsts AS (SELECT uid, attribute, MIN(t) AS first_ok FROM vals WHERE success GROUP BY 1, 2),
seen AS (SELECT r.row_id, r.attribute, p.v, COUNT(*) AS n, MIN((p.t, p.row_id)) AS f FROM vals r JOIN vals p ON p.uid = r.uid AND p.attribute = r.attribute AND p.t < r.t AND p.success AND p.v IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT row_id, attribute, v, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id, attribute ORDER BY n DESC, f) AS rn FROM seen) WHERE rn = 1),
novel AS (SELECT r.row_id, r.attribute, r.v AS new_value, b.v AS usual_value, COALESCE(b.n, 0) AS usual_count FROM vals r
  JOIN firsts f ON f.uid = r.uid AND f.attribute = r.attribute AND f.first_ok < r.t LEFT JOIN best b ON b.row_id = r.row_id AND b.attribute = r.attribute
  WHERE r.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.row_id = r.row_id AND s.attribute = r.attribute AND s.v = r.v))"""


@query("novelty", with_attempts("SELECT row_id, attribute, new_value, usual_value, usual_count FROM novel", PACE, NOVEL))
def novelty(spark, sf):
    return al.novelty(read_attempts(spark, sf, PACE))


@query(
    "alert_priority",
    with_attempts(
        """SELECT row_id, round((1 + COALESCE(n, 0)) * confidence * COALESCE(1 + uid % 3, 1), 4) AS priority
        FROM alert_rows LEFT JOIN (SELECT row_id, COUNT(*) AS n FROM novel GROUP BY 1) USING (row_id)""", PACE, *HYBRID_CTES, ALERT_CTE, NOVEL),
)
def alert_priority(spark, sf):
    return ranked_alerts(spark, sf).select("row_id", "priority")


@query("alert_message")
def alert_message(spark, sf):
    """The sentence of every alert: reasons, first novel facet, family, repeats in its group so far."""
    rows = al.with_occurrences(hy.with_hit_texts(alert_rows(spark, sf, "hits")).drop("hits"))
    rows = al.with_novelty(rows, al.novelty(read_attempts(spark, sf, PACE)))
    return rows.select("row_id", al.message(F.col("occurrences")).alias("message"))


@query(
    "messages",
    with_attempts(
        """SELECT row_id, CASE WHEN s < 90 THEN concat(CAST(s AS VARCHAR), ' seconds') WHEN s < 5400 AND s % 60 = 0 THEN concat(CAST(s // 60 AS VARCHAR), ' minutes')
          WHEN s < 129600 AND s % 3600 = 0 THEN concat(CAST(s // 3600 AS VARCHAR), ' hours') ELSE concat(CAST(s // 86400 AS VARCHAR), ' days') END AS window_label,
        concat(CAST(row_id % 101 AS VARCHAR), '%') AS share_label
        FROM (SELECT row_id, CASE row_id % 4 WHEN 0 THEN 45 WHEN 1 THEN 60 * (2 + row_id % 30) WHEN 2 THEN 3600 * (2 + row_id % 30) ELSE 86400 * (2 + row_id % 30) END AS s FROM attempts)"""),
)
def messages(spark, sf):
    r = F.col("row_id")
    step = 2 + r % 30
    s = F.when(r % 4 == 0, 45).when(r % 4 == 1, step * 60).when(r % 4 == 2, step * 3600).otherwise(step * 86400)
    return read_attempts(spark, sf).select("row_id", window_text(s).alias("window_label"), percent_text((r % 101) / F.lit(100.0)).alias("share_label"))


VERDICT_LOG = "vlog AS (SELECT row_id - row_id % 5 AS alert_id, CASE row_id % 3 WHEN 0 THEN 'correct' ELSE 'false_positive' END AS verdict, t FROM attempts WHERE row_id % 5 <> 0)"


@query(
    "alert_status",
    with_attempts(
        """SELECT a.row_id AS alert_id, CASE v.verdict WHEN 'false_positive' THEN 'false_positive' WHEN 'correct' THEN 'resolved' ELSE 'open' END AS status
        FROM (SELECT row_id FROM attempts WHERE NOT success) a LEFT JOIN (SELECT alert_id, arg_max(verdict, (t, verdict)) AS verdict FROM vlog GROUP BY 1) v ON v.alert_id = a.row_id""", PACE, VERDICT_LOG),
)
def alert_status(spark, sf):
    df = read_attempts(spark, sf, PACE)
    r = F.col("row_id")
    # every attempt between two multiples of five is read as a verdict on the earlier one
    log = df.where(r % 5 != 0).select((r - r % 5).alias("alert_id"), F.when(r % 3 == 0, "correct").otherwise("false_positive").alias("verdict"), "t")
    return al.apply_verdicts(df.where("NOT success").select(r.alias("alert_id")), log)


@query(
    "alerts_page",
    recursive("SELECT alert_id, family, priority, action FROM alerts WHERE action = 'lock' ORDER BY priority DESC NULLS LAST, last_seen_t DESC, alert_id DESC LIMIT 20 OFFSET 20", *ALERT_CTES),
)
def alerts_page(spark, sf):
    """Second page of 20 locked alerts by priority."""
    return al.alerts_view(al.dedup(alert_rows(spark, sf)), filters={"action": "lock"}, number=2, size=20).select("alert_id", "family", "priority", "action")


@query(
    "events_filter",
    with_attempts(
        f"""SELECT row_id, username, t, score, (SELECT COUNT(*) FROM m) AS total FROM m ORDER BY t DESC, row_id DESC LIMIT 50""", 1,
        f"m AS (SELECT *, {MODEL_SQL} AS score FROM attempts WHERE username ILIKE '%U1%' AND NOT success AND {MODEL_SQL} > 70)"),
)
def events_filter(spark, sf):
    df = read_attempts(spark, sf).withColumn("score", model_score())
    return al.events_view(df, name_like="U1", success=False, band="high").select("row_id", "username", "t", "score", "total")


# ---------------------------------------------------------------- campaigns

ATO = "nodes AS (SELECT row_id, t, uid, ip, asn, username, device_type FROM attempts WHERE is_ato)"


def _components(days: str) -> str:
    return f"""w(days) AS (VALUES {days}),
links AS (SELECT w.days, a.row_id AS a, b.row_id AS b FROM nodes a JOIN nodes b ON (a.ip = b.ip OR a.asn = b.asn) JOIN w ON abs(a.t - b.t) <= w.days * {DAY}),
reach AS (SELECT days, a AS row_id, b AS other FROM links UNION SELECT r.days, r.row_id, l.b FROM reach r JOIN links l ON l.days = r.days AND l.a = r.other),
comp AS (SELECT w.days, n.row_id, COALESCE(MIN(r.other), n.row_id) AS campaign FROM nodes n CROSS JOIN w LEFT JOIN reach r ON r.row_id = n.row_id AND r.days = w.days GROUP BY 1, 2)"""


def ato_nodes(spark, sf):
    return read_attempts(spark, sf).where("is_ato").select("row_id", "t", "uid", "ip", "asn", "username", "device_type")


@query("campaigns", with_attempts("SELECT row_id, campaign FROM comp", 1, ATO, _components("(1)")).replace("WITH ", "WITH RECURSIVE ", 1))
def campaigns(spark, sf):
    return cp.correlate(ato_nodes(spark, sf), [DAY]).select("row_id", "campaign")


@query(
    "campaign_windows",
    with_attempts(
        """SELECT days, COUNT(*) AS campaigns, COUNT(*) FILTER (WHERE v >= 2) AS multi_victim, round(SUM(CASE WHEN v >= 2 THEN n ELSE 0 END) * 100.0::DOUBLE / SUM(n), 6) AS coverage_pct, MAX(n) AS largest,
          COALESCE(array_to_string(list_slice(list_reverse_sort(list(n) FILTER (WHERE v >= 2)), 1, 3), ','), '') AS top
        FROM (SELECT days, campaign, COUNT(*) AS n, COUNT(DISTINCT uid) AS v FROM comp JOIN nodes USING (row_id) GROUP BY 1, 2) GROUP BY 1""", 1, ATO, _components("(1), (7), (30), (90)")).replace("WITH ", "WITH RECURSIVE ", 1),
)
def campaign_windows(spark, sf):
    nodes = ato_nodes(spark, sf)
    out = cp.summary(nodes, cp.correlate(nodes, [d * DAY for d in (1, 7, 30, 90)]))
    return out.select((F.col("window_us") / DAY).cast("int").alias("days"), "campaigns", "multi_victim", "coverage_pct", "largest", F.array_join("top", ",").alias("top"))


@query(
    "campaign_live",
    with_attempts(
        f"""SELECT a.row_id, COUNT(b.row_id) FILTER (WHERE b.ip = a.ip) AS same_ip, COUNT(b.row_id) FILTER (WHERE b.asn = a.asn) AS same_asn, COUNT(b.row_id) AS linked
        FROM al a LEFT JOIN al b ON (b.ip = a.ip OR b.asn = a.asn) AND b.t >= a.t - {DAY} AND (b.t, b.row_id) < (a.t, a.row_id) AND NOT (b.uid IS NOT NULL AND b.uid IS NOT DISTINCT FROM a.uid)
        GROUP BY 1""", 1, "al AS (SELECT * FROM attempts WHERE NOT success)"),
)
def campaign_live(spark, sf):
    """For each failed attempt: earlier ones of other accounts on the same ip or network within 24 hours."""
    return cp.infra_links(read_attempts(spark, sf).where("NOT success"))


# The order of the alerts, pair by pair: who links whom, who is pulled in by whom first, whose campaign is joined.
LIVE = f"""al AS (SELECT * FROM attempts WHERE NOT success),
linked AS (SELECT a.row_id AS i, a.t AS ti, b.row_id AS j, b.t AS tj FROM al a JOIN al b ON (b.ip = a.ip OR b.asn = a.asn) AND b.t >= a.t - {DAY} AND (b.t, b.row_id) < (a.t, a.row_id) AND NOT (b.uid IS NOT NULL AND b.uid IS NOT DISTINCT FROM a.uid)),
pulled AS (SELECT j, arg_min(i, (ti, i)) AS by_row, MIN((ti, i)) AS at FROM linked WHERE j NOT IN (SELECT i FROM linked) GROUP BY 1),
joins AS (SELECT l.i, arg_min(l.j, (l.tj, l.j)) AS dest FROM linked l LEFT JOIN pulled p ON p.j = l.j WHERE p.j IS NULL OR p.at < (l.ti, l.i) GROUP BY 1),
ptr AS (SELECT al.row_id, al.t, x.i IS NOT NULL AS linked, CASE WHEN x.i IS NOT NULL THEN COALESCE(joins.dest, al.row_id) ELSE by_row END AS dest FROM al
  LEFT JOIN (SELECT DISTINCT i FROM linked) x ON x.i = al.row_id LEFT JOIN joins ON joins.i = al.row_id LEFT JOIN pulled ON pulled.j = al.row_id),
walk AS (SELECT row_id, dest FROM ptr WHERE dest IS NOT NULL UNION SELECT w.row_id, p.dest FROM walk w JOIN ptr p ON p.row_id = w.dest),
camp AS (SELECT w.row_id, w.dest AS campaign FROM walk w JOIN ptr p ON p.row_id = w.dest AND p.dest = p.row_id)"""


@query(
    "campaign_assign",
    with_attempts("SELECT ptr.row_id, linked, camp.campaign FROM ptr LEFT JOIN camp USING (row_id)", 1, LIVE).replace("WITH ", "WITH RECURSIVE ", 1),
)
def campaign_assign(spark, sf):
    """The campaign of every failed attempt, given in the order of the attempts."""
    return lc.assign(read_attempts(spark, sf).where("NOT success")).select("row_id", "linked", "campaign")


@query(
    "campaign_open",
    with_attempts(
        """SELECT campaign, MAX(CASE WHEN al.row_id = campaign THEN CASE WHEN asn IS NOT NULL THEN 'ASN ' || CAST(asn AS VARCHAR) ELSE 'IP ' || ip END END) AS label,
        MIN(al.t) FILTER (WHERE NOT linked AND dest = campaign) AS first_seen, MAX(al.t) FILTER (WHERE linked) AS last_seen, COUNT(*) AS alerts, COUNT(DISTINCT uid) + MAX(CASE WHEN uid IS NULL THEN 1 ELSE 0 END) AS accounts
        FROM camp JOIN ptr USING (row_id) JOIN al ON al.row_id = camp.row_id GROUP BY 1""", 1, LIVE).replace("WITH ", "WITH RECURSIVE ", 1),
)
def campaign_open(spark, sf):
    """The live campaigns of the failed attempts, as they stand at the end of the log."""
    alerts = read_attempts(spark, sf).where("NOT success")
    return lc.campaigns(alerts, lc.assign(alerts))


@query(
    "campaign_summary",
    with_attempts("SELECT campaign, COUNT(*) AS alerts, COUNT(DISTINCT uid) + MAX(CASE WHEN uid IS NULL THEN 1 ELSE 0 END) AS accounts, MIN(t) AS first_seen, MAX(t) AS last_seen FROM (SELECT *, ip AS campaign FROM attempts WHERE NOT success) GROUP BY 1"),
)
def campaign_summary(spark, sf):
    members = read_attempts(spark, sf).where("NOT success").withColumn("campaign", F.col("ip"))
    return cp.targeted_accounts(members)


@query(
    "campaign_list",
    with_attempts("SELECT campaign, COUNT(*) AS alerts, COUNT(DISTINCT uid) AS accounts FROM (SELECT * FROM comp JOIN nodes USING (row_id)) GROUP BY 1 HAVING COUNT(DISTINCT uid) >= 2 ORDER BY MAX(t) DESC, campaign LIMIT 10", 1, ATO, _components("(7)")).replace("WITH ", "WITH RECURSIVE ", 1),
)
def campaign_list(spark, sf):
    """First page of ten multi-account campaigns, newest first."""
    nodes = ato_nodes(spark, sf)
    members = cp.correlate(nodes, [7 * DAY]).join(nodes, "row_id")
    return al.page(cp.targeted_accounts(members).where("accounts >= 2"), [F.desc("last_seen"), F.col("campaign")], 1, 10).select("campaign", "alerts", "accounts")


@query(
    "campaign_graph",
    with_attempts(
        """SELECT DISTINCT campaign, username AS account, kind, value FROM (SELECT * FROM comp JOIN nodes USING (row_id)) m,
        LATERAL (SELECT * FROM (VALUES ('ip', m.ip), ('asn', CAST(m.asn AS VARCHAR)), ('device', m.device_type)) x(kind, value) WHERE value IS NOT NULL)""", 1, ATO, _components("(7)")).replace("WITH ", "WITH RECURSIVE ", 1),
)
def campaign_graph(spark, sf):
    nodes = ato_nodes(spark, sf)
    return cp.graph(cp.correlate(nodes, [7 * DAY]).join(nodes, "row_id"))


@query(
    "user_profile",
    with_attempts(
        """SELECT a.uid, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY t DESC, row_id DESC) FILTER (WHERE rn <= 50) AS attempts,
        COALESCE(string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY t DESC, row_id DESC) FILTER (WHERE is_attack_ip AND an <= 20), '') AS alerts,
        COUNT(DISTINCT CASE WHEN success THEN ua END) AS devices, COUNT(DISTINCT CASE WHEN success THEN country END) AS locations
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY uid ORDER BY t DESC, row_id DESC) AS rn, ROW_NUMBER() OVER (PARTITION BY uid, is_attack_ip ORDER BY t DESC, row_id DESC) AS an FROM attempts WHERE uid IS NOT NULL) a GROUP BY 1"""),
)
def user_profile(spark, sf):
    df = read_attempts(spark, sf)
    out = al.user_profile(df, df.where("is_attack_ip"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("uid", text("recent_attempts").alias("attempts"), text("recent_alerts").alias("alerts"), "devices", "locations")
