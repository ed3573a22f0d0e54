"""Curves, thresholds, overlap, ladders, drift, error slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import splits as sp
from ..plans import evaluate as ev
from ..plans import explain as ex
from ..plans import ladders as ld
from ..plans import quality as ql
from ..plans import tasks as tk
from ..plans.models import CANDIDATE_FLAGS, CANDIDATE_GE, CANDIDATE_ZERO, fit_rule_weights, materialize, youden
from ..plans.overlap import flagged
from ..plans.features import FEATURES, Options, compute_features
from ..sources.attempts import read_attempts
from .event_queries import ANCHORS, CUT, DAY, PART, POP, T0, USTATS, _SAME, weighted
from .feature_queries import ALL_CTES, FEATURES_CTE, rounded
from .fixture import with_attempts
from .registry import query
from .rule_queries import MARK, PACE, RELAX, STATE, d

# A stand-in score with ties, one task per time split and one over everything.
SCORE_SQL = "((row_id % 37) * 0.5::DOUBLE + CASE WHEN is_attack_ip THEN 5.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN success THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END)"
SCORES = f"""scores AS (SELECT row_id, 'all' AS task, is_attack_ip AS y, {SCORE_SQL} AS score, CASE WHEN is_attack_ip THEN 1 / 0.15::DOUBLE ELSE 1.0::DOUBLE END AS w, ip AS cluster, t, uid FROM attempts
  UNION ALL SELECT row_id, CASE WHEN t < {CUT.train_end} THEN 'train' WHEN t < {CUT.val_end} THEN 'val' WHEN t < {CUT.test_end} THEN 'test' ELSE 'late' END, is_attack_ip, {SCORE_SQL}, CASE WHEN is_attack_ip THEN 1 / 0.15::DOUBLE ELSE 1.0::DOUBLE END, ip, t, uid FROM attempts)"""
CURVE = """gr AS (SELECT task, score, SUM(CASE WHEN y THEN w ELSE 0 END) AS pos, SUM(CASE WHEN y THEN 0 ELSE w END) AS neg, COUNT(*) FILTER (WHERE y) AS np, COUNT(*) FILTER (WHERE NOT y) AS nn FROM scores GROUP BY 1, 2),
cv AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY task) AS allp, SUM(neg) OVER (PARTITION BY task) AS alln FROM gr WINDOW w AS (PARTITION BY task ORDER BY score DESC))"""


def score_rows(spark, sf) -> DataFrame:
    a = read_attempts(spark, sf)
    score = (F.col("row_id") % 37) * 0.5 + F.when(F.col("is_attack_ip"), 5.5).otherwise(0.0) + F.when(F.col("success"), 0.0).otherwise(1.5)
    tasks = F.explode(F.array(F.lit("all"), sp.time_split(F.col("t"), CUT)))
    return a.select(
        "row_id", tasks.alias("task"), F.col("is_attack_ip").alias("y"), score.alias("score"),
        F.when(F.col("is_attack_ip"), 1 / 0.15).otherwise(1.0).alias("w"), F.col("ip").alias("cluster"), "t", "uid")


def _metric(column: str, name: str):
    def run(spark, sf):
        return ev.metrics(score_rows(spark, sf)).select("task", F.round(column, 6).alias(name))

    return run


query("roc_auc", with_attempts("SELECT task, round(SUM(pos * (alln - fp + 0.5::DOUBLE * neg)) / MAX(allp * alln), 6) AS roc_auc FROM cv GROUP BY 1", 1, SCORES, CURVE))(_metric("roc_auc", "roc_auc"))
query("avg_precision", with_attempts("SELECT task, round(SUM(CASE WHEN pos > 0 THEN pos / allp * tp / (tp + fp) ELSE 0 END), 6) AS pr_auc FROM cv GROUP BY 1", 1, SCORES, CURVE))(_metric("pr_auc", "pr_auc"))
_STAR = "star AS (SELECT task, MAX(CASE WHEN nn > 0 AND fp > 0.01::DOUBLE * alln THEN score END) AS s FROM cv GROUP BY 1)"
query("recall_at_fpr", with_attempts("SELECT task, round(SUM(CASE WHEN score > s THEN pos ELSE 0 END) / MAX(allp), 6) AS recall FROM cv JOIN star USING (task) GROUP BY 1", 1, SCORES, CURVE, _STAR))(_metric("recall_0", "recall"))
query(
    "reauth_at_tpr",
    with_attempts("SELECT task, round(SUM(CASE WHEN score >= s THEN neg ELSE 0 END) / MAX(alln), 6) AS reauth FROM cv JOIN (SELECT task, MAX(CASE WHEN np > 0 AND tp / allp >= 0.9::DOUBLE - 1e-12::DOUBLE THEN score END) AS s FROM cv GROUP BY 1) USING (task) GROUP BY 1", 1, SCORES, CURVE),
)(_metric("reauth_0", "reauth"))


N_BOOT = 300


def draw_sql(source: str, n_boot: int, seed: int) -> str:
    """``source`` (with ``cluster``) once for each replicate, with ``rep`` and ``k`` as ``evaluate.poisson_one`` draws them."""
    steps = " + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in ev.poisson_cdf())
    return f"(SELECT *, {steps} AS k FROM (SELECT *, ('0x' || substr(md5(concat(cluster, ':', CAST(rep AS VARCHAR), ':{seed}')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM {source}, (SELECT unnest(range(1, {n_boot + 1})) AS rep)))"


def ratio_sql(names: list[str], n_boot: int = N_BOOT, seed: int = 0) -> str:
    """Value and interval of the weighted means of ``names`` over ``pv(cluster, w, ...)``."""
    per = f"(SELECT cluster, SUM(w) AS den, {', '.join(f'SUM(w * {n}) AS {n}' for n in names)} FROM pv GROUP BY 1)"
    reps = f"(SELECT rep, SUM(k * den) AS den, {', '.join(f'SUM(k * {n}) AS {n}' for n in names)} FROM {draw_sql(per, n_boot, seed)} GROUP BY 1 HAVING SUM(k * den) > 0)"
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, round((SELECT SUM(w * {n}) / SUM(w) FROM pv), 6) AS value, round(quantile_cont({n} / den, 0.025), 6) AS lo, round(quantile_cont({n} / den, 0.975), 6) AS hi FROM {reps}" for n in names)


def _values_sql(name: str, bonus: str) -> str:
    """Positives of the whole log with their share of negatives below and whether a threshold at 1 % catches them."""
    return f"""{name}s AS (SELECT row_id, y, w, cluster, score + CASE WHEN y THEN {bonus}::DOUBLE ELSE 0.0::DOUBLE END AS score FROM scores WHERE task = 'all'),
{name}g AS (SELECT score, SUM(CASE WHEN y THEN 0 ELSE w END) AS neg, COUNT(*) FILTER (WHERE NOT y) AS nn FROM {name}s GROUP BY 1),
{name}c AS (SELECT *, SUM(neg) OVER (ORDER BY score DESC) AS fp, SUM(neg) OVER () AS alln FROM {name}g),
{name} AS (SELECT row_id, cluster, w, (alln - fp + neg * 0.5::DOUBLE) / alln AS auc, CASE WHEN score > (SELECT MAX(score) FROM {name}c WHERE nn > 0 AND fp > 0.01::DOUBLE * alln) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rec FROM {name}s JOIN {name}c USING (score) WHERE y)"""


def _rounded_ci(out):
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi")])


@query("bootstrap_ci", with_attempts(ratio_sql(["roc_auc", "recall"]), 1, SCORES, _values_sql("va", "0.0"), "pv AS (SELECT cluster, w, auc AS roc_auc, rec AS recall FROM va)"))
def bootstrap_ci(spark, sf):
    """Intervals of AUC and recall on the whole log, resampling attack addresses."""
    pos = ev.positive_values(score_rows(spark, sf).where("task = 'all'"))
    return _rounded_ci(ev.bootstrap_ratio(pos, {"roc_auc": F.col("auc_part"), "recall": F.col("caught_0")}, F.col("w")))


@query(
    "paired_bootstrap",
    with_attempts(ratio_sql(["roc_auc_gain", "recall_gain"]), 1, SCORES, _values_sql("va", "0.0"), _values_sql("vb", "2.0"),
                  "pv AS (SELECT va.cluster, va.w, vb.auc - va.auc AS roc_auc_gain, vb.rec - va.rec AS recall_gain FROM va JOIN vb USING (row_id))"),
)
def paired_bootstrap(spark, sf):
    """Gain of a sharper score over the stand-in score on the same attack addresses."""
    a = score_rows(spark, sf).where("task = 'all'")
    b = a.withColumn("score", F.col("score") + F.when(F.col("y"), 2.0).otherwise(0.0))
    return _rounded_ci(ev.paired_bootstrap(a, b))


@query(
    "threshold_transfer",
    with_attempts(
        """SELECT b.task, MAX(a.s) AS threshold, round(SUM(CASE WHEN NOT b.y AND b.score > a.s THEN b.w ELSE 0 END) / SUM(CASE WHEN NOT b.y THEN b.w END), 6) AS fpr, round(SUM(CASE WHEN b.y AND b.score > a.s THEN b.w ELSE 0 END) / SUM(CASE WHEN b.y THEN b.w END), 6) AS recall
        FROM scores b, (SELECT s FROM star WHERE task = 'val') a WHERE b.task IN ('test', 'late') GROUP BY 1""", 1, SCORES, CURVE, _STAR),
)
def threshold_transfer(spark, sf):
    """The validation threshold applied to test and late."""
    rows = score_rows(spark, sf)
    chosen = ev.thresholds(rows.where("task = 'val'"), 0.01)
    targets = chosen.select(F.explode(F.array(F.lit("test"), F.lit("late"))).alias("task"), "threshold")
    out = ev.realized(rows.where("task IN ('test', 'late')"), targets)
    return out.select("task", "threshold", F.round("fpr", 6).alias("fpr"), F.round("recall", 6).alias("recall"))


# Shares of attacks among logins for which precision is stated.
PREVALENCES = {"1e4": 0.0001, "1e3": 0.001, "1e2": 0.01}


@query(
    "operating_points",
    with_attempts(
        f"""SELECT task, {", ".join(f"round(CASE WHEN r * {p}::DOUBLE + f * {1 - p}::DOUBLE > 0 THEN r * {p}::DOUBLE / (r * {p}::DOUBLE + f * {1 - p}::DOUBLE) ELSE 0 END, 6) AS precision_{n}" for n, p in PREVALENCES.items())} FROM
        (SELECT task, SUM(CASE WHEN score > s THEN pos ELSE 0 END) / MAX(allp) AS r, SUM(CASE WHEN score > s THEN neg ELSE 0 END) / MAX(alln) AS f FROM cv JOIN star USING (task) GROUP BY 1)""", 1, SCORES, CURVE, _STAR),
)
def operating_points(spark, sf):
    rows = score_rows(spark, sf)
    real = ev.realized(rows, ev.thresholds(rows, 0.01))
    return real.select("task", *[F.round(ev.precision_at(F.col("recall"), F.col("fpr"), p), 6).alias(f"precision_{n}") for n, p in PREVALENCES.items()])


@query(
    "alert_volume",
    with_attempts(
        f"""SELECT s.task, round(1000.0::DOUBLE * SUM(CASE WHEN score >= h THEN w ELSE 0 END) / SUM(w), 6) AS per_1000, round(SUM(CASE WHEN score >= h THEN w ELSE 0 END) / greatest((MAX(t) - MIN(t)) / {DAY}.0::DOUBLE, 1.0::DOUBLE), 6) AS per_day
        FROM scores s JOIN (SELECT task, MAX(CASE WHEN np > 0 AND tp / allp >= 0.9::DOUBLE - 1e-12::DOUBLE THEN score END) AS h FROM cv GROUP BY 1) USING (task) GROUP BY 1""", 1, SCORES, CURVE),
)
def alert_volume(spark, sf):
    from ..operators.joins import lookup

    rows = score_rows(spark, sf)
    cut = ev.curve(rows).groupBy(F.col("task").alias("_t")).agg(ev.threshold_for_recall(0.9).alias("h"))
    j = lookup(rows, cut, [("task", "_t")], how="inner", small=True)
    flagged = F.sum(F.when(F.col("score") >= F.col("h"), F.col("w")).otherwise(0.0))
    days = F.greatest((F.max("t") - F.min("t")) / F.lit(float(DAY)), F.lit(1.0))
    return j.groupBy("task").agg(F.round(F.lit(1000.0) * flagged / F.sum("w"), 6).alias("per_1000"), F.round(flagged / days, 6).alias("per_day"))


@query(
    "by_history",
    with_attempts(
        """SELECT bucket, COUNT(*) FILTER (WHERE y) AS n_pos, COUNT(*) FILTER (WHERE NOT y) AS n_neg, round(SUM(CASE WHEN y AND score > s THEN w ELSE 0 END) / SUM(CASE WHEN y THEN w END), 6) AS recall, round(SUM(CASE WHEN NOT y AND score > s THEN w ELSE 0 END) / SUM(CASE WHEN NOT y THEN w END), 6) AS false_alert_rate
        FROM (SELECT sc.*, CASE WHEN n < 1 THEN 'none' WHEN n < 5 THEN 'thin' ELSE 'thick' END AS bucket, st.s FROM scores sc JOIN star st USING (task)
          JOIN (SELECT row_id, COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM attempts WHERE uid IS NOT NULL) h USING (row_id) WHERE task = 'all') GROUP BY 1""", 1, SCORES, CURVE, _STAR),
)
def by_history(spark, sf):
    """Recall and false alerts by depth of history at one global threshold."""
    from ..operators.sweep import Count, sweep

    a = read_attempts(spark, sf).select("row_id", "t", "uid", "success")
    n = sweep(a, "uid", [Count("n", None, F.col("success"))], boundary="open").where("uid IS NOT NULL").select("row_id", "n")
    rows = score_rows(spark, sf).where("task = 'all'")
    cut = ev.thresholds(rows, 0.01).select(F.col("task").alias("_t"), F.col("threshold").alias("s"))
    j = rows.join(n, "row_id").join(F.broadcast(cut), F.col("task") == F.col("_t")).withColumn("bucket", sp.history_bucket(F.col("n")))
    y, w, flag = F.col("y"), F.col("w"), F.col("score") > F.col("s")
    return j.groupBy("bucket").agg(
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
        F.round(F.sum(F.when(y & flag, w).when(y, 0.0)) / F.sum(F.when(y, w)), 6).alias("recall"),
        F.round(F.sum(F.when(~y & flag, w).when(~y, 0.0)) / F.sum(F.when(~y, w)), 6).alias("false_alert_rate"))


@query("confusion", with_attempts("SELECT task, round(tp / NULLIF(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / NULLIF(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / NULLIF(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (SELECT task, COUNT(*) FILTER (WHERE y AND score > 15) AS tp, COUNT(*) FILTER (WHERE NOT y AND score > 15) AS fp, COUNT(*) FILTER (WHERE y AND score <= 15) AS fn FROM scores GROUP BY 1)", 1, SCORES))
def confusion(spark, sf):
    y, flag = F.col("y"), F.col("score") > 15
    c = score_rows(spark, sf).groupBy("task").agg(F.count_if(y & flag).alias("tp"), F.count_if(~y & flag).alias("fp"), F.count_if(y & ~flag).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("task", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp * 2, tp * 2 + fp + fn).alias("f1"))


@query(
    "tail_hybrid",
    with_attempts(
        """SELECT row_id, round(0.0::DOUBLE - log10(least(ta, tb)), 6) + 0.0::DOUBLE AS hybrid, CASE WHEN ta <= tb THEN 'a' ELSE 'b' END AS triggered_by FROM (
        SELECT p.row_id, greatest((SELECT COALESCE(SUM(w), 0) FROM negs n WHERE n.a >= p.a) / tot, 1e-7::DOUBLE) AS ta, CASE WHEN p.success THEN greatest((SELECT COALESCE(SUM(w), 0) FROM negs n WHERE n.b >= p.b) / tot, 1e-7::DOUBLE) ELSE 1.0::DOUBLE END AS tb
        FROM comps p, (SELECT SUM(w) AS tot FROM negs))""", 1,
        f"""comps AS (SELECT row_id, success, is_attack_ip, {SCORE_SQL} AS a, CAST((row_id * 7) % 41 AS DOUBLE) AS b, 1.0::DOUBLE AS w FROM attempts)""",
        "negs AS (SELECT a, b, SUM(w) AS w FROM comps WHERE NOT is_attack_ip GROUP BY 1, 2)"),
)
def tail_hybrid(spark, sf):
    """Rarest of two component scores against the normal logins; b only speaks on successes."""
    a = read_attempts(spark, sf)
    s = (F.col("row_id") % 37) * 0.5 + F.when(F.col("is_attack_ip"), 5.5).otherwise(0.0) + F.when(F.col("success"), 0.0).otherwise(1.5)
    comps = a.select("row_id", "success", "is_attack_ip", s.alias("a"), ((F.col("row_id") * 7) % 41).cast("double").alias("b"), F.lit(1.0).alias("w"))
    out = ev.min_tail(ev.tails(comps.where("NOT is_attack_ip"), comps, ["a", "b"], gates={"b": F.col("success")}), ["a", "b"])
    return out.select("row_id", (F.round("hybrid", 6) + F.lit(0.0)).alias("hybrid"), "triggered_by")


_P = "least(1.0::DOUBLE, ((row_id % 37) + CASE WHEN is_attack_ip THEN 20 ELSE 0 END) / 60.0::DOUBLE)"


def prob_rows(spark, sf):
    p = F.least(F.lit(1.0), ((F.col("row_id") % 37) + F.when(F.col("is_attack_ip"), 20).otherwise(0)) / F.lit(60.0))
    return read_attempts(spark, sf).select("row_id", p.alias("p"), F.col("is_attack_ip").alias("y"), F.when(F.col("is_attack_ip"), 1 / 0.15).otherwise(1.0).alias("w"))


PROBS = f"probs AS (SELECT row_id, {_P} AS p, is_attack_ip AS y, CASE WHEN is_attack_ip THEN 1 / 0.15::DOUBLE ELSE 1.0::DOUBLE END AS w FROM attempts)"


@query(
    "reliability",
    with_attempts(
        """SELECT CAST(i AS INT) AS bin, round(SUM(p * w) / SUM(w), 6) AS predicted, round(SUM(CASE WHEN y THEN w ELSE 0 END) / SUM(w), 6) AS observed, round(SUM(w) / (SELECT SUM(w) FROM probs), 6) AS weight_share
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p, row_id) - 1 AS r, COUNT(*) OVER () AS n FROM probs) JOIN range(10) x(i) ON r >= (n * i) // 10 AND r < (n * (i + 1)) // 10 GROUP BY 1""", 1, PROBS),
)
def reliability(spark, sf):
    out = ev.reliability(prob_rows(spark, sf))
    return out.select("bin", *[F.round(c, 6).alias(c) for c in ("predicted", "observed", "weight_share")])


@query("brier", with_attempts("SELECT round(SUM(w * (p - CASE WHEN y THEN 1 ELSE 0 END) * (p - CASE WHEN y THEN 1 ELSE 0 END)) / SUM(w), 6) AS brier FROM probs", 1, PROBS))
def brier(spark, sf):
    return ev.brier(prob_rows(spark, sf)).select(F.round("brier", 6).alias("brier"))


@query("report_matrix", with_attempts("SELECT 'stand_in' AS model, MAX(CASE WHEN task = 'val' THEN v END) AS val, MAX(CASE WHEN task = 'test' THEN v END) AS test, MAX(CASE WHEN task = 'late' THEN v END) AS late FROM (SELECT task, round(SUM(pos * (alln - fp + 0.5::DOUBLE * neg)) / MAX(allp * alln), 6) AS v FROM cv GROUP BY 1)", 1, SCORES, CURVE))
def report_matrix(spark, sf):
    m = ev.metrics(score_rows(spark, sf)).withColumn("model", F.lit("stand_in"))
    return m.groupBy("model").pivot("task", ["val", "test", "late"]).agg(F.round(F.first("roc_auc"), 6))


@query(
    "calibrate_bands",
    with_attempts(
        """SELECT CAST(a AS INT) AS alert_at, CAST(greatest(a + 1, b) AS INT) AS step_up_at, CAST(greatest(greatest(a + 1, b) + 1, c) AS INT) AS lock_at FROM
        (SELECT ceil(MAX(CASE WHEN nn > 0 AND fp > 0.1::DOUBLE * alln THEN score END)) AS a, ceil(MAX(CASE WHEN nn > 0 AND fp > 0.01::DOUBLE * alln THEN score END)) AS b, ceil(MAX(CASE WHEN nn > 0 AND fp > 0.001::DOUBLE * alln THEN score END)) AS c FROM cv WHERE task = 'val')""", 1, SCORES, CURVE),
)
def calibrate_bands(spark, sf):
    """Three action thresholds from three false-positive targets on validation."""
    c = ev.curve(score_rows(spark, sf).where("task = 'val'"))
    row = c.agg(*[ev.exceeding(f).alias(f"c{i}") for i, f in enumerate((0.1, 0.01, 0.001))])
    a = F.ceil("c0")
    b = F.greatest(a + 1, F.ceil("c1"))
    return row.select(a.cast("int").alias("alert_at"), b.cast("int").alias("step_up_at"), F.greatest(b + 1, F.ceil("c2")).cast("int").alias("lock_at"))


# -------------------------------------------------------------- rule ladders

_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_SEEN = "COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY uid, {} ORDER BY t, row_id " + _PRIOR + "), 0)"
_KNOWN = "success AND uid IS NOT NULL AND asn IS NOT NULL"
MULTI = {s: f"mc{s}" for (s,) in next(x.values for x in ld.LADDERS if x.rule_id == "multi_context_simultaneous")}
DEEP = f"""sx AS (SELECT *, {", ".join(f"{d('country', 'success', 'uid', s)} AS {c}" for s, c in MULTI.items())},
  MAX(CASE WHEN success THEN t END) OVER (PARTITION BY uid ORDER BY t, row_id {_PRIOR}) AS last_ok,
  (country IS NOT NULL AND {_SEEN.format('country')} = 0) OR (ua IS NOT NULL AND {_SEEN.format('ua')} = 0) AS changed,
  COALESCE(SUM(CASE WHEN {_KNOWN} THEN 1 ELSE 0 END) OVER (ORDER BY t, row_id {_PRIOR}), 0) AS all_ok,
  COALESCE(SUM(CASE WHEN {_KNOWN} THEN 1 ELSE 0 END) OVER (PARTITION BY asn ORDER BY t, row_id {_PRIOR}), 0) AS asn_ok FROM st)"""
# ladder -> the condition of a rung over the state, by the rung's values
RUNG_SQL = {
    "brute_force": "NOT success AND fu5 >= {0}",
    "credential_stuffing/ip": f"NOT success AND fp5 >= {{0}} * {RELAX} AND up5 >= {{1}} * {RELAX} AND op5 <= 0.5::DOUBLE * (op5 + fp5)",
    "credential_stuffing/asn": "NOT success AND asn IS NOT NULL AND fa5 >= {0} AND ua5 >= {1} AND oa5 <= 0.5::DOUBLE * (oa5 + fa5)",
    "password_spray_slow/ip": "NOT success AND up24 >= {0} AND fp24 <= 3.0::DOUBLE * up24 AND fp60 <= 120",
    "password_spray_slow/asn": "NOT success AND asn IS NOT NULL AND ua24 >= {0} AND fa24 <= 3.0::DOUBLE * ua24 AND fa60 <= 600",
    "distributed_bruteforce": "NOT success AND fu60 >= {0} AND fi60 >= {1}",
    "success_after_failures": "success AND uid IS NOT NULL AND fu10 >= {0}",
    "ua_rotation": "NOT success AND ua IS NOT NULL AND fp10 >= {0} AND ap10 >= {1}",
    "dormant_account_login": f"success AND uid IS NOT NULL AND (t - last_ok) / {DAY}.0::DOUBLE >= {{0}} AND changed",
    "rare_network_login": f"{_KNOWN} AND all_ok >= 20000 AND CAST(asn_ok AS DOUBLE) / all_ok <= {{0}}::DOUBLE",
    "multi_context_simultaneous": "success AND uid IS NOT NULL AND country IS NOT NULL AND mc{0} >= 2",
    "country_hop": "country IS NOT NULL AND cc24 >= {0}",
    "bot_user_agent": "device_type = 'bot'",
    "scripted_client": f"({MARK}) IS NOT NULL",
}


def _level_sql(x) -> str:
    steps = " ".join(f"WHEN NOT COALESCE({RUNG_SQL[x.name].format(*v)}, FALSE) THEN {i}" for i, v in enumerate(x.values))
    return f"CAST(CASE {steps} ELSE {len(x.values)} END AS INT) AS {x.column}"


LEVELS = f"{DEEP}, lv AS (SELECT row_id, ip, {', '.join(map(_level_sql, ld.LADDERS))} FROM sx)"
#: The rung at which rules are weighed: the third, or the last of a shorter ladder.
AT_RUNG = {x.name: min(3, len(x.values)) for x in ld.LADDERS}


@query("rule_levels", with_attempts(f"SELECT row_id, {', '.join(x.column for x in ld.LADDERS)} FROM lv", PACE, STATE, LEVELS))
def rule_levels(spark, sf):
    """How deep every attempt reaches on all fourteen ladders."""
    return ld.rule_levels(read_attempts(spark, sf, PACE))


LFACTS = f"""lf AS (SELECT row_id, success, is_attack_ip, CASE WHEN t < {T0 + 1_200_000_000} THEN 'train' WHEN t < {T0 + 2_400_000_000} THEN 'val' ELSE 'test' END AS part, CASE WHEN is_attack_ip THEN 1 / 0.15::DOUBLE ELSE 1.0::DOUBLE END AS w FROM attempts)"""
LMETRICS = "lx AS (" + " UNION ALL ".join(f"SELECT '{x.name}' AS ladder, r.i AS rung, part, success, is_attack_ip, w, {x.column} >= r.i AS fired FROM lv JOIN lf USING (row_id), range(1, {len(x.values) + 1}) r(i)" for x in ld.LADDERS) + """),
lm AS (SELECT ladder, CAST(rung AS INT) AS rung, part, round(SUM(CASE WHEN fired AND NOT is_attack_ip THEN w ELSE 0 END) / SUM(CASE WHEN NOT is_attack_ip AND success THEN w ELSE 0 END) * 10000, 6) AS fa10k, round(SUM(CASE WHEN fired AND is_attack_ip THEN w ELSE 0 END) / SUM(CASE WHEN is_attack_ip THEN w ELSE 0 END), 6) AS recall FROM lx GROUP BY 1, 2, 3)"""


def ladder_table(spark, sf):
    a = read_attempts(spark, sf, PACE)
    part = F.when(F.col("t") < T0 + 1_200_000_000, "train").when(F.col("t") < T0 + 2_400_000_000, "val").otherwise("test")
    facts = a.select("row_id", part.alias("part"), "success", "is_attack_ip", F.when(F.col("is_attack_ip"), 1 / 0.15).otherwise(1.0).alias("w"))
    return ld.ladder_metrics(materialize(ld.rule_levels(a)), facts)


@query("ladder_metrics", with_attempts("SELECT * FROM lm", PACE, STATE, LEVELS, LFACTS, LMETRICS))
def ladder_metrics(spark, sf):
    return ladder_table(spark, sf)


@query("ladder_select", with_attempts("SELECT ladder, MIN(rung) AS rung FROM (SELECT ladder, rung, MAX(fa10k) AS worst FROM lm WHERE part IN ('train', 'val') GROUP BY 1, 2) WHERE worst <= 2000 GROUP BY 1", PACE, STATE, LEVELS, LFACTS, LMETRICS))
def ladder_select(spark, sf):
    return ld.select_rungs(ladder_table(spark, sf), 2000.0, ["train", "val"])


def scored_levels(spark, sf):
    """The stand-in score of every attempt, and its levels on all ladders."""
    a = read_attempts(spark, sf, PACE)
    score = (F.col("row_id") % 37) * 0.5 + F.when(F.col("is_attack_ip"), 5.5).otherwise(0.0) + F.when(F.col("success"), 0.0).otherwise(1.5)
    facts = a.select("row_id", "ip", F.lit("all").alias("task"), F.col("is_attack_ip").alias("y"), score.alias("score"), F.when(F.col("is_attack_ip"), 1 / 0.15).otherwise(1.0).alias("w"))
    return facts, ld.rule_levels(a)


OVERLAP = f"ov AS (SELECT a.row_id, is_attack_ip AS y, {SCORE_SQL} AS score, CASE WHEN is_attack_ip THEN 1 / 0.15::DOUBLE ELSE 1.0::DOUBLE END AS w, {', '.join(f'{x.column} >= {AT_RUNG[x.name]} AS f{i}' for i, x in enumerate(ld.LADDERS))}, {' OR '.join(f'{x.column} >= {AT_RUNG[x.name]}' for x in ld.LADDERS)} AS rule FROM attempts a LEFT JOIN lv USING (row_id))"


@query(
    "rule_overlap",
    with_attempts(
        """SELECT y, round(SUM(CASE WHEN score > 15 AND rule THEN w ELSE 0 END) / SUM(w), 6) AS both, round(SUM(CASE WHEN score > 15 AND NOT rule THEN w ELSE 0 END) / SUM(w), 6) AS model_only,
        round(SUM(CASE WHEN score <= 15 AND rule THEN w ELSE 0 END) / SUM(w), 6) AS rule_only, round(SUM(CASE WHEN score <= 15 AND NOT rule THEN w ELSE 0 END) / SUM(w), 6) AS neither FROM ov GROUP BY 1""", PACE, STATE, LEVELS, OVERLAP),
)
def rule_overlap(spark, sf):
    m, r, w = F.col("score") > 15, F.col("rule"), F.col("w")
    share = lambda c: F.round(F.sum(F.when(c, w).otherwise(0.0)) / F.sum(w), 6)
    facts, levels = scored_levels(spark, sf)
    return flagged(facts, levels, {"all": AT_RUNG}).groupBy("y").agg(share(m & r).alias("both"), share(m & ~r).alias("model_only"), share(~m & r).alias("rule_only"), share(~m & ~r).alias("neither"))


@query("rule_weights", with_attempts(" UNION ALL ".join(f"SELECT '{x.name}' AS ladder, COUNT(*) FILTER (WHERE f{i}) AS fired, round(COALESCE(SUM(CASE WHEN f{i} AND y THEN w WHEN f{i} THEN 0 END) / SUM(CASE WHEN f{i} THEN w END), 0.05::DOUBLE), 6) AS weight FROM ov" for i, x in enumerate(ld.LADDERS)), PACE, STATE, LEVELS, OVERLAP))
def rule_weights(spark, sf):
    """Weighted precision per ladder; the default weight where it never fires."""
    return ld.weights(*scored_levels(spark, sf), AT_RUNG).withColumn("weight", F.round("weight", 6))


# --------------------------------------------------- features in the evaluation

FROWS = f"fr AS (SELECT f.*, p.part, p.pop_weight, p.success, p.is_attack_ip, p.is_ato, p.uid, p.t FROM feats f JOIN pop p USING (row_id))"
EVAL_CTES = (*ALL_CTES, FEATURES_CTE, PART, USTATS, POP, FROWS)


def feature_rows(spark, sf, *, stored: bool = False, **limits):
    """Features with partition, weights and labels of known accounts.

    ``stored`` writes them once to the checkpoint folder, for queries that read them
    several times; ``limits`` (``only``, ``until``) are those of ``compute_features``.
    """
    a = read_attempts(spark, sf)
    facts = weighted(spark, sf).select("row_id", F.col("partition").alias("part"), "pop_weight", "success", "is_attack_ip", "is_ato", "uid", "t")
    out = compute_features(a, **limits).join(facts, "row_id")
    return materialize(out) if stored else out


LEGIT = "success AND NOT is_attack_ip AND NOT is_ato"


_HISTORY = "(SELECT row_id FROM hist WHERE n >= 1)"


def _attacker_sql(prefix: str, part: str, start: int, end: int, kind: str) -> str:
    made = f"SELECT a.row_id, TRUE AS y, 1.0::DOUBLE AS w FROM anchors a WHERE a.t >= {start} AND a.t < {end} AND EXISTS (SELECT 1 FROM donors x WHERE {_SAME[kind]} AND x.uid <> a.uid AND x.t > a.t AND x.t <= a.t + {DAY} AND x.t < {end})"
    return f"SELECT '{prefix}/{kind}' AS task, COUNT(*) FILTER (WHERE y) AS n_pos, COUNT(*) FILTER (WHERE NOT y) AS n_neg, round(SUM(w), 6) AS weight FROM (SELECT row_id, FALSE AS y, pop_weight AS w FROM pop WHERE part = '{part}' AND {LEGIT} AND row_id IN {_HISTORY} UNION ALL {made})"


@query(
    "eval_tasks",
    with_attempts(
        f"""SELECT 'attack_ip/' || part AS task, COUNT(*) FILTER (WHERE is_attack_ip) AS n_pos, COUNT(*) FILTER (WHERE NOT is_attack_ip) AS n_neg, round(SUM(pop_weight), 6) AS weight FROM pop WHERE part IN ('val', 'test', 'late') GROUP BY 1
        UNION ALL SELECT 'ato/future', COUNT(*) FILTER (WHERE is_ato), COUNT(*) FILTER (WHERE NOT is_ato), round(SUM(pop_weight), 6) FROM pop WHERE (part = 'test' AND {LEGIT}) OR (is_ato AND t >= {CUT.val_end} AND t < {CUT.test_end})
        UNION ALL SELECT 'ato/all', COUNT(*) FILTER (WHERE is_ato), COUNT(*) FILTER (WHERE NOT is_ato), round(SUM(pop_weight), 6) FROM pop WHERE (part IN ('train', 'val', 'test') AND {LEGIT}) OR is_ato
        UNION ALL """ + " UNION ALL ".join(_attacker_sql(*x, k) for x in (("attacker", "test", CUT.val_end, CUT.test_end), ("attacker_val", "val", CUT.train_end, CUT.val_end)) for k in _SAME), 1, PART, USTATS, POP, ANCHORS),
)
def eval_tasks(spark, sf):
    """All eleven labelled sets, from one long frame."""
    out = tk.summary(tk.build(weighted(spark, sf), read_attempts(spark, sf), CUT))
    return out.withColumn("weight", F.round("weight", 6))


_FS = "CASE WHEN u_n_success < 1 THEN 'new_account' WHEN new_country = 1 OR new_asn = 1 THEN 'new_country_or_network' WHEN ip_distinct_users_24h >= 5 OR COALESCE(ip_fail_ratio_24h, 0) >= 0.5 THEN 'unusual_ip_activity' WHEN new_ua = 1 AND (new_browser = 1 OR new_os = 1 OR new_device = 1) THEN 'new_device_or_browser' WHEN new_ip = 1 AND COALESCE(u_secs_since_last_success, 1e300) > 2592000 THEN 'new_ip_after_long_gap' ELSE 'other' END"


@query(
    "fa_archetype",
    with_attempts(
        f"""SELECT kind, COUNT(*) AS n, round(SUM(pop_weight) / (SELECT SUM(pop_weight) FROM fr WHERE part = 'test' AND {LEGIT}), 6) AS login_share, round(SUM(CASE WHEN rare_ip > 3 THEN pop_weight ELSE 0 END) / SUM(pop_weight), 6) AS flagged_rate FROM (SELECT *, {_FS} AS kind FROM fr WHERE part = 'test' AND {LEGIT}) GROUP BY 1""", 1, *EVAL_CTES),
)
def fa_archetype(spark, sf):
    """Kinds of legitimate logins and how often a rarity threshold flags them."""
    df = feature_rows(spark, sf).where(f"part = 'test' AND {LEGIT}")
    cols = {c: F.col(c) for c in FEATURES}
    w = F.col("pop_weight")
    g = df.groupBy(sp.archetype(cols).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(F.when(F.round("rare_ip", 6) > 3, w).otherwise(0.0)).alias("_f"))
    tot = g.agg(F.sum("_w").alias("_all"))
    return g.join(F.broadcast(tot)).select("kind", "n", F.round(F.col("_w") / F.col("_all"), 6).alias("login_share"), F.round(F.col("_f") / F.col("_w"), 6).alias("flagged_rate"))


_GAP = "CASE WHEN g < 60 THEN 'under 1 min' WHEN g < 600 THEN '1-10 min' WHEN g < 3600 THEN '10-60 min' WHEN g < 86400 THEN '1-24 h' WHEN g < 604800 THEN '1-7 d' WHEN g < 2592000 THEN '7-30 d' ELSE 'over 30 d' END"


@query(
    "new_ip_by_gap",
    with_attempts(f"SELECT {_GAP} AS gap, COUNT(*) AS n, round(SUM(CASE WHEN new_ip = 1 THEN pop_weight ELSE 0 END) / SUM(pop_weight), 6) AS new_ip_share FROM (SELECT *, u_secs_since_last_success AS g FROM fr WHERE part = 'test' AND {LEGIT} AND u_n_success >= 1) GROUP BY 1", 1, *EVAL_CTES),
)
def new_ip_by_gap(spark, sf):
    df = feature_rows(spark, sf).where(f"part = 'test' AND {LEGIT} AND u_n_success >= 1")
    w = F.col("pop_weight")
    return df.groupBy(sp.gap_bucket(F.col("u_secs_since_last_success")).alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("new_ip") == 1, w).otherwise(0.0)) / F.sum(w), 6).alias("new_ip_share"))


_DRIFT = FEATURES


@query("typical_values", with_attempts(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(COALESCE(quantile_cont({c}, 0.5), 0), 6) AS typical FROM fr WHERE {LEGIT}" for c in _DRIFT), 1, *EVAL_CTES))
def typical_values(spark, sf):
    df = rounded(feature_rows(spark, sf, stored=True).where(LEGIT))
    return ex.typical_values(df, _DRIFT).select("feature", F.round("typical", 6).alias("typical"))


_EDGES = "list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))"
PSI_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CASE WHEN ne < 3 THEN CASE WHEN rmin = cmin AND rmax = cmax THEN 0.0::DOUBLE END ELSE round(p, 6) + 0.0::DOUBLE END AS psi, n_reference, n_current, n_current < 30 AS low_confidence FROM (
    SELECT SUM((cs - rs) * ln(cs / rs)) AS p, MAX(rt) AS n_reference, MAX(ct) AS n_current, MAX(ne) AS ne, MAX(rmin) AS rmin, MAX(rmax) AS rmax, MAX(cmin) AS cmin, MAX(cmax) AS cmax FROM (
      SELECT greatest(r / rt, 1e-4::DOUBLE) AS rs, greatest(c / ct, 1e-4::DOUBLE) AS cs, rt, ct, ne, rmin, rmax, cmin, cmax FROM (
        SELECT b, COUNT(*) FILTER (WHERE ref)::DOUBLE AS r, COUNT(*) FILTER (WHERE NOT ref)::DOUBLE AS c, MAX(rt) AS rt, MAX(ct) AS ct, MAX(ne) AS ne, MAX(rmin) AS rmin, MAX(rmax) AS rmax, MAX(cmin) AS cmin, MAX(cmax) AS cmax FROM (
          SELECT part = 'train' AS ref, len(list_filter(e[2:len(e) - 1], lambda x: x <= {c})) AS b, len(e) AS ne, COUNT(*) FILTER (WHERE part = 'train') OVER () AS rt, COUNT(*) FILTER (WHERE part <> 'train') OVER () AS ct,
            MIN({c}) FILTER (WHERE part = 'train') OVER () AS rmin, MAX({c}) FILTER (WHERE part = 'train') OVER () AS rmax, MIN({c}) FILTER (WHERE part <> 'train') OVER () AS cmin, MAX({c}) FILTER (WHERE part <> 'train') OVER () AS cmax
          FROM fr, (SELECT {_EDGES.format(c=c)} AS e FROM fr WHERE part = 'train' AND {c} IS NOT NULL) WHERE part IN ('train', 'test') AND {c} IS NOT NULL) GROUP BY b)))"""
    for c in _DRIFT
)


@query("psi_drift", with_attempts(PSI_SQL, 1, *EVAL_CTES))
def psi_drift(spark, sf):
    """Drift of test against train for several features."""
    df = rounded(feature_rows(spark, sf, stored=True)).select("part", *_DRIFT)
    out = ev.psi(df.where("part = 'train'"), df.where("part = 'test'"), _DRIFT)
    return out.select("feature", (F.round("psi", 6) + F.lit(0.0)).alias("psi"), "n_reference", "n_current", "low_confidence")


_CUTS = "[0.5, 0.75, 0.9, 0.95, 0.99]"


def _youden_sql(feature: str, cuts: str, meets: str) -> str:
    rate = lambda side: f"SUM(CASE WHEN {side} AND COALESCE({feature} {meets} cut, FALSE) THEN pop_weight ELSE 0 END) / SUM(CASE WHEN {side} THEN pop_weight END)"
    return f"SELECT '{feature}' AS feature, cut + 0.0::DOUBLE AS threshold, round(j, 6) AS youden FROM (SELECT cut, j, ROW_NUMBER() OVER (ORDER BY j DESC, cut) AS place FROM (SELECT cut, round({rate('is_attack_ip')} - {rate('NOT is_attack_ip')}, 9) AS j FROM trn, ({cuts}) GROUP BY cut)) WHERE place = 1"


YOUDEN_SQL = " UNION ALL ".join(
    [_youden_sql(c, "SELECT 1.0::DOUBLE AS cut", "=") for c in CANDIDATE_FLAGS] + [_youden_sql(c, "SELECT 0.0::DOUBLE AS cut", "=") for c in CANDIDATE_ZERO]
    + [_youden_sql(c, f"SELECT DISTINCT unnest(quantile_cont(CAST({c} AS DOUBLE), {_CUTS})) AS cut FROM trn", ">=") for c in CANDIDATE_GE]
)


def train_rows(spark, sf):
    """Labels, weights and candidate features of the train rows; their history is the whole log."""
    candidates = [*CANDIDATE_FLAGS, *CANDIDATE_ZERO, *CANDIDATE_GE]
    rows = rounded(feature_rows(spark, sf, only=candidates, until=CUT.train_end)).where("part = 'train'")
    return materialize(rows.select(F.col("is_attack_ip").alias("y"), F.col("pop_weight").alias("w"), *candidates))


@query("youden_rules", with_attempts(f"SELECT feature, round(threshold, 6) AS threshold, youden FROM ({YOUDEN_SQL})", 1, *EVAL_CTES, "trn AS (SELECT * FROM fr WHERE part = 'train')"))
def youden_rules(spark, sf):
    """Best threshold by TPR - FPR on train for all eighteen candidates."""
    return youden(train_rows(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@query("tuned_rules")
def tuned_rules(spark, sf):
    """The candidates at their best thresholds, with the logistic weight of each."""
    rows = train_rows(spark, sf)
    rules = sorted((r.feature, r.threshold) for r in youden(rows).collect())  # a row per candidate
    fitted = fit_rule_weights(rows, rules)
    return spark.createDataFrame([(c, float(t), float(w)) for (c, t), w in zip(rules, fitted.coefficients, strict=True)], "feature string, threshold double, weight double")
