"""Single-feature cuts, segments, attribution, limits, bootstrap choices between feature groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import splits as sp
from ..plans import errors as er
from ..plans import evaluate as ev
from ..plans import selection as sel
from ..plans import tasks as tk
from ..plans.features import FEATURES, FREEMAN_ATTRS, NOVELTY_ATTRS
from .evaluation_queries import CUT, EVAL_CTES, LEGIT, draw_sql, feature_rows
from .fixture import with_attempts
from .registry import query

LEVELS = (0.01, 0.001)
_BUCKET = "CASE WHEN u_n_success < 1 THEN 'none' WHEN u_n_success < 5 THEN 'thin' ELSE 'thick' END"
# The observed task sets over the feature rows.
TASKED = f"""tasked AS (SELECT 'attack_ip/' || part AS task, is_attack_ip AS y, ip_ AS cluster, fr2.* FROM fr2 WHERE part IN ('val', 'test', 'late')
  UNION ALL SELECT 'ato/future', is_ato, CAST(uid AS VARCHAR), fr2.* FROM fr2 WHERE (part = 'test' AND {LEGIT}) OR (is_ato AND t >= {CUT.val_end} AND t < {CUT.test_end})
  UNION ALL SELECT 'ato/all', is_ato, CAST(uid AS VARCHAR), fr2.* FROM fr2 WHERE (part IN ('train', 'val', 'test') AND {LEGIT}) OR is_ato)"""
FR2 = "fr2 AS (SELECT fr.*, p.ip AS ip_ FROM fr JOIN pop p USING (row_id))"


def tasked(spark, sf):
    """Feature rows of every observed task set, stored once."""
    from ..sources.attempts import read_attempts

    rows = feature_rows(spark, sf, stored=True)
    facts = rows.select("row_id", "t", "uid", F.col("part").alias("partition"), "pop_weight", "success", "is_attack_ip", "is_ato").join(read_attempts(spark, sf).select("row_id", "ip"), "row_id")
    sets = tk.observed(facts, CUT)
    return rows, sets.join(rows.drop("t", "uid"), "row_id")


def _digits(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6)"


SINGLE = f"""vals AS (SELECT task, y, pop_weight AS w, {_BUCKET} AS bucket, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS feature, unnest([{', '.join(_digits(c) for c in FEATURES)}]) AS value FROM tasked),
hs AS (SELECT task, feature, value, SUM(CASE WHEN y THEN w ELSE 0 END) AS pos, SUM(CASE WHEN y THEN 0 ELSE w END) AS neg, COUNT(*) FILTER (WHERE y) AS np, COUNT(*) FILTER (WHERE NOT y) AS nn, {', '.join(f"SUM(CASE WHEN y AND bucket = '{b}' THEN w ELSE 0 END) AS pos_{b}" for b in er.BUCKETS)} FROM vals GROUP BY 1, 2, 3),
tt AS (SELECT task, feature, SUM(pos) AS allp, SUM(neg) AS alln, CAST(SUM(np) AS BIGINT) AS n_pos, CAST(SUM(nn) AS BIGINT) AS n_neg, SUM(CASE WHEN value IS NULL THEN pos ELSE 0 END) AS lostp, SUM(CASE WHEN value IS NULL THEN neg ELSE 0 END) AS lostn, {', '.join(f"SUM(pos_{b}) AS all_{b}" for b in er.BUCKETS)} FROM hs GROUP BY 1, 2),
hc AS (SELECT hs.*, SUM(neg) OVER (PARTITION BY task, feature ORDER BY value DESC) AS fp, SUM(neg) OVER (PARTITION BY task, feature ORDER BY value) AS fl FROM hs WHERE value IS NOT NULL),
auc AS (SELECT task, feature, (COALESCE(SUM(pos * (alln - fp + 0.5::DOUBLE * neg)), 0) + ANY_VALUE(lostp * lostn) * 0.5::DOUBLE) / ANY_VALUE(CASE WHEN allp * alln > 0 THEN allp * alln END) AS a FROM tt LEFT JOIN hc USING (task, feature) GROUP BY 1, 2),
ct AS (SELECT task, feature, level, MAX(CASE WHEN nn > 0 AND fp > level * alln THEN value END) AS hi, MIN(CASE WHEN nn > 0 AND fl > level * alln THEN value END) AS lo FROM tt LEFT JOIN hc USING (task, feature), (VALUES {', '.join(f"({x}::DOUBLE)" for x in LEVELS)}) l(level) GROUP BY 1, 2, 3),
sd AS (SELECT task, feature, level, side, CASE WHEN side = 'high' THEN hi ELSE lo END AS cut, value, pos, neg, {', '.join(f"pos_{b}" for b in er.BUCKETS)}, CASE WHEN side = 'high' THEN hi IS NULL OR value > hi ELSE lo IS NULL OR value < lo END AS hit FROM ct LEFT JOIN hc USING (task, feature), (VALUES ('high'), ('low')) s(side)),
rs AS (SELECT task, feature, level, side, ANY_VALUE(cut) AS cut, {', '.join(f"SUM(CASE WHEN hit THEN COALESCE({x}, 0) ELSE 0 END) AS {x}" for x in ("pos", "neg", *[f"pos_{b}" for b in er.BUCKETS]))} FROM sd GROUP BY 1, 2, 3, 4),
rr AS (SELECT rs.*, n_pos, n_neg, a, allp, alln, {', '.join(f"all_{b}" for b in er.BUCKETS)}, ROW_NUMBER() OVER (PARTITION BY task, feature, level ORDER BY round(pos / allp, 9) DESC, side) AS rk FROM rs JOIN tt USING (task, feature) JOIN auc USING (task, feature))"""


@query(
    "single_feature_cuts",
    with_attempts(
        f"""SELECT task, feature, n_pos, n_neg, round(a, 6) AS roc_auc, level, side, round(cut, 6) AS cut, round(pos / allp, 6) AS recall, round(neg / alln, 6) AS fpr, {', '.join(f"round(CASE WHEN all_{b} > 0 THEN pos_{b} / all_{b} END, 6) AS recall_{b}" for b in er.BUCKETS)} FROM rr WHERE rk = 1""", 1, *EVAL_CTES, FR2, TASKED, SINGLE),
)
def single_feature_cuts(spark, sf):
    """Every feature alone as a score: its best cut at two false positive levels, on every observed task set."""
    _, rows = tasked(spark, sf)
    rows = rows.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in FEATURES}).withColumn("bucket", sp.history_bucket(F.col("u_n_success")))
    out = er.single_feature_cuts(rows, FEATURES, LEVELS)
    return out.select("task", "feature", "n_pos", "n_neg", "level", "side", *[F.round(c, 6).alias(c) for c in ("roc_auc", "cut", "recall", "fpr", *[f"recall_{b}" for b in er.BUCKETS])])


# ------------------------------------------------ a score of three components, from features alone

COMPONENTS = ("address", "takeover", "unusual")
_ADDRESS = "round(CAST(COALESCE(ip_distinct_users_24h, 0) + COALESCE(ip_unknown_attempts_24h, 0) AS DOUBLE) + 10 * COALESCE(ip_fail_ratio_24h, 0), 6)"
HYBRID = f"""cp AS (SELECT row_id, {_ADDRESS} AS address, round(COALESCE(llr_sum, 0), 6) AS takeover, round(COALESCE(rare_asn, 0) + COALESCE(rare_country, 0), 6) AS unusual, CASE WHEN part = 'val' AND {LEGIT} THEN pop_weight ELSE 0 END AS rw, success AND u_n_success >= 1 AS known FROM fr),
tl AS (SELECT row_id, greatest(round(SUM(rw) OVER (ORDER BY address DESC) / SUM(rw) OVER (), 9), 1e-7::DOUBLE) AS ta, CASE WHEN known THEN greatest(round(SUM(rw) OVER (ORDER BY takeover DESC) / SUM(rw) OVER (), 9), 1e-7::DOUBLE) ELSE 1.0::DOUBLE END AS tb, greatest(round(SUM(rw) OVER (ORDER BY unusual DESC) / SUM(rw) OVER (), 9), 1e-7::DOUBLE) AS tc FROM cp),
hy AS (SELECT row_id, round(0.0::DOUBLE - log10(least(ta, tb, tc)), 6) AS score, CASE WHEN ta = least(ta, tb, tc) THEN 'address' WHEN tb = least(ta, tb, tc) THEN 'takeover' ELSE 'unusual' END AS triggered_by FROM tl),
hv AS (SELECT score, SUM(pop_weight) AS neg FROM hy JOIN fr USING (row_id) WHERE part = 'val' AND {LEGIT} GROUP BY 1),
th AS (SELECT COALESCE(MAX(CASE WHEN fp > 0.01::DOUBLE * alln THEN score END), '-inf'::DOUBLE) AS tau FROM (SELECT score, SUM(neg) OVER (ORDER BY score DESC) AS fp, SUM(neg) OVER () AS alln FROM hv)),
hx AS (SELECT row_id, score > tau AS caught, triggered_by FROM hy, th)"""


def judged(spark, sf):
    """Feature rows with ``caught, triggered_by`` at the threshold of legitimate validation logins; and the task sets with both."""
    rows, sets = tasked(spark, sf)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    comps = rows.select(
        "row_id", "part", "success", "is_attack_ip", "is_ato", "u_n_success", F.col("pop_weight").alias("w"),
        F.round(zero("ip_distinct_users_24h") + zero("ip_unknown_attempts_24h") + 10 * zero("ip_fail_ratio_24h"), 6).alias("address"),
        F.round(zero("llr_sum"), 6).alias("takeover"), F.round(zero("rare_asn") + zero("rare_country"), 6).alias("unusual"),
    )
    legit = comps.where(f"part = 'val' AND {LEGIT}")
    tailed = ev.tails(legit, comps, list(COMPONENTS))
    tailed = tailed.withColumns({f"tail_{c}": F.greatest(F.round(f"tail_{c}", 9), F.lit(ev.TAIL_FLOOR)) for c in COMPONENTS})
    tailed = tailed.withColumn("tail_takeover", F.when(F.col("success") & (F.col("u_n_success") >= 1), F.col("tail_takeover")).otherwise(1.0))
    scored = ev.min_tail(tailed, list(COMPONENTS)).withColumn("score", F.round("hybrid", 6))
    val = scored.where(f"part = 'val' AND {LEGIT}").select(F.lit("val").alias("task"), F.lit(False).alias("y"), "score", "w")
    tau = ev.thresholds(val, 0.01).select("threshold")  # one row
    marks = scored.join(F.broadcast(tau)).select("row_id", (F.col("score") > F.col("threshold")).alias("caught"), "triggered_by")
    return rows.join(marks, "row_id"), sets.join(marks, "row_id")


_BY = ", ".join(f"round(CASE WHEN COUNT(*) FILTER (WHERE y) > 0 THEN SUM(CASE WHEN y AND caught AND triggered_by = '{c}' THEN pop_weight ELSE 0 END) / SUM(CASE WHEN y THEN pop_weight END) ELSE SUM(CASE WHEN caught AND triggered_by = '{c}' THEN pop_weight ELSE 0 END) / SUM(pop_weight) END, 6) AS by_{c}" for c in COMPONENTS)


@query(
    "hybrid_attribution",
    with_attempts(
        f"""SELECT task, COUNT(*) FILTER (WHERE y) AS n_pos, round(SUM(CASE WHEN y AND caught THEN pop_weight WHEN y THEN 0 END) / SUM(CASE WHEN y THEN pop_weight END), 6) AS recall, round(SUM(CASE WHEN NOT y AND caught THEN pop_weight WHEN NOT y THEN 0 END) / SUM(CASE WHEN NOT y THEN pop_weight END), 6) AS fpr, {_BY}
        FROM (SELECT task, y, pop_weight, row_id FROM tasked UNION ALL SELECT 'val/legit', FALSE, pop_weight, row_id FROM fr WHERE part = 'val' AND {LEGIT}) JOIN hx USING (row_id) GROUP BY 1""", 1, *EVAL_CTES, FR2, TASKED, HYBRID),
)
def hybrid_attribution(spark, sf):
    """Which component raised the caught share of every task set, at the threshold of validation."""
    rows, sets = judged(spark, sf)
    val = rows.where(f"part = 'val' AND {LEGIT}").select(F.lit("val/legit").alias("task"), F.lit(False).alias("y"), F.col("pop_weight").alias("w"), "caught", "triggered_by")
    out = er.attribution(sets.select("task", "y", "w", "caught", "triggered_by").unionByName(val), list(COMPONENTS))
    return out.select("task", "n_pos", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", *[f"by_{c}" for c in COMPONENTS])])


_SEGMENTS = {
    "all": "TRUE", "future": f"t >= {CUT.val_end} AND t < {CUT.test_end}", "past": f"NOT (t >= {CUT.val_end} AND t < {CUT.test_end})",
    **{f"history_{b}": f"bucket = '{b}'" for b in er.BUCKETS}, "labelled_address": "is_attack_ip", "unlabelled_address": "NOT is_attack_ip",
}


@query(
    "ato_segments",
    with_attempts(
        " UNION ALL ".join(
            f"SELECT '{name}' AS segment, COUNT(*) AS n, COUNT(*) FILTER (WHERE caught) AS caught, round(AVG(CASE WHEN caught THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, {', '.join(f'''COUNT(*) FILTER (WHERE caught AND triggered_by = '{c}') AS by_{c}''' for c in COMPONENTS)} FROM cs WHERE {test} HAVING COUNT(*) > 0"
            for name, test in _SEGMENTS.items()), 1, *EVAL_CTES, HYBRID, f"cs AS (SELECT fr.*, {_BUCKET} AS bucket, caught, triggered_by FROM fr JOIN hx USING (row_id) WHERE is_ato)"),
)
def ato_segments(spark, sf):
    """Takeovers caught, by period, depth of history and label of the address."""
    rows, _ = judged(spark, sf)
    cases = rows.where("is_ato").withColumn("bucket", sp.history_bucket(F.col("u_n_success")))
    out = er.segment_recall(cases, {name: F.expr(test) for name, test in _SEGMENTS.items()}, list(COMPONENTS))
    return out.withColumn("recall", F.round("recall", 6))


_GAPS = "CASE WHEN g IS NULL THEN 'over 30 d' " + " ".join(f"WHEN g < {hi} THEN '{label}'" for hi, label in sp.GAP_BORDERS) + " ELSE 'over 30 d' END"


@query(
    "score_limits",
    with_attempts(
        f"""SELECT task, cut, bucket, COUNT(*) FILTER (WHERE y) AS n_pos, round(SUM(CASE WHEN NOT y THEN w END) / ANY_VALUE(alln), 6) AS legit_share, round(SUM(CASE WHEN y AND caught THEN w WHEN y THEN 0 END) / SUM(CASE WHEN y THEN w END), 6) AS recall, round(SUM(CASE WHEN NOT y AND caught THEN w WHEN NOT y THEN 0 END) / SUM(CASE WHEN NOT y THEN w END), 6) AS false_rate
        FROM lm GROUP BY 1, 2, 3 HAVING COUNT(*) FILTER (WHERE y) > 0 AND COUNT(*) FILTER (WHERE NOT y) > 0""", 1, *EVAL_CTES, FR2, TASKED, HYBRID,
        f"""lr AS (SELECT task, y, pop_weight AS w, caught, u_secs_since_last_success AS g, u_n_success, SUM(CASE WHEN NOT y THEN pop_weight END) OVER (PARTITION BY task) AS alln FROM tasked JOIN hx USING (row_id)),
lm AS (SELECT *, 'gap' AS cut, {_GAPS} AS bucket FROM lr UNION ALL SELECT *, 'history', {_BUCKET} FROM lr)"""),
)
def score_limits(spark, sf):
    """Recall and false alerts of the score by time since the last success and by depth of history."""
    _, sets = judged(spark, sf)
    out = er.limits(sets.select("task", "y", "w", "caught", F.col("u_secs_since_last_success").alias("gap_s"), F.col("u_n_success").alias("n_success")))
    return out.select("task", "cut", "bucket", "n_pos", *[F.round(c, 6).alias(c) for c in ("legit_share", "recall", "false_rate")])


# ------------------------------------------------------------------ choosing feature groups

# A score without training: the sum of one number for every kept group.
GROUP_SCORES = {
    "novelty": " + ".join(f"COALESCE(new_{a}, 0)" for a in NOVELTY_ATTRS), "rarity": " + ".join(f"COALESCE(rare_{a}, 0)" for a in FREEMAN_ATTRS),
    "freeman": "COALESCE(llr_sum, 0)", "rhythm": "COALESCE(u_fails_24h, 0) + COALESCE(u_fail_streak, 0)",
    "infra_ip": "10 * COALESCE(ip_fail_ratio_24h, 0) + COALESCE(ip_unknown_attempts_24h, 0)",
}
N_BOOT = 200


def _sum_of(groups) -> str:
    return "round(CAST(" + " + ".join(f"({GROUP_SCORES[g]})" for g in groups) + " AS DOUBLE), 6)"


def _without(g: str) -> list[str]:
    return [x for x in GROUP_SCORES if x != g]


def _models(sets, task: str, models: dict[str, list[str]]):
    out = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(_sum_of(names)).alias("score")) for m, names in models.items()]))
    return sets.where(F.col("task") == task).select("row_id", "y", "w", "cluster", out.alias("m")).select("row_id", "y", "w", "cluster", "m.*")


def _paired_sql(task: str, models: dict[str, list[str]], control: str, seed: int, out: str) -> tuple[str, str]:
    ctes = f"""ms AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, row_id, y, pop_weight AS w, cluster, {_sum_of(names)} AS score FROM tasked WHERE task = '{task}'" for m, names in models.items())}),
mg AS (SELECT model, score, SUM(CASE WHEN y THEN 0 ELSE w END) AS neg, COUNT(*) FILTER (WHERE NOT y) AS nn FROM ms GROUP BY 1, 2),
mt AS (SELECT model, COALESCE(MAX(CASE WHEN nn > 0 AND fp > 0.01::DOUBLE * alln THEN score END), '-inf'::DOUBLE) AS tau FROM (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp, SUM(neg) OVER (PARTITION BY model) AS alln FROM mg) GROUP BY 1),
pc AS (SELECT model, cluster, SUM(w) AS den, SUM(CASE WHEN score > tau THEN w ELSE 0 END) AS num FROM ms JOIN mt USING (model) WHERE y GROUP BY 1, 2),
rp AS (SELECT model, rep, SUM(k * den) AS den, SUM(k * num) AS num FROM {draw_sql("pc", N_BOOT, seed)} GROUP BY 1, 2 HAVING SUM(k * den) > 0),
pt AS (SELECT model, SUM(num) / SUM(den) AS v FROM pc GROUP BY 1),
df AS (SELECT a.model, (a.num - b.num) / b.den AS d FROM rp a JOIN rp b USING (rep) WHERE b.model = '{control}' AND a.model <> '{control}'),
bd AS (SELECT model, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM df GROUP BY 1)"""
    return out + f" FROM bd JOIN pt USING (model), (SELECT v AS c FROM pt WHERE model = '{control}')", ctes


_ROUND = {"control": list(GROUP_SCORES), **{g: _without(g) for g in GROUP_SCORES}}
_SQL, _CTES = _paired_sql("attack_ip/val", _ROUND, "control", 1, "SELECT model, round(v, 6) AS value, round(v - c, 6) AS diff, round(lo, 6) AS lower, round(hi, 6) AS upper")


@query("selection_round", with_attempts(_SQL, 1, *EVAL_CTES, FR2, TASKED, _CTES))
def selection_round(spark, sf):
    """One round of leaving out a group: every candidate against all groups, on shared bootstrap weights."""
    _, sets = tasked(spark, sf)
    out = sel.paired_many(_models(sets, "attack_ip/val", _ROUND), "control", list(GROUP_SCORES), n_boot=N_BOOT, seed=1)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("value", "diff", "lower", "upper")])


_LATE = {"old": list(GROUP_SCORES), **{f"without_{g}": _without(g) for g in GROUP_SCORES}}
_SQL, _CTES = _paired_sql("attack_ip/late", _LATE, "old", 11, "SELECT model, round(v, 6) AS value, round(v - c, 6) AS diff, round(hi, 6) AS upper, hi < 0 AS veto")


@query("late_veto", with_attempts(_SQL, 1, *EVAL_CTES, FR2, TASKED, _CTES))
def late_veto(spark, sf):
    """On the later period: which left-out group would be refused."""
    _, sets = tasked(spark, sf)
    rows = _models(sets, "attack_ip/late", _LATE)
    out = reduce(lambda a, b: a.unionByName(b), [sel.late_veto(rows.where(F.col("model").isin("old", f"without_{g}")), "old", f"without_{g}", n_boot=N_BOOT) for g in GROUP_SCORES])
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("value", "diff", "upper")], "veto")
