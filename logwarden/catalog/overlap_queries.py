"""Rules beside a model: overlap at matched false positive rates, and who catches what the model misses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import ladders as ld
from ..plans import overlap as ov
from ..sources.attempts import read_attempts
from .evaluation_queries import LEVELS, SCORE_SQL
from .fixture import with_attempts
from .registry import query
from .rule_queries import PACE, STATE

#: Every ladder at its third or its second rung (the last of a shorter ladder).
RULE_SETS = {name: {x.name: min(rung, len(x.values)) for x in ld.LADDERS} for name, rung in (("strict", 3), ("wide", 2))}
_COLUMNS = {x.name: x.column for x in ld.LADDERS}
_ANY = {name: " OR ".join(f"{_COLUMNS[k]} >= {rung}" for k, rung in chosen.items()) for name, chosen in RULE_SETS.items()}
MODEL_LEVELS = (0.1, 0.01)

ROWS = f"""rows_ AS (SELECT a.row_id, is_attack_ip AS y, {SCORE_SQL} AS score, CASE WHEN is_attack_ip THEN 1 / 0.15::DOUBLE ELSE 1.0::DOUBLE END AS w, {", ".join(f"COALESCE({c}, 0) AS {c}" for c in _COLUMNS.values())} FROM attempts a LEFT JOIN lv USING (row_id)),
gr AS (SELECT score, SUM(CASE WHEN y THEN 0 ELSE w END) AS neg, COUNT(*) FILTER (WHERE NOT y) AS nn FROM rows_ GROUP BY 1),
cv AS (SELECT *, SUM(neg) OVER (ORDER BY score DESC) AS fp, SUM(neg) OVER () AS alln FROM gr),
tau AS (SELECT level, COALESCE(MAX(CASE WHEN nn > 0 AND fp > level * alln THEN score END), '-inf'::DOUBLE) AS tau FROM cv, (VALUES {", ".join(f"({x}::DOUBLE)" for x in MODEL_LEVELS)}) l(level) GROUP BY 1)"""

SETS = f"""beside AS (SELECT r.*, level, score > tau AS ml, rule_set, CASE WHEN rule_set = 'strict' THEN {_ANY["strict"]} ELSE {_ANY["wide"]} END AS rule FROM rows_ r, tau, (VALUES ('strict'), ('wide')) s(rule_set)),
sh AS (SELECT level, rule_set, COUNT(*) FILTER (WHERE y) AS n_pos, COUNT(*) FILTER (WHERE NOT y) AS n_neg, SUM(CASE WHEN y THEN w END) AS pw, SUM(CASE WHEN NOT y THEN w END) AS nw,
  SUM(CASE WHEN NOT y AND ml THEN w ELSE 0 END) / SUM(CASE WHEN NOT y THEN w END) AS fpr_ml, SUM(CASE WHEN NOT y AND rule THEN w ELSE 0 END) / SUM(CASE WHEN NOT y THEN w END) AS fpr_rules,
  SUM(CASE WHEN NOT y AND (ml OR rule) THEN w ELSE 0 END) / SUM(CASE WHEN NOT y THEN w END) AS fpr_union, SUM(CASE WHEN NOT y AND ml AND rule THEN w ELSE 0 END) / SUM(CASE WHEN NOT y THEN w END) AS fpr_both FROM beside GROUP BY 1, 2),
cuts AS (SELECT level, rule_set, COALESCE(MAX(CASE WHEN nn > 0 AND fp > fpr_union * alln THEN score END), '-inf'::DOUBLE) AS at_union, COALESCE(MAX(CASE WHEN nn > 0 AND fp > fpr_rules * alln THEN score END), '-inf'::DOUBLE) AS at_rules FROM sh, cv GROUP BY 1, 2)"""


def _share(condition: str) -> str:
    return f"SUM(CASE WHEN y AND ({condition}) THEN w ELSE 0 END) / MAX(pw)"


OUT = {
    "pos_both": "ml AND rule", "pos_ml_only": "ml AND NOT rule", "pos_rules_only": "rule AND NOT ml", "pos_neither": "NOT ml AND NOT rule",
    "recall_ml": "ml", "recall_rules": "rule", "recall_union": "ml OR rule", "matched_to_union": "score > at_union", "matched_to_rules": "score > at_rules",
}


def model_rows(spark, sf):
    a = read_attempts(spark, sf, PACE)
    score = (F.col("row_id") % 37) * 0.5 + F.when(F.col("is_attack_ip"), 5.5).otherwise(0.0) + F.when(F.col("success"), 0.0).otherwise(1.5)
    rows = a.select("row_id", F.lit("all").alias("task"), F.col("is_attack_ip").alias("y"), score.alias("score"), F.when(F.col("is_attack_ip"), 1 / 0.15).otherwise(1.0).alias("w"), F.col("ip").alias("cluster"))
    return rows, ld.rule_levels(a)


@query(
    "rule_overlap_matched",
    with_attempts(
        f"""SELECT level, rule_set, MAX(n_pos) AS n_pos, MAX(n_neg) AS n_neg, {", ".join(f"round(MAX({c}), 6) AS {c}" for c in ("fpr_ml", "fpr_rules", "fpr_union", "fpr_both"))},
        {", ".join(f"round({_share(c)}, 6) AS {n}" for n, c in OUT.items())}, round({_share("ml OR rule")} - {_share("score > at_union")}, 6) AS gain
        FROM beside JOIN sh USING (level, rule_set) JOIN cuts USING (level, rule_set) GROUP BY 1, 2""", PACE, STATE, LEVELS, ROWS, SETS),
)
def rule_overlap_matched(spark, sf):
    """Two rule sets beside the model at two thresholds, and the model alone at the false positive rate of both together."""
    rows, levels = model_rows(spark, sf)
    out = ov.matched(ov.flagged(rows, levels, RULE_SETS), MODEL_LEVELS)
    doubles = [c for c, t in out.dtypes if t == "double" and c != "level"]
    return out.select("level", "rule_set", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in doubles])


@query(
    "rule_attribution",
    with_attempts(
        f"""SELECT level, ladder, round(SUM(CASE WHEN hit THEN w ELSE 0 END) / SUM(w), 6) AS share, COUNT(*) FILTER (WHERE hit) AS n FROM
        (SELECT level, w, ladder, CASE {" ".join(f"WHEN ladder = '{k}' THEN {_COLUMNS[k]} >= {rung}" for k, rung in RULE_SETS["wide"].items())} END AS hit FROM rows_, tau, (VALUES {", ".join(f"('{k}')" for k in _COLUMNS)}) l(ladder) WHERE y AND NOT score > tau) GROUP BY 1, 2""", PACE, STATE, LEVELS, ROWS),
)
def rule_attribution(spark, sf):
    """Of the attacks that the model misses, the share that each ladder of the wide set catches."""
    rows, levels = model_rows(spark, sf)
    return ov.attribution(rows, levels, RULE_SETS["wide"], MODEL_LEVELS).select("level", "ladder", F.round("share", 6).alias("share"), "n")
