"""What rules add to a model: overlap at the model's threshold, and against the model alone at the same false positive rate.

Input rows: ``task, row_id, y BOOLEAN, w, score, cluster`` and the deepest level each row
reaches on the rule ladders.  A rule set names a rung for some ladders; a row is flagged
if it reaches one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slicing import settle
from . import evaluate as ev
from .ladders import LADDERS

SETS_LEVELS = ("task", "level", "rule_set")


def flags(chosen: dict[str, int], ladders=LADDERS) -> dict[str, Column]:
    """Per chosen ladder: whether a row reaches its rung."""
    column = {x.name: x.column for x in ladders}
    return {name: F.coalesce(F.col(column[name]) >= rung, F.lit(False)) for name, rung in chosen.items()}


def flagged(rows: DataFrame, levels: DataFrame, sets: dict[str, dict[str, int]], ladders=LADDERS) -> DataFrame:
    """``rows`` once for each rule set, with ``rule_set, rule``; rows without levels are not flagged."""
    joined = rows.join(levels, "row_id", "left")
    any_of = lambda chosen: reduce(lambda a, b: a | b, flags(chosen, ladders).values(), F.lit(False))
    out = F.explode(F.array(*[F.struct(F.lit(name).alias("rule_set"), any_of(chosen).alias("rule")) for name, chosen in sets.items()]))
    return joined.select(*rows.columns, out.alias("_f")).select(*rows.columns, "_f.*")


def exceeding_many(curve: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """For every target rate (``task, *keys, rate``) the highest score at which the false positive rate exceeds it.

    All targets are looked up in one pass over the curve; a target that is never exceeded gets minus infinity.
    """
    asked = targets.select(F.col("task").alias("_t"), *keys, "rate")
    over = (F.col("n_neg") > 0) & (F.col("fp") > F.col("rate") * F.col("all_neg"))
    # a row for each task, level and set: small by construction
    met = curve.join(F.broadcast(asked), F.col("task") == F.col("_t"))
    return met.groupBy("task", *keys).agg(F.coalesce(F.max(F.when(over, F.col("score"))), F.lit(ev.NEG_INF)).alias("at"))


def _leveled(rows: DataFrame, curve: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """``rows`` once for each false positive level of the model, with ``level, ml``."""
    targets = curve.select("task").distinct().select("task", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    taus = exceeding_many(curve, targets.withColumn("rate", F.col("level")), ["level"]).withColumnRenamed("at", "tau").withColumnRenamed("task", "_t")
    return rows.join(F.broadcast(taus), F.col("task") == F.col("_t")).drop("_t").withColumn("ml", F.col("score") > F.col("tau"))


def matched(rows: DataFrame, levels: tuple[float, ...] = (0.01, 0.001), *, n_boot: int = 0) -> DataFrame:
    """One row per task, level and rule set, from ``rows`` with ``rule_set, rule``.

    False positive rates of model, rules, either and both; how the caught positives divide; recall of each; recall of the
    model alone with its threshold moved to the rate of either (or of the rules), and the gain of the rules over it.  With
    ``n_boot`` the interval of the gain is added, clusters drawn alike for both sides.
    """
    curve = settle(ev.curve(rows.where(F.col("rule_set") == rows.select(F.min("rule_set")).first()[0])))
    both = _leveled(rows, curve, levels)
    y, w, ml, rule = F.col("y"), F.col("w"), F.col("ml"), F.col("rule")

    def share(side: Column, c: Column) -> Column:
        return F.sum(F.when(side & c, w).otherwise(0.0)) / F.sum(F.when(side, w))

    shares = both.groupBy(*SETS_LEVELS).agg(
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
        *[share(~y, c).alias(f"fpr_{n}") for n, c in (("ml", ml), ("rules", rule), ("union", ml | rule), ("both", ml & rule))],
        *[share(y, c).alias(f"pos_{n}") for n, c in (("both", ml & rule), ("ml_only", ml & ~rule), ("rules_only", ~ml & rule), ("neither", ~ml & ~rule))],
        *[share(y, c).alias(f"recall_{n}") for n, c in (("ml", ml), ("rules", rule), ("union", ml | rule))],
    )
    keys = ["level", "rule_set"]
    cuts = shares
    for side in ("union", "rules"):
        at = exceeding_many(curve, shares.select("task", *keys, F.col(f"fpr_{side}").alias("rate")), keys).withColumnRenamed("at", f"at_{side}")
        cuts = cuts.join(F.broadcast(at), ["task", *keys])
    placed = both.join(F.broadcast(cuts.select(*SETS_LEVELS, "at_union", "at_rules")), list(SETS_LEVELS))
    alone = placed.groupBy(*SETS_LEVELS).agg(*[share(y, F.col("score") > F.col(f"at_{s}")).alias(f"matched_to_{s}") for s in ("union", "rules")])
    out = cuts.drop("at_union", "at_rules").join(F.broadcast(alone), list(SETS_LEVELS)).withColumn("gain", F.col("recall_union") - F.col("matched_to_union"))
    if not n_boot:
        return out
    gains = []
    for r in out.select(*SETS_LEVELS).collect():  # a row for each task, level and set
        own = placed.where(reduce(lambda a, b: a & b, [F.col(k) == r[k] for k in SETS_LEVELS]) & y)
        diff = (ml | rule).cast("double") - (F.col("score") > F.col("at_union")).cast("double")
        interval = ev.bootstrap_ratio(own, {"gain": diff}, w, n_boot=n_boot).select(F.col("lo").alias("gain_lo"), F.col("hi").alias("gain_hi"))
        gains.append(interval.select(*[F.lit(r[k]).alias(k) for k in SETS_LEVELS], "gain_lo", "gain_hi"))
    return out.join(F.broadcast(reduce(DataFrame.unionByName, gains)), list(SETS_LEVELS))


def attribution(rows: DataFrame, levels: DataFrame, chosen: dict[str, int], fprs: tuple[float, ...] = (0.01, 0.001), ladders=LADDERS) -> DataFrame:
    """``task, level, ladder, share, n``: of the positives that the model misses, those that each chosen ladder catches."""
    curve = ev.curve(rows)
    missed = _leveled(rows, curve, fprs).where(F.col("y") & ~F.col("ml")).join(levels, "row_id", "left")
    hits = F.explode(F.array(*[F.struct(F.lit(name).alias("ladder"), hit.alias("hit")) for name, hit in flags(chosen, ladders).items()]))
    long = missed.select("task", "level", "w", hits.alias("h")).select("task", "level", "w", "h.*")
    return long.groupBy("task", "level", "ladder").agg(
        (F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"), F.count_if("hit").alias("n")
    )
