"""Choosing what a model reads: candidates against a control on shared bootstrap weights, and a veto by a later period.

Input rows: ``model, row_id, y BOOLEAN, w, score, cluster``, one per model and scored row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as ev

METRICS = {"roc_auc": "auc_part", "recall": "caught_0"}


def paired_many(scored: DataFrame, control: str, candidates: list[str], *, metric: str = "recall", fpr: float = 0.01, n_boot: int = 300, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """``model, value, diff, lower, upper`` for every candidate: its metric, the gain over the control, one-sided bounds.

    A cluster has one weight in each replicate, whichever the model, so all models share one pass over the clusters.
    Negatives and their thresholds stay fixed; ``metric`` is ``recall`` (at ``fpr``) or ``roc_auc``.
    """
    part = F.col(METRICS[metric])
    pos = ev.positive_values(scored.withColumnRenamed("model", "task"), (fpr,))
    own = lambda m, c: F.sum(F.when(F.col("task") == m, c).otherwise(0.0))
    per = pos.groupBy("cluster").agg(own(control, F.col("w")).alias("den"), *[own(m, F.col("w") * part).alias(f"m{i}") for i, m in enumerate([control, *candidates])])
    names = [f"m{i}" for i in range(len(candidates) + 1)]
    point = per.agg(*[(F.sum(n) / F.sum("den")).alias(n) for n in names])
    draws = ev.replicates(per, names, n_boot=n_boot, seed=seed)
    gain = lambda n: (F.col(n) - F.col("m0")) / F.col("den")
    bounds = draws.agg(*[x for n in names[1:] for x in (F.percentile(gain(n), alpha).alias(f"{n}_lo"), F.percentile(gain(n), 1 - alpha).alias(f"{n}_hi"))])
    one = point.join(F.broadcast(bounds))  # one row each
    out = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(n).alias("value"), (F.col(n) - F.col("m0")).alias("diff"), F.col(f"{n}_lo").alias("lower"), F.col(f"{n}_hi").alias("upper"))
        for m, n in zip(candidates, names[1:])
    ]))
    return one.select(out.alias("x")).select("x.*")


def late_veto(scored: DataFrame, old: str, new: str, *, n_boot: int = 300, seed: int = 11, alpha: float = 0.05) -> DataFrame:
    """``model, value, diff, upper, veto``: on later rows a new model is refused if it is worse even at the upper bound."""
    return paired_many(scored, old, [new], n_boot=n_boot, seed=seed, alpha=alpha).select("model", "value", "diff", "upper", (F.col("upper") < 0).alias("veto"))


def backward(
    score: Callable[[tuple[str, ...]], DataFrame],
    groups: list[str],
    *,
    late: Callable[[tuple[str, ...]], DataFrame] | None = None,
    metric: str = "recall",
    rounds: int = 4,
    alpha: float = 0.05,
    n_boot: int = 300,
) -> tuple[list[str], list[dict]]:
    """Leave out one group a round while that helps beyond the bootstrap bound; the kept groups and what each round saw.

    ``score`` trains on the kept groups and returns ``row_id, y, w, score, cluster``.  With ``late`` (the same on later rows)
    the final choice is compared with all groups and given up where the veto says so; the last entry then holds ``veto``.
    """
    kept, seen = tuple(groups), []
    for turn in range(1, rounds + 1):
        if len(kept) < 2:
            break
        tried = [(g, tuple(x for x in kept if x != g)) for g in kept]
        frames = [score(kept).withColumn("model", F.lit("control")), *[score(names).withColumn("model", F.lit(g)) for g, names in tried]]
        table = paired_many(reduce(DataFrame.unionByName, frames), "control", list(kept), metric=metric, n_boot=n_boot, seed=turn, alpha=alpha)
        found = table.collect()  # a row for each group
        good = [r for r in found if r["lower"] > 0]
        best = min(good, key=lambda r: (-r["value"], r["model"])) if good else None
        seen.append({"groups": list(kept), "candidates": [r.asDict() for r in found], "accepted": best and best["model"]})
        if best is None:
            break
        kept = tuple(x for x in kept if x != best["model"])
    if late is not None and kept != tuple(groups):
        both = late(tuple(groups)).withColumn("model", F.lit("old")).unionByName(late(kept).withColumn("model", F.lit("new")))
        judged = late_veto(both, "old", "new", n_boot=n_boot, alpha=alpha).first()
        seen.append({"groups": list(kept), "veto": judged["veto"], "upper": judged["upper"]})
        if judged["veto"]:
            kept = tuple(groups)
    return list(kept), seen
