"""Weighted evaluation of scores: curves, thresholds, bootstrap, slices, drift.

Input rows: ``task, y BOOLEAN, score DOUBLE, w DOUBLE, cluster``.  Rows collapse to one
per (task, distinct score) before any ordering; cumulative weights are running totals
that are sliced when a task has many distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..operators.quantile import exact_quantiles
from ..operators.running import Running, running
from ..operators.slicing import DEFAULT_SLICE_ROWS

NEG_INF = float("-inf")


def curve(rows: DataFrame, *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Per (task, score): positive / negative weight at and at-or-above the score, with task totals."""
    y, w = F.col("y"), F.col("w")
    at = rows.groupBy("task", "score").agg(
        F.sum(F.when(y, w).otherwise(0.0)).alias("pos"), F.sum(F.when(~y, w).otherwise(0.0)).alias("neg"),
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
    )
    at = at.withColumn("_down", -F.col("score"))
    at = running(at, ["task"], ["_down"], [Running("tp", "sum", F.col("pos"), "upto"), Running("fp", "sum", F.col("neg"), "upto")], slice_rows=slice_rows)
    totals = at.groupBy(F.col("task").alias("_task")).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.sum("n_pos").alias("count_pos"), F.sum("n_neg").alias("count_neg")
    )
    return lookup(at, totals, [("task", "_task")], how="inner", small=True).drop("_task", "_down")


def exceeding(fpr: float) -> Column:
    """Highest negative score at which the false positive weight exceeds the target (aggregate)."""
    over = (F.col("n_neg") > 0) & (F.col("fp") > F.lit(fpr) * F.col("all_neg"))
    return F.coalesce(F.max(F.when(over, F.col("score"))), F.lit(NEG_INF))


def threshold_for_recall(tpr: float) -> Column:
    """Highest score that still catches the target share of positives (aggregate)."""
    enough = (F.col("n_pos") > 0) & (F.col("tp") / F.col("all_pos") >= F.lit(tpr - 1e-12))
    return F.coalesce(F.max(F.when(enough, F.col("score"))), F.min(F.when(F.col("n_pos") > 0, F.col("score"))))


def metrics(rows: DataFrame, *, fprs=(0.01, 0.001), tprs=(0.90, 0.99), slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """One row per task: roc_auc, pr_auc, recall at FPR targets, FPR at recall targets."""
    c = curve(rows, slice_rows=slice_rows)
    below = F.col("all_neg") - F.col("fp")
    cuts = c.groupBy(F.col("task").alias("_task")).agg(
        *[exceeding(f).alias(f"_s_{i}") for i, f in enumerate(fprs)], *[threshold_for_recall(t).alias(f"_t_{i}") for i, t in enumerate(tprs)]
    )
    both = lookup(c, cuts, [("task", "_task")], how="inner", small=True)
    return both.groupBy("task").agg(
        F.max("count_pos").alias("n_pos"),
        F.max("count_neg").alias("n_neg"),
        (F.sum(F.col("pos") * (below + F.col("neg") * 0.5)) / F.max(F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("all_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).alias("pr_auc"),
        *[(F.sum(F.when(F.col("score") > F.col(f"_s_{i}"), F.col("pos")).otherwise(0.0)) / F.max("all_pos")).alias(f"recall_{i}") for i in range(len(fprs))],
        *[(F.sum(F.when(F.col("score") >= F.col(f"_t_{i}"), F.col("neg")).otherwise(0.0)) / F.max("all_neg")).alias(f"reauth_{i}") for i in range(len(tprs))],
    )


def thresholds(rows: DataFrame, fpr: float) -> DataFrame:
    return curve(rows).groupBy("task").agg(exceeding(fpr).alias("threshold"))


def realized(rows: DataFrame, thresholds_: DataFrame) -> DataFrame:
    """False positive rate and recall of a chosen threshold on other rows (``task`` matches)."""
    joined = lookup(rows, thresholds_.select(F.col("task").alias("_task"), "threshold"), [("task", "_task")], how="inner", small=True)
    y, w, flag = F.col("y"), F.col("w"), F.col("score") > F.col("threshold")
    pos, neg = F.sum(F.when(y, w)), F.sum(F.when(~y, w))
    return joined.groupBy("task").agg(
        F.max("threshold").alias("threshold"),
        (F.coalesce(F.sum(F.when(~y & flag, w)), F.lit(0.0)) / neg).alias("fpr"),
        (F.coalesce(F.sum(F.when(y & flag, w)), F.lit(0.0)) / pos).alias("recall"),
    )


# ------------------------------------------------------------------- bootstrap


def poisson_one(key: Column, rep: Column, seed: int) -> Column:
    """A Poisson(1) count from 48 bits of an MD5 digest: how often a cluster is drawn in one replicate."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), rep.cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    total = F.lit(0)
    for cdf in poisson_cdf():
        total = total + F.when(u >= cdf, 1).otherwise(0)
    return total


def poisson_cdf() -> list[float]:
    """The distribution function of Poisson(1) at 0, 1, ... up to the resolution of the draw."""
    out, p, cdf = [], 1.0 / 2.718281828459045, 0.0
    for k in range(17):
        cdf += p
        out.append(cdf)
        p /= k + 1
    return out


def replicates(per: DataFrame, names: list[str], *, n_boot: int, seed: int) -> DataFrame:
    """``rep, den`` and the sums of ``names``, per replicate over the rows of one cluster each; replicates without weight are left out."""
    reps = per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("k", poisson_one(F.col("cluster"), F.col("rep"), seed))
    drawn = reps.where("k > 0").groupBy("rep").agg(F.sum(F.col("k") * F.col("den")).alias("den"), *[F.sum(F.col("k") * F.col(n)).alias(n) for n in names])
    return drawn.where("den > 0")


def bootstrap_ratio(rows: DataFrame, numerator: dict[str, Column], weight: Column, *, n_boot: int = 300, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Confidence interval per metric for weighted shares, resampling clusters.

    Clusters are summed first, so replicates multiply clusters, not rows.
    """
    names = list(numerator)
    per = rows.groupBy("cluster").agg(F.sum(weight).alias("den"), *[F.sum(weight * numerator[n]).alias(n) for n in names])
    draws = replicates(per, names, n_boot=n_boot, seed=seed)
    point = per.agg(*[(F.sum(n) / F.sum("den")).alias(n) for n in names])
    lo, hi = alpha / 2, 1 - alpha / 2
    ci = draws.agg(*[x for n in names for x in (F.percentile(F.col(n) / F.col("den"), lo).alias(f"{n}_lo"), F.percentile(F.col(n) / F.col("den"), hi).alias(f"{n}_hi"))])
    both = point.join(F.broadcast(ci))
    out = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi")) for n in names]))
    return both.select(out.alias("m")).select("m.*")


def positive_values(rows: DataFrame, fprs=(0.01,)) -> DataFrame:
    """Positives with their share of negatives below (ties half) and caught flags against fixed negatives."""
    c = curve(rows)
    cuts = c.groupBy(F.col("task").alias("_t")).agg(*[exceeding(f).alias(f"_s_{i}") for i, f in enumerate(fprs)])
    rank = c.select(
        F.col("task").alias("_task"), F.col("score").alias("_score"), ((F.col("all_neg") - F.col("fp") + F.col("neg") * 0.5) / F.col("all_neg")).alias("auc_part")
    )
    pos = rows.where("y").join(rank, (F.col("task") == F.col("_task")) & (F.col("score") == F.col("_score"))).drop("_task", "_score")
    pos = lookup(pos, cuts, [("task", "_t")], how="inner", small=True).drop("_t")
    return pos.withColumns({f"caught_{i}": (F.col("score") > F.col(f"_s_{i}")).cast("double") for i in range(len(fprs))})


def paired_bootstrap(rows_a: DataFrame, rows_b: DataFrame, *, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """Interval of metric(b) - metric(a) on the same clusters (rows carry ``row_id``)."""
    a = positive_values(rows_a).select("row_id", "cluster", "w", F.col("auc_part").alias("a_auc"), F.col("caught_0").alias("a_rec"))
    b = positive_values(rows_b).select("row_id", F.col("auc_part").alias("b_auc"), F.col("caught_0").alias("b_rec"))
    diff = {"roc_auc_gain": F.col("b_auc") - F.col("a_auc"), "recall_gain": F.col("b_rec") - F.col("a_rec")}
    return bootstrap_ratio(a.join(b, "row_id"), diff, F.col("w"), n_boot=n_boot, seed=seed)


# -------------------------------------------------------------------- ensemble

TAIL_FLOOR = 1e-7


def tails(reference: DataFrame, scored: DataFrame, components: list[str], *, gates: dict[str, Column] | None = None) -> DataFrame:
    """Share of reference weight at or above each row's component score, floored; 1 behind a closed gate.

    One running total over reference and scored rows together, in long form.
    """
    def long(df, is_ref):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("score")) for c in components]))
        w = F.col("w") if is_ref else F.lit(0.0)
        rid = F.lit(None).cast("bigint") if is_ref else F.col("row_id")
        return df.select(rid.alias("row_id"), w.alias("w"), pairs.alias("p")).select("row_id", "w", "p.component", (-F.col("p.score")).alias("_down"))

    both = long(reference, True).unionByName(long(scored, False))
    ran = running(both, ["component"], ["_down"], [Running("above", "sum", F.col("w"), "upto")])
    total = reference.agg(F.sum("w").alias("_total"))
    share = ran.where("row_id IS NOT NULL").join(F.broadcast(total)).withColumn("tail", F.greatest(F.col("above") / F.col("_total"), F.lit(TAIL_FLOOR)))
    wide = share.groupBy("row_id").agg(*[F.max(F.when(F.col("component") == c, F.col("tail"))).alias(f"tail_{c}") for c in components])
    out = scored.join(wide, "row_id")
    return out.withColumns({f"tail_{c}": F.when(g, F.col(f"tail_{c}")).otherwise(1.0) for c, g in (gates or {}).items()})


def min_tail(tailed: DataFrame, components: list[str]) -> DataFrame:
    """-log10 of the smallest tail, and which component it came from (first on a tie)."""
    arr = F.array(*[F.col(f"tail_{c}") for c in components])
    least = F.array_min(arr)
    names = F.array(*[F.lit(c) for c in components])
    return tailed.withColumns({"hybrid": F.lit(0.0) - F.log10(least), "triggered_by": F.element_at(names, F.array_position(arr, least).cast("int"))})


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-count bins by predicted probability: ``bin, predicted, observed, weight_share``."""
    ranked = running(rows, [], ["p", "row_id"], [Running("_r", "sum", F.lit(1), "through_row")])
    total = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum("w").alias("_w"))
    # the bin whose integer edges floor(n*i/bins) enclose the 0-based rank
    pos, n = F.col("_r") - 1, F.col("_n")
    b = F.floor(pos * bins / n)
    edge = lambda i: F.floor(n * i / bins)
    b = F.when(pos >= edge(b + 1), b + 1).when(pos < edge(b), b - 1).otherwise(b)
    binned = ranked.join(F.broadcast(total)).withColumn("bin", b.cast("int"))
    y = F.col("y").cast("double")
    return binned.groupBy("bin").agg(
        (F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("predicted"), (F.sum(y * F.col("w")) / F.sum("w")).alias("observed"), (F.sum("w") / F.max("_w")).alias("weight_share")
    )


def brier(rows: DataFrame) -> DataFrame:
    y = F.col("y").cast("double")
    return rows.agg((F.sum(F.col("w") * F.pow(F.col("p") - y, 2)) / F.sum("w")).alias("brier"))


# ----------------------------------------------------------------------- drift


def psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature, all features in one job."""
    from .explain import unpivot

    ref, cur = unpivot(reference, features).where("value IS NOT NULL"), unpivot(current, features).where("value IS NOT NULL")
    qs = exact_quantiles(ref, "feature", "value", [i / bins for i in range(bins + 1)])
    edges = qs.select(F.col("feature").alias("_f"), F.array_sort(F.array_distinct("q")).alias("edges"))
    inner = edges.select("_f", F.size("edges").alias("_n"), F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner"))

    def histogram(df, name):
        placed = lookup(df, inner, [("feature", "_f")], how="inner", small=True)
        # bins are [e0,e1) ... [en-1,en]: a value on an inner border belongs to the bin it opens
        b = F.size(F.filter("inner", lambda e: e <= F.col("value")))
        return placed.withColumn("bin", b).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias(name), F.max("_n").alias(f"n_{name}"))

    r, c = histogram(ref, "r"), histogram(cur, "c")
    both = r.join(c, ["feature", "bin"], "full")
    tot = both.groupBy(F.col("feature").alias("_f2")).agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"), F.max(F.coalesce("n_r", "n_c")).alias("_edges"))
    spread = lambda df: df.groupBy(F.col("feature").alias("_f3")).agg(F.array_sort(F.array(F.min("value"), F.max("value"))).alias("v"))
    joined = both.join(F.broadcast(tot), F.col("feature") == F.col("_f2"))
    rs = F.greatest(F.coalesce(F.col("r"), F.lit(0)) / F.col("_r"), F.lit(1e-4))
    cs = F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.col("_c"), F.lit(1e-4))
    # a bin empty on both sides contributes nothing: both shares sit on the floor
    out = joined.groupBy("feature").agg(F.sum((cs - rs) * F.log(cs / rs)).alias("_psi"), F.max("_r").alias("n_reference"), F.max("_c").alias("n_current"), F.max("_edges").alias("_edges"))
    ends = spread(ref).join(spread(cur).select(F.col("_f3").alias("_f4"), F.col("v").alias("vc")), F.col("_f3") == F.col("_f4"))
    out = out.join(F.broadcast(ends), F.col("feature") == F.col("_f3"), "left")
    few = F.col("_edges") < 3
    value = F.when(F.coalesce(F.col("n_current"), F.lit(0)) == 0, F.lit(None)).when(few, F.when(F.col("v") == F.col("vc"), 0.0)).otherwise(F.col("_psi"))
    verdict = F.when(value.isNull(), "not enough data").when(value < 0.1, "stable").when(value < 0.25, "moderate").otherwise("significant")
    return out.select("feature", value.alias("psi"), verdict.alias("verdict"), "n_reference", "n_current", (F.coalesce(F.col("n_current"), F.lit(0)) < 30).alias("low_confidence"))


def precision_at(recall: Column, fpr: Column, prevalence: float) -> Column:
    hit, false = recall * prevalence, fpr * (1.0 - prevalence)
    return F.when(hit + false > 0, hit / (hit + false)).otherwise(0.0)


def strictly_increasing(cuts: list[float], maximum: int = 100) -> list[int]:
    """Ceilings of three cut points, pushed apart so that they increase within 0..maximum."""
    import math

    out: list[int] = []
    for c in cuts:
        low = out[-1] + 1 if out else 0
        out.append(max(low, math.ceil(c) if c != NEG_INF else low))
    for i in range(len(out) - 1, -1, -1):
        out[i] = min(out[i], maximum - (len(out) - 1 - i))
    return out
