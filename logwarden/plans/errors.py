"""Where a score errs: the best cut of every single feature, recall by segment, who raised the alert, limits by gap and history.

A missing feature value (NULL or NaN) is never flagged by a cut; it still counts in the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splits import gap_bucket, history_bucket
from ..operators.joins import lookup
from ..operators.running import Running, running
from ..operators.slicing import DEFAULT_SLICE_ROWS, settle

BUCKETS = ("none", "thin", "thick")
SIDES = ("high", "low")


def _histogram(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row per (task, feature, value): weights of both classes, positives also by bucket of history."""
    number = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features]))
    long = rows.select("task", "y", "w", "bucket", pairs.alias("p")).select("task", "y", "w", "bucket", "p.*")
    y, w = F.col("y"), F.col("w")
    return long.groupBy("task", "feature", "value").agg(
        F.sum(F.when(y, w).otherwise(0.0)).alias("pos"), F.sum(F.when(y, 0.0).otherwise(w)).alias("neg"),
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
        *[F.sum(F.when(y & (F.col("bucket") == b), w).otherwise(0.0)).alias(f"pos_{b}") for b in BUCKETS],
    )


def single_feature_cuts(rows: DataFrame, features: list[str], fprs: tuple[float, ...] = (0.01, 0.001), *, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Per task, feature and false positive level: the better of "above a cut" and "below a cut", and what it catches.

    ``rows``: ``task, y, w, bucket`` and the features.  All features share one histogram and one running total: weight at or
    below a value follows from weight at or above it.  ``cut`` is the last negative value that would exceed the level; it is
    NULL where the level is never exceeded, and then every present value is flagged.  Of equal recalls ``high`` wins.
    ``roc_auc`` ranks missing values lowest.
    """
    at = settle(_histogram(rows, features))
    keys = [F.col("task").alias("_t"), F.col("feature").alias("_f")]
    present = F.col("value").isNotNull()
    totals = at.groupBy(*keys).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.sum("n_pos").alias("count_pos"), F.sum("n_neg").alias("count_neg"),
        F.sum(F.when(present, F.col("neg")).otherwise(0.0)).alias("seen_neg"), F.sum(F.when(present, 0.0).otherwise(F.col("pos"))).alias("lost_pos"),
        *[F.sum(f"pos_{b}").alias(f"all_{b}") for b in BUCKETS],
    )
    own = [("task", "_t"), ("feature", "_f")]
    c = running(at.where(present).withColumn("_down", -F.col("value")), ["task", "feature"], ["_down"], [Running("fp", "sum", F.col("neg"), "upto")], slice_rows=slice_rows)
    c = lookup(c, totals, own, how="inner", small=True).drop("_t", "_f")
    from_low = F.col("seen_neg") - F.col("fp") + F.col("neg")
    over = lambda weight, f: F.when((F.col("n_neg") > 0) & (weight > F.lit(f) * F.col("all_neg")), F.col("value"))
    cuts = c.groupBy(*keys).agg(*[x for i, f in enumerate(fprs) for x in (F.max(over(F.col("fp"), f)).alias(f"high_{i}"), F.min(over(from_low, f)).alias(f"low_{i}"))])
    placed = lookup(c, cuts, own, how="inner", small=True)

    def beyond(side: str, i: int) -> Column:
        cut = F.col(f"{side}_{i}")
        return cut.isNull() | (F.col("value") > cut if side == "high" else F.col("value") < cut)

    caught = ["pos", "neg", *[f"pos_{b}" for b in BUCKETS]]
    # at most a row for each task and feature from here on
    sums = placed.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") * 0.5)).alias("_area"),
        *[F.max(f"{s}_{i}").alias(f"{s}_{i}") for s in SIDES for i in range(len(fprs))],
        *[F.sum(F.when(beyond(s, i), F.col(x)).otherwise(0.0)).alias(f"{s}_{i}_{x}") for s in SIDES for i in range(len(fprs)) for x in caught],
    )
    out = totals.join(sums, ["_t", "_f"], "left")
    tied = F.col("lost_pos") * (F.col("all_neg") - F.col("seen_neg")) * 0.5
    auc = F.try_divide(F.coalesce("_area", F.lit(0.0)) + tied, F.col("all_pos") * F.col("all_neg"))

    def result(s: str, i: int) -> Column:
        share = lambda x, whole: F.try_divide(F.coalesce(F.col(f"{s}_{i}_{x}"), F.lit(0.0)), F.col(whole))
        # sums in another order must not decide a tie; high is the greater flag
        return F.struct(
            F.round(share("pos", "all_pos"), 9).alias("rank"), F.lit(s == "high").alias("first"), F.lit(s).alias("side"), F.col(f"{s}_{i}").alias("cut"),
            share("pos", "all_pos").alias("recall"), share("neg", "all_neg").alias("fpr"), *[share(f"pos_{b}", f"all_{b}").alias(f"recall_{b}") for b in BUCKETS],
        )

    levels = F.explode(F.array(*[F.struct(F.lit(f).alias("level"), F.greatest(*[result(s, i) for s in SIDES]).alias("b")) for i, f in enumerate(fprs)]))
    flat = out.select(F.col("_t").alias("task"), F.col("_f").alias("feature"), F.col("count_pos").alias("n_pos"), F.col("count_neg").alias("n_neg"), auc.alias("roc_auc"), levels.alias("x"))
    return flat.select("task", "feature", "n_pos", "n_neg", "roc_auc", "x.level", "x.b.*").drop("rank", "first")


def segment_recall(cases: DataFrame, segments: dict[str, Column], components: list[str]) -> DataFrame:
    """``segment, n, caught, recall, by_*``: positives per (overlapping) segment, and how many each component raised.

    ``cases``: one row per positive with ``caught, triggered_by``; a segment without cases has no row.
    """
    tags = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in segments.items()])))
    hit = F.col("caught")
    per = cases.select("caught", "triggered_by", tags.alias("segment")).groupBy("segment")
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("caught"), F.avg(hit.cast("double")).alias("recall"),
                   *[F.count_if(hit & (F.col("triggered_by") == c)).alias(f"by_{c}") for c in components])


def attribution(rows: DataFrame, components: list[str]) -> DataFrame:
    """``task, n_pos, recall, fpr, by_*``: shares caught at a transferred threshold, and the part each component raised.

    ``rows``: ``task, y, w, caught, triggered_by``.  The parts are shares of all positives, or of all negatives in a task
    that has no positives.
    """
    y, w = F.col("y"), F.col("w")
    sums = rows.groupBy("task").agg(
        F.count_if(y).alias("n_pos"), F.sum(F.when(y, w)).alias("_pos"), F.sum(F.when(~y, w)).alias("_neg"),
        *[F.sum(F.when(y & F.col("caught") & (F.col("triggered_by") == c), w).otherwise(0.0)).alias(f"_p_{c}") for c in components],
        *[F.sum(F.when(~y & F.col("caught") & (F.col("triggered_by") == c), w).otherwise(0.0)).alias(f"_n_{c}") for c in components],
        F.sum(F.when(y & F.col("caught"), w).otherwise(0.0)).alias("_hit"), F.sum(F.when(~y & F.col("caught"), w).otherwise(0.0)).alias("_false"),
    )
    any_pos = F.col("n_pos") > 0
    return sums.select(
        "task", "n_pos", F.try_divide("_hit", "_pos").alias("recall"), F.try_divide("_false", "_neg").alias("fpr"),
        *[F.when(any_pos, F.try_divide(f"_p_{c}", "_pos")).otherwise(F.try_divide(f"_n_{c}", "_neg")).alias(f"by_{c}") for c in components],
    )


def limits(rows: DataFrame) -> DataFrame:
    """``task, cut, bucket, n_pos, legit_share, recall, false_rate`` by time since the last success and by depth of history.

    ``rows``: ``task, y, w, caught, gap_s, n_success``; a missing gap is the longest.  Buckets without positives or without
    negatives have no row.
    """
    y, w, hit = F.col("y"), F.col("w"), F.col("caught")
    cuts = F.explode(F.array(
        F.struct(F.lit("gap").alias("cut"), gap_bucket(F.col("gap_s")).alias("bucket")), F.struct(F.lit("history").alias("cut"), history_bucket(F.col("n_success")).alias("bucket")),
    ))
    per = rows.select("task", "y", "w", "caught", cuts.alias("c")).groupBy("task", "c.cut", "c.bucket").agg(
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"), F.sum(F.when(y, w)).alias("_pos"), F.sum(F.when(~y, w)).alias("_neg"),
        F.sum(F.when(y & hit, w).otherwise(0.0)).alias("_hit"), F.sum(F.when(~y & hit, w).otherwise(0.0)).alias("_false"),
    )
    legit = rows.groupBy(F.col("task").alias("_t")).agg(F.sum(F.when(~y, w)).alias("_all"))
    j = lookup(per.where("n_pos > 0 AND n_neg > 0"), legit, [("task", "_t")], how="inner", small=True)
    return j.select("task", "cut", "bucket", "n_pos", (F.col("_neg") / F.col("_all")).alias("legit_share"), (F.col("_hit") / F.col("_pos")).alias("recall"), (F.col("_false") / F.col("_neg")).alias("false_rate"))
