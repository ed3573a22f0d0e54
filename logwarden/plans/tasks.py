"""Labelled task sets: which rows a score is judged on, and what counts as positive in each.

One long frame ``task, row_id, y, w, cluster`` holds all sets, so that one job scores them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.splits import Cutoffs
from ..operators.sweep import Count, sweep
from .simulate import KINDS, donors_for, select_anchors

COLUMNS = ("task", "row_id", "y", "w", "cluster")


def legit() -> Column:
    """A success that no label marks."""
    return F.col("success") & ~F.col("is_attack_ip") & ~F.col("is_ato")


def observed(rows: DataFrame, cut: Cutoffs) -> DataFrame:
    """Attack addresses per later partition, and takeovers, future and all, against legitimate successes.

    ``rows``: ``row_id, t, uid, ip, partition, pop_weight, success, is_attack_ip, is_ato``.  A row is read once and tagged with
    every set that it belongs to.
    """
    t, part, ato = F.col("t"), F.col("partition"), F.col("is_ato")
    tag = lambda task, y, cluster: F.struct(task.alias("task"), y.alias("y"), F.col(cluster).cast("string").alias("cluster"))
    tags = F.array_compact(F.array(
        F.when(part.isin("val", "test", "late"), tag(F.concat(F.lit("attack_ip/"), part), F.col("is_attack_ip"), "ip")),
        F.when(((part == "test") & legit()) | (ato & (t >= cut.val_end) & (t < cut.test_end)), tag(F.lit("ato/future"), ato, "uid")),
        F.when((part.isin("train", "val", "test") & legit()) | ato, tag(F.lit("ato/all"), ato, "uid")),
    ))
    return rows.select("row_id", F.col("pop_weight").alias("w"), F.explode(tags).alias("x")).select("x.task", "row_id", "x.y", "w", "x.cluster")


def simulated(rows: DataFrame, attempts: DataFrame, part: str, start_us: int, end_us: int, prefix: str) -> DataFrame:
    """Per kind of attacker: every anchor of the part with a donor, against legitimate successes of accounts with history.

    Positives weigh 1; they carry the row ids of the injected logins.
    """
    seen = sweep(attempts.select("row_id", "t", "uid", "success"), "uid", [Count("_n", None, F.col("success"))], boundary="open").where("_n >= 1").select("row_id")
    normal = rows.where((F.col("partition") == part) & legit()).join(seen, "row_id", "left_semi")
    tasks = F.explode(F.array(*[F.lit(f"{prefix}/{k}") for k in KINDS]))
    out = normal.select(tasks.alias("task"), "row_id", F.lit(False).alias("y"), F.col("pop_weight").alias("w"), F.col("uid").cast("string").alias("cluster"))
    anchors = select_anchors(attempts, share=1.0, start_us=start_us, end_us=end_us)
    for kind in KINDS:
        made = donors_for(anchors, attempts, kind=kind, end_us=end_us)
        out = out.unionByName(made.select(F.lit(f"{prefix}/{kind}").alias("task"), "row_id", F.lit(True).alias("y"), F.lit(1.0).alias("w"), F.col("uid").cast("string").alias("cluster")))
    return out


def build(rows: DataFrame, attempts: DataFrame, cut: Cutoffs) -> DataFrame:
    """All eleven sets."""
    out = observed(rows, cut)
    out = out.unionByName(simulated(rows, attempts, "test", cut.val_end, cut.test_end, "attacker"))
    return out.unionByName(simulated(rows, attempts, "val", cut.train_end, cut.val_end, "attacker_val")).select(*COLUMNS)


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task").agg(F.count_if("y").alias("n_pos"), F.count_if(~F.col("y")).alias("n_neg"), F.sum("w").alias("weight"))
