"""What the rules did on a labelled log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import hits


def labelled_hits(attempts: DataFrame, evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits joined with outcome and labels - the labels are only read after scoring."""
    facts = attempts.select("row_id", "success", "ip", "is_attack_ip", "is_ato")
    return hits(evaluated).join(facts, "row_id"), attempts


def per_rule(labelled: DataFrame, attempts: DataFrame) -> DataFrame:
    attack, ato = F.col("is_attack_ip"), F.col("is_ato")
    counts = labelled.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if("success").alias("success_hits"),
        F.count_if(attack).alias("attack_hits"),
        F.count_if(ato).alias("ato_hits"),
        F.count_if(~attack & ~ato).alias("unlabelled_hits"),
        F.count_if(F.col("scope") == "ip").alias("ip_scope_hits"),
        F.count_if(F.col("scope") == "asn").alias("asn_scope_hits"),
    )
    # distinct addresses in two steps, so that a rule with most of the hits is not one task
    per_ip = labelled.groupBy("rule_id", "ip").agg(F.max(attack).alias("a"), F.max(~attack).alias("o"))
    ips = per_ip.groupBy(F.col("rule_id").alias("_r")).agg(F.count_if("a").alias("attack_ips"), F.count_if("o").alias("other_ips"))
    total = attempts.agg(F.count(F.lit(1)).alias("_events"))
    return (
        counts.join(F.broadcast(ips), F.col("rule_id") == F.col("_r"))
        .join(F.broadcast(total))
        .withColumn("per_10k", F.round(F.lit(10000.0) * F.col("hits") / F.col("_events"), 6))
        .drop("_r", "_events")
    )


def any_rule(evaluated: DataFrame) -> DataFrame:
    enforced = F.exists("hits", lambda h: h["mode"] == "enforce")
    return evaluated.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.size("hits") > 0).alias("any_rule"), F.count_if(enforced).alias("any_enforced")
    )


def evaluated_counts(evaluated: DataFrame) -> DataFrame:
    """Per rule: attempts on which it could run (all attempts minus skips)."""
    skips = evaluated.select(F.explode("skipped.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("skipped"))
    events = evaluated.agg(F.count(F.lit(1)).alias("events"))
    return skips.join(F.broadcast(events)).withColumn("evaluated", F.col("events") - F.col("skipped"))


def samples(evaluated: DataFrame, n: int) -> DataFrame:
    """``n`` example hits per rule from distinct addresses: first hit per address, then the first n."""
    first = hits(evaluated, "ip").groupBy("rule_id", "ip").agg(F.min("row_id").alias("row_id"))
    # two rounds keep the ranking window small: the best n of each part, then the best n
    part = F.pmod(F.xxhash64("ip"), F.lit(64))
    local = first.withColumn("_part", part)
    local = local.withColumn("_r", F.row_number().over(Window.partitionBy("rule_id", "_part").orderBy("row_id"))).where(F.col("_r") <= n)
    return (
        local.withColumn("_r", F.row_number().over(Window.partitionBy("rule_id").orderBy("row_id")))
        .where(F.col("_r") <= n)
        .select("rule_id", "row_id", "ip")
    )
