"""Scorers and models (results depend on training, so they are checked by rows and tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import explain as ex
from ..plans import models as md
from ..plans.features import FREEMAN_ATTRS
from ..sources.attempts import read_attempts
from .evaluation_queries import LEGIT, feature_rows
from .feature_queries import ALL_CTES, FEATURES_CTE, rounded
from .fixture import with_attempts
from .registry import query

NO_IP = [a for a in FREEMAN_ATTRS if a != "ip"]
_SUM = " + ".join("llr_" + a for a in FREEMAN_ATTRS)
_SUM_NO_IP = " + ".join("llr_" + a for a in NO_IP)


@query("freeman_score", with_attempts(f"SELECT row_id, round({_SUM}, 6) + 0.0::DOUBLE AS freeman_all, round({_SUM_NO_IP}, 6) + 0.0::DOUBLE AS freeman_no_ip FROM feats", 1, *ALL_CTES, FEATURES_CTE))
def freeman_score(spark, sf):
    from ..plans.features import feature_group

    f = rounded(feature_group(read_attempts(spark, sf), "freeman"))
    return f.select("row_id", (F.round(md.freeman(), 6) + F.lit(0.0)).alias("freeman_all"), (F.round(md.freeman(NO_IP), 6) + F.lit(0.0)).alias("freeman_no_ip"))


@query(
    "tier2_proxy",
    with_attempts("SELECT row_id, CAST(least(100, 30 * CAST(COALESCE(new_country = 1 AND NOT (u_n_attempts < 10 OR COALESCE(u_age_days, 0) < 7), FALSE) AS INT) + 40 * CAST(COALESCE(cur_success = 0 AND u_fail_streak >= 4, FALSE) AS INT) + 50 * CAST(COALESCE(cur_success = 1 AND u_fail_streak >= 3, FALSE) AS INT)) AS DOUBLE) AS score FROM feats", 1, *ALL_CTES, FEATURES_CTE),
)
def tier2_proxy(spark, sf):
    from ..plans.features import compute_features

    return compute_features(read_attempts(spark, sf)).select("row_id", md.tier2_proxy().alias("score"))


def split_rows(spark, sf, **limits):
    df = feature_rows(spark, sf, **limits).withColumn("y", F.col("is_attack_ip")).withColumn("w", F.col("pop_weight"))
    return md.materialize(df)


@query("gbt_score")
def gbt_score(spark, sf):
    """Boosted trees on train, stopped early on validation, scored on test."""
    df = split_rows(spark, sf)
    model = md.fit_gbt(df.where("part = 'train'"), df.where("part = 'val'"), md.DEFAULT_FEATURES, max_iter=10)
    return md.score_gbt(model, df.where("part IN ('test', 'late')")).select("row_id", "score")


@query("iforest_score")
def iforest_score(spark, sf):
    """Isolation forest on legitimate train logins, every row scored."""
    df = split_rows(spark, sf)
    forest = md.fit_iforest(df.where(f"part = 'train' AND {LEGIT}"), md.DEFAULT_FEATURES)
    return md.score_iforest(forest, df).select("row_id", "score")


@query("knn_distance")
def knn_distance(spark, sf):
    """Mean distance to the nearest reference logins."""
    df = split_rows(spark, sf, only=md.DEFAULT_FEATURES)
    ref = md.fit_knn(df.where(f"part = 'train' AND {LEGIT}"), md.DEFAULT_FEATURES)
    return md.score_knn(ref, df).select("row_id", "score")


@query("isotonic")
def isotonic(spark, sf):
    """Calibration curve of a score against the attack label."""
    df = read_attempts(spark, sf).select((F.col("row_id") % 37 + F.when(F.col("is_attack_ip"), 11).otherwise(0)).cast("double").alias("score"), F.col("is_attack_ip").cast("double").alias("label"), F.lit(1.0).alias("w"))
    return md.fit_isotonic(df)


@query("zscore_explain")
def zscore_explain(spark, sf):
    """The concepts that make each login stand out."""
    df = split_rows(spark, sf)
    stats = ex.moments(df.where(f"part = 'train' AND {LEGIT}"), ex.FEATURES)
    out = ex.explain(df, stats)
    return out.select("row_id", F.array_join(F.transform("concepts", lambda c: F.concat(c["concept"], F.lit("/"), c["lead"])), ",").alias("concepts"))


@query("concept_freq")
def concept_freq(spark, sf):
    df = split_rows(spark, sf)
    stats = ex.moments(df.where(f"part = 'train' AND {LEGIT}"), ex.FEATURES)
    return ex.concept_frequency(ex.explain(df.where("is_attack_ip"), stats))


@query("deletion_test")
def deletion_test(spark, sf):
    """How the deviation score falls when the cited concepts are set to typical values."""
    return md.deletion_test(split_rows(spark, sf), f"part = 'train' AND {LEGIT}", "is_attack_ip")


@query("separability")
def separability(spark, sf):
    """Per feature group: how well it separates attacks, on users unseen in training."""
    return md.separability(split_rows(spark, sf), list(md.GROUPS))
