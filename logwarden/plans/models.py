"""Scorers and trained detectors on feature rows.

Training uses pyspark.ml where it has the model; the isolation forest and the nearest
neighbour score are small array programs over bounded samples, broadcast and applied in
Arrow batches.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantile import counted_quantiles, exact_quantiles
from ..session import ensure_checkpoint_dir
from . import evaluate as ev
from . import explain as ex
from .features import FREEMAN_ATTRS, GROUPS
from .quality import uniform
from .selection import backward

DEFAULT_FEATURES = [
    *GROUPS["cur"], *GROUPS["novelty"], *GROUPS["history"], "u_fail_streak", "u_attempts_24h", "u_fails_24h",
    *[f"rare_{a}" for a in FREEMAN_ATTRS], *GROUPS["infra_ip"], *GROUPS["infra_asn"],
]


def materialize(df: DataFrame) -> DataFrame:
    """Write rows that are read several times once, to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def freeman(attrs=FREEMAN_ATTRS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"llr_{a}") for a in attrs])


def tier2_proxy() -> Column:
    learning = (F.col("u_n_attempts") < 10) | (F.coalesce(F.col("u_age_days"), F.lit(0.0)) < 7)
    pts = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = (
        pts((F.col("new_country") == 1) & ~learning, 30)
        + pts((F.col("cur_success") == 0) & (F.col("u_fail_streak") >= 4), 40)
        + pts((F.col("cur_success") == 1) & (F.col("u_fail_streak") >= 3), 50)
    )
    return F.least(F.lit(100), total).cast("double")


def pseudo_random(seed: int = 0) -> Column:
    return uniform(F.col("row_id"), seed)


# --------------------------------------------------------------------- trees


def _vectors(df: DataFrame, features: list[str], missing: float = -1.0) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in features})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="vec").transform(filled).drop(*[f"_f_{c}" for c in features])


def fit_gbt(train: DataFrame, val: DataFrame, features: list[str], *, max_iter: int = 40, seed: int = 7):
    """Weighted boosted trees; validation rows stop the boosting early."""
    from pyspark.ml.classification import GBTClassifier

    both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    rows = _vectors(both, features).select("vec", F.col("y").cast("double").alias("label"), "w", "is_val")
    gbt = GBTClassifier(featuresCol="vec", labelCol="label", weightCol="w", validationIndicatorCol="is_val", maxIter=max_iter, maxDepth=5, stepSize=0.1, seed=seed)
    return gbt.fit(rows), features


def score_gbt(fitted, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    model, features = fitted
    return model.transform(_vectors(rows, features)).withColumn("score", vector_to_array("probability")[1])


# ---------------------------------------------------------- isolation forest


def _bounded_sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows chosen by hash; the model is defined on a sample of this size."""
    n = df.count()
    return df if n <= rows else df.where(uniform(F.col("row_id"), seed) < rows / n)


def _matrix(pdf: pd.DataFrame, names: list[str], fill: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    x = pdf[names].to_numpy(dtype=float)
    for i, c in enumerate(names):
        if c in ex.COUNT_LIKE:
            x[:, i] = np.log1p(np.maximum(np.nan_to_num(x[:, i]), 0.0))
    x = np.where(np.isnan(x), fill, x)
    return (x - mean) / sd


def _scaling(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians for missing values, then mean and deviation - one row of parameters."""
    shaped = df.select(*[ex._shape(c).alias(c) for c in features])
    med = {r["feature"]: r["q"][0] for r in exact_quantiles(ex.unpivot(shaped, features), "feature", "value", [0.5]).collect()}
    fill = np.array([med.get(c) or 0.0 for c in features])
    filled = shaped.select(*[F.coalesce(F.col(c), F.lit(float(m))).alias(c) for c, m in zip(features, fill)])
    row = filled.agg(*[x for c in features for x in (F.avg(c), F.stddev_pop(c))]).first()
    mean = np.array([v or 0.0 for v in row[0::2]])
    sd = np.array([v if v and v > 1e-12 else 1.0 for v in row[1::2]])
    return fill, mean, sd


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One isolation tree as flat arrays: feature, threshold, left child, right child, path length at a leaf."""
    feature, cut, left, right, depth = [], [], [], [], []

    def tail(n: int) -> float:
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0

    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        idx, d, parent, is_right = stack.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), depth.append(d + tail(len(idx)))
        if d >= limit or len(idx) <= 1:
            continue
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        c = float(rng.uniform(lo[f], hi[f]))
        feature[node], cut[node] = f, c
        goes = x[idx, f] < c
        stack.append((idx[~goes], d + 1, node, True))
        stack.append((idx[goes], d + 1, node, False))
    return tuple(np.array(a) for a in (feature, cut, left, right, depth))


def fit_iforest(train: DataFrame, features: list[str], *, trees: int = 300, sample: int = 2048, rows: int = 400_000, seed: int = 7) -> dict:
    """One tree per group of sampled rows; each tree sees at most about ``sample`` rows."""
    pool = _bounded_sample(train, rows, seed)
    fill, mean, sd = _scaling(pool, features)
    n = pool.count()
    share = min(1.0, sample / max(n, 1))
    u = F.pmod(F.xxhash64("row_id", "tree", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = pool.select("row_id", *features).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(u < share)
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("row_id")
        arrays = _grow(_matrix(pdf, features, fill, mean, sd), np.random.default_rng(seed + tree), limit)
        return pd.DataFrame({"tree": [tree], **{k: [v.tolist()] for k, v in zip("fclrd", arrays)}})

    schema = "tree int, f array<int>, c array<double>, l array<int>, r array<int>, d array<double>"
    grown = drawn.groupBy("tree").applyInPandas(build, schema).collect()  # bounded: trees x sample nodes
    size = min(sample, n)
    norm = 2.0 * (np.log(size - 1) + 0.5772156649) - 2.0 * (size - 1) / size if size > 2 else 1.0
    forest = [tuple(np.array(g[k]) for k in "fclrd") for g in grown]
    return {"features": features, "fill": fill, "mean": mean, "sd": sd, "forest": forest, "norm": float(norm)}


def score_iforest(model: dict, rows: DataFrame) -> DataFrame:
    names, forest, norm = model["features"], model["forest"], model["norm"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            x = _matrix(pdf, names, model["fill"], model["mean"], model["sd"])
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for f, c, left, right, d in forest:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = f[at] >= 0
                    if not inner.any():
                        break
                    go = np.where(x[every, np.maximum(f[at], 0)] < c[at], left[at], right[at])
                    at = np.where(inner, go, at)
                total += d[at]
            yield pd.Series(np.power(2.0, -(total / len(forest)) / norm))

    return rows.withColumn("score", score(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))


def fit_knn(train: DataFrame, features: list[str], *, rows: int = 30_000, k: int = 10, seed: int = 7) -> dict:
    """A bounded reference sample of normal logins in scaled space."""
    pool = _bounded_sample(train, rows, seed)
    fill, mean, sd = _scaling(pool, features)
    ref = pool.select(*[F.col(c).cast("double").alias(c) for c in features]).toPandas()  # bounded by the model's size
    return {"features": features, "fill": fill, "mean": mean, "sd": sd, "k": k, "ref": _matrix(ref, features, fill, mean, sd)}


# References per group, and how many more than k are kept by the short comparison.
NEAR_GROUP = 16
NEAR_SPARE = 6


def _turned(ref: np.ndarray, dtype: type) -> np.ndarray:
    """The matrix that makes |r|^2 - 2 x r of rows ``(x, 1)``; filled up to whole groups by references infinitely far away."""
    out = np.zeros((len(ref) + -len(ref) % NEAR_GROUP, ref.shape[1] + 1), dtype)
    out[: len(ref), :-1], out[: len(ref), -1], out[len(ref) :, -1] = -2.0 * ref, (ref**2).sum(axis=1), np.inf
    return np.ascontiguousarray(out.T)


def _smallest(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the ``n`` smallest values of each row, and the largest of these values.

    The n smallest values lie in the n groups of smallest minimum, so only those are looked into.
    """
    groups = g.shape[1] // NEAR_GROUP
    n, cut, rows = min(n, groups), g.reshape(len(g), NEAR_GROUP, groups), np.arange(len(g))[:, None]
    low = cut.min(axis=1)
    at = np.argpartition(low, n - 1, axis=1)[:, :n]
    inside = cut[rows, :, at].reshape(len(g), -1)
    pick = np.argpartition(inside, n - 1, axis=1)[:, :n]
    return at[rows, pick // NEAR_GROUP] + pick % NEAR_GROUP * groups, np.take_along_axis(inside, pick, axis=1).max(axis=1)


def _mean_nearest(batches: Iterator[np.ndarray], ref: np.ndarray, k: int, block: int = 128) -> Iterator[np.ndarray]:
    """For every row of each batch its mean distance to the ``k`` nearest rows of ``ref``, by comparison with all of them.

    All references are compared in single precision, in blocks that stay in the cache; those in front are measured in
    double precision.  Where the rounding of the first could have hidden one of the k, the row is compared in double again.
    """
    k, n = min(k, len(ref)), min(k + NEAR_SPARE, len(ref))
    short, long = (_turned(ref, np.float32), None) if len(ref) >= n * NEAR_GROUP else (None, None)
    far = np.sqrt((ref**2).sum(axis=1).max()) if len(ref) else 0.0
    slack = np.finfo(np.float32).eps * (ref.shape[1] + 8)

    def measured(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = ref[ids] - x[:, None, :]
        return np.sort(np.einsum("ijk,ijk->ij", d, d), axis=1)[:, :k]

    for x in batches:
        out = np.full(len(x), np.nan)
        for i in range(0, len(x) if k else 0, block):
            b = x[i : i + block]
            if short is None:
                out[i : i + block] = np.sqrt(measured(b, np.broadcast_to(np.arange(len(ref)), (len(b), len(ref))))).mean(axis=1)
                continue
            one, norm = np.column_stack((b, np.ones(len(b)))), (b**2).sum(axis=1)
            with np.errstate(over="ignore", invalid="ignore"):
                ids, last = _smallest(one.astype(np.float32) @ short, n)
            near = measured(b, ids)
            unsure = ~(near[:, -1] - norm <= last.astype(float) - slack * (far + np.sqrt(norm)) ** 2)
            if unsure.any():
                long = _turned(ref, np.float64) if long is None else long
                near[unsure] = measured(b[unsure], _smallest(one[unsure] @ long, n)[0])
            out[i : i + block] = np.sqrt(near).mean(axis=1)
        yield out


def score_knn(model: dict, rows: DataFrame) -> DataFrame:
    names, k = model["features"], model["k"]
    ref = rows.sparkSession.sparkContext.broadcast(model["ref"])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        rows = (_matrix(pdf, names, model["fill"], model["mean"], model["sd"]) for pdf in batches)
        yield from map(pd.Series, _mean_nearest(rows, ref.value, k))

    return rows.withColumn("score", score(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))


# ------------------------------------------------------ calibration and rules


def fit_isotonic(rows: DataFrame) -> DataFrame:
    """Breakpoints ``x, p`` of a weighted isotonic fit (``score, label, w``)."""
    from pyspark.ml.regression import IsotonicRegression

    # one row per distinct score carries the same information as all rows
    per = rows.groupBy("score").agg((F.sum(F.col("label") * F.col("w")) / F.sum("w")).alias("label"), F.sum("w").alias("w"))
    model = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="w").fit(per)
    pts = [(float(x), float(min(max(p, 0.0), 1.0))) for x, p in zip(model.boundaries.toArray(), model.predictions.toArray())]
    return rows.sparkSession.createDataFrame(pts, "x double, p double")


# Candidate features of tuned rules, and how each is compared.
CANDIDATE_FLAGS = ("new_country", "new_asn", "new_ip", "new_ua", "new_browser_family", "new_os_family", "new_device")
CANDIDATE_ZERO = ("u_n_success",)
CANDIDATE_GE = (
    "u_fail_streak", "rare_country", "rare_asn", "rare_ip", "ip_distinct_users_24h", "ip_unknown_attempts_24h", "ip_prior_attempts_all", "ip_distinct_ua_24h",
    "asn_fail_ratio_24h", "asn_distinct_users_24h",
)


def youden(rows: DataFrame, *, flags=CANDIDATE_FLAGS, ge=CANDIDATE_GE, eq0=CANDIDATE_ZERO, qs=(0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Best threshold per candidate feature by weighted TPR - FPR (``y, w`` and features); the smaller one on ties.

    ``flags`` fire at 1, ``eq0`` at 0, ``ge`` from a quantile on; a missing value never fires.
    """
    y, w = F.col("y"), F.col("w")
    # a row per feature and value: the quantiles and the rates of all thresholds are made from it
    long = ex.unpivot(rows, [*flags, *ge, *eq0], "y", "w")
    per = materialize(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(y, w)).alias("w_y"), F.sum(F.when(~y, w)).alias("w_n")))
    q = counted_quantiles(per.where(F.col("feature").isin(*ge)), "feature", "value", "n", list(qs))
    fixed = rows.sparkSession.createDataFrame([(c, [1.0]) for c in flags] + [(c, [0.0]) for c in eq0], "feature string, q array<double>")
    cuts = q.unionByName(fixed).select(F.col("feature").alias("_f"), F.explode(F.array_distinct("q")).alias("threshold"))
    joined = per.join(F.broadcast(cuts), F.col("feature") == F.col("_f"))
    meets = F.when(F.col("feature").isin(*eq0), F.col("value") == F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    fired = F.coalesce(meets, F.lit(False))
    rate = lambda c: F.sum(F.when(fired, F.col(c)).otherwise(0.0)) / F.sum(c)
    scored = joined.groupBy("feature", "threshold").agg(rate("w_y").alias("tpr"), rate("w_n").alias("fpr"))
    gain = F.round(F.col("tpr") - F.col("fpr"), 9).alias("j")  # sums in another order must not decide a tie
    best = scored.groupBy("feature").agg(F.max(F.struct(gain, (-F.col("threshold")).alias("o"))).alias("m"))
    return best.select("feature", (F.lit(0.0) - F.col("m.o")).alias("threshold"), F.round("m.j", 6).alias("youden"))


def fit_rule_weights(rows: DataFrame, rules: list[tuple[str, float]], eq0=CANDIDATE_ZERO):
    """Logistic weights of threshold rules; features in ``eq0`` fire at their threshold alone."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    cols = {f"_r{i}": F.coalesce(((F.col(c) == t) if c in eq0 else (F.col(c) >= t)).cast("double"), F.lit(0.0)) for i, (c, t) in enumerate(rules)}
    data = VectorAssembler(inputCols=list(cols), outputCol="vec").transform(rows.withColumns(cols)).select("vec", F.col("y").cast("double").alias("label"), "w")
    return LogisticRegression(featuresCol="vec", labelCol="label", weightCol="w", regParam=1e-4).fit(data)


# ------------------------------------------------------------- model studies


def deletion_test(rows: DataFrame, normal: str, alerts: str) -> DataFrame:
    """Share of the deviation that disappears with the cited concepts, and that they keep alone."""
    train = rows.where(normal)
    stats = ex.moments(train, ex.FEATURES)
    typical = {r["feature"]: r["typical"] for r in ex.typical_values(train).collect()}  # 50 rows of parameters
    explained = ex.explain(rows.where(alerts), stats)
    total = reduce(lambda a, b: a + b, list(ex.zscores(stats).values()))

    def score(df, name):
        return df.select("row_id", total.alias(name))

    base = rows.where(alerts)
    j = score(base, "before").join(score(ex.neutralize(base, explained, typical), "without"), "row_id").join(score(ex.neutralize(base, explained, typical, keep_only=True), "only"), "row_id")
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("before") - F.col("without")), 6).alias("drop"),
        F.round(F.avg(F.try_divide("only", "before")), 6).alias("retention"),
    )


def separability(rows: DataFrame, groups: list[str], *, seed: int = 7) -> DataFrame:
    """AUC of a small model per feature group, trained and tested on disjoint users."""
    side = uniform(F.col("uid"), seed) < 0.5
    out = None
    for g in groups:
        model = fit_gbt(rows.where(side), rows.where(side & (uniform(F.col("uid"), seed + 1) < 0.2)), GROUPS[g], max_iter=5)
        scored = score_gbt(model, rows.where(~side)).select("row_id", F.lit(g).alias("task"), "y", "score", "w", F.col("uid").cast("string").alias("cluster"))
        out = scored if out is None else out.unionByName(scored)
    return ev.metrics(out).select(F.col("task").alias("feature_group"), F.round("roc_auc", 6).alias("roc_auc"))


def feature_configs() -> dict[str, list[str]]:
    """Feature sets for ablation: all, without one group, one group alone."""
    everything = [c for cols in GROUPS.values() for c in cols]
    out = {"all": everything}
    for g, cols in GROUPS.items():
        out[f"without_{g}"] = [c for c in everything if c not in cols]
        out[f"only_{g}"] = list(cols)
    return out


def ablation(rows: DataFrame, configs: dict[str, list[str]], *, max_iter: int = 10) -> DataFrame:
    """Evaluate one model per feature set on test; one evaluation job for all."""
    out = None
    for name, cols in configs.items():
        model = fit_gbt(rows.where("part = 'train'"), rows.where("part = 'val'"), cols, max_iter=max_iter)
        s = score_gbt(model, rows.where("part = 'test'")).select("row_id", F.lit(name).alias("task"), "y", "score", "w", F.col("uid").cast("string").alias("cluster"))
        out = s if out is None else out.unionByName(s)
    return ev.metrics(out)


def backward_select(rows: DataFrame, groups: list[str], *, rounds: int = 2, alpha: float = 0.1, max_iter: int = 10, n_boot: int = 200, veto: bool = False) -> list[str]:
    """Drop the group of features whose removal helps most, while the paired bound says it really helps; ``veto`` asks the late part."""
    def scored(part: str):
        def run(names: tuple[str, ...]) -> DataFrame:
            model = fit_gbt(rows.where("part = 'train'"), rows.where("part = 'val'"), [c for g in names for c in GROUPS[g]], max_iter=max_iter)
            return score_gbt(model, rows.where(F.col("part") == part)).select("row_id", "y", "score", "w", F.col("uid").cast("string").alias("cluster"))

        return run

    kept, _ = backward(scored("val"), groups, late=scored("late") if veto else None, metric="roc_auc", rounds=rounds, alpha=alpha, n_boot=n_boot)
    return kept
