"""Curves and drift against NumPy readings of the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.plans import evaluate as ev

RNG = np.random.default_rng(0)
Y = RNG.random(400) < 0.15
SCORE = np.round(RNG.normal(size=400) + Y, 1)
W = np.where(Y, 1 / 0.15, 1.0)


@pytest.mark.parametrize("slice_rows", [10_000, 9])
def test_metrics(spark, slice_rows):
    rows = spark.createDataFrame([("t", bool(y), float(s), float(w), "c") for y, s, w in zip(Y, SCORE, W)], "task string, y boolean, score double, w double, cluster string")
    m = ev.metrics(rows, fprs=(0.05,), tprs=(0.8,), slice_rows=slice_rows).first()
    pos, neg, pw, nw = SCORE[Y], SCORE[~Y], W[Y], W[~Y]
    auc = sum(w * (nw[neg < s].sum() + 0.5 * nw[neg == s].sum()) for s, w in zip(pos, pw)) / (pw.sum() * nw.sum())
    assert math.isclose(m["roc_auc"], auc, rel_tol=1e-12)
    ap = 0.0
    for s in np.unique(pos):
        tp, fp = pw[pos >= s].sum(), nw[neg >= s].sum()
        ap += pw[pos == s].sum() / pw.sum() * tp / (tp + fp)
    assert math.isclose(m["pr_auc"], ap, rel_tol=1e-12)
    order = np.argsort(-neg)
    star = neg[order][np.searchsorted(np.cumsum(nw[order]), 0.05 * nw.sum(), side="right")]
    assert math.isclose(m["recall_0"], pw[pos > star].sum() / pw.sum(), rel_tol=1e-12)
    p = np.sort(pos)[::-1]
    at = p[np.searchsorted(np.cumsum(np.ones(len(p))) / len(p), 0.8 - 1e-12)]
    assert math.isclose(m["reauth_0"], nw[neg >= at].sum() / nw.sum(), rel_tol=1e-12)


def test_psi(spark):
    a, b = RNG.normal(size=300), RNG.normal(0.6, 1, size=200)
    df = lambda v, c: spark.createDataFrame([(float(x), c) for x in v], "x double, flat double")
    got = {r["feature"]: r for r in ev.psi(df(a, 1.0), df(b, 1.0), ["x", "flat"]).collect()}
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.maximum(np.histogram(a, edges)[0] / len(a), 1e-4)
    c = np.maximum(np.histogram(b, edges)[0] / len(b), 1e-4)
    assert math.isclose(got["x"]["psi"], float(((c - r) * np.log(c / r)).sum()), rel_tol=1e-9)
    assert got["flat"]["psi"] == 0.0 and got["x"]["verdict"] == "significant"


def test_bands_increase():
    assert ev.strictly_increasing([10.2, 10.4, 10.9]) == [11, 12, 13]
    assert ev.strictly_increasing([99.5, 99.9, 99.9]) == [98, 99, 100]


def test_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([(f"c{i % 20}", float(i % 3 == 0)) for i in range(200)], "cluster string, hit double")
    a = ev.bootstrap_ratio(rows, {"share": F.col("hit")}, F.lit(1.0), n_boot=100).first()
    b = ev.bootstrap_ratio(rows, {"share": F.col("hit")}, F.lit(1.0), n_boot=100).first()
    assert a == b and a["lo"] <= a["value"] <= a["hi"]


def test_forest_has_the_reference_size(spark, sf, monkeypatch):
    import inspect

    from logwarden.catalog import model_queries

    signature, seen = inspect.signature(model_queries.md.fit_iforest), {}

    def fit(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)

    monkeypatch.setattr(model_queries.md, "fit_iforest", fit)
    monkeypatch.setattr(model_queries.md, "score_iforest", lambda model, rows: rows.selectExpr("row_id", "0.0D AS score"))
    model_queries.iforest_score(spark, sf)
    assert (seen["trees"], seen["sample"], seen["rows"]) == (300, 2048, 400_000)


def test_thresholds_read_the_rows_once(spark):
    """One histogram serves the quantiles and the rates; missing values never fire but count."""
    from logwarden.plans.models import youden

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    data = [(bool(y), float(w), None if i % 9 == 0 else float(s), float(i % 4 == 0 or y), float(i % 3)) for i, (y, w, s) in enumerate(zip(Y, W, SCORE))]
    rows = spark.createDataFrame(data, "y boolean, w double, g double, f double, z double").mapInArrow(counted, "y boolean, w double, g double, f double, z double")
    got = {r["feature"]: (r["threshold"], r["youden"]) for r in youden(rows, flags=("f",), ge=("g",), eq0=("z",)).collect()}

    def gain(fires):
        rate = lambda side: sum(r[1] for r in data if r[0] == side and fires(r)) / sum(r[1] for r in data if r[0] == side)
        return round(rate(True) - rate(False), 9)

    cuts = sorted({float(c) for c in np.quantile([r[2] for r in data if r[2] is not None], (0.5, 0.75, 0.9, 0.95, 0.99))})
    best = max(cuts, key=lambda c: (gain(lambda r: r[2] is not None and r[2] >= c), -c))
    assert got["g"] == (pytest.approx(best), pytest.approx(gain(lambda r: r[2] is not None and r[2] >= best), abs=1e-6))
    assert got["f"] == (1.0, pytest.approx(gain(lambda r: r[3] >= 1), abs=1e-6))
    assert got["z"] == (0.0, pytest.approx(gain(lambda r: r[4] == 0), abs=1e-6))
    assert seen.value == len(data)
