"""Nearest reference logins against brute force."""

import time

import numpy as np
import pytest

from logwarden.catalog import model_queries
from logwarden.plans import models as md


def plain(x, ref, k):
    """Every distance of every row, then the k smallest."""
    out = []
    for i in range(0, len(x), 1024):
        b = x[i : i + 1024]
        d2 = np.maximum((b**2).sum(axis=1)[:, None] + (ref**2).sum(axis=1)[None, :] - 2.0 * b @ ref.T, 0.0)
        kk = min(k, len(ref))
        out.append(np.sqrt(np.partition(d2, kk - 1, axis=1)[:, :kk]).mean(axis=1))
    return np.concatenate(out)


@pytest.mark.parametrize("n_ref", [1, 5, 9, 250, 256, 257, 3_001])
@pytest.mark.parametrize("kind", ["even", "copies", "far"])
def test_nearest_match_brute_force(n_ref, kind):
    rng = np.random.default_rng(n_ref)
    ref, x = rng.normal(size=(n_ref, 12)), rng.normal(size=(300, 12))
    if kind == "copies":  # many equal distances: single precision cannot tell them apart
        ref, x = np.round(ref[rng.integers(0, n_ref, n_ref) % 7 % n_ref]), np.round(x)
    elif kind == "far":  # beyond what single precision holds, and so close that it rounds to nothing
        x[:20] *= 1e20
        x[20:40] = ref[0] + 1e-6 * x[20:40] + 0.0
        ref[: n_ref // 2] = ref[0] + 1e-5 * ref[: n_ref // 2]
    got = np.concatenate(list(md._mean_nearest(iter([x[:100], x[100:100], x[100:]]), ref, 10)))
    d = np.sqrt(np.sort(((x[:, None, :] - ref[None, :, :]) ** 2).sum(axis=2), axis=1)[:, :10]).mean(axis=1)
    assert got == pytest.approx(d, rel=1e-9)


def test_no_reference_gives_no_distance():
    assert np.isnan(next(md._mean_nearest(iter([np.ones((3, 2))]), np.empty((0, 2)), 10))).all()


def test_knn_scores_match_brute_force_in_a_fraction_of_the_time(spark, sf):
    df = model_queries.split_rows(spark, sf, only=md.DEFAULT_FEATURES)
    model = md.fit_knn(df.where(f"part = 'train' AND {model_queries.LEGIT}"), md.DEFAULT_FEATURES)
    rows = md.score_knn(model, df).toPandas()
    x = md._matrix(rows, model["features"], model["fill"], model["mean"], model["sd"])
    assert rows["score"].to_numpy() == pytest.approx(plain(x, model["ref"], model["k"]), abs=1e-5)

    rng = np.random.default_rng(1)
    ref, x = rng.normal(size=(30_000, 37)), rng.normal(size=(2_048, 37))
    scored = md.score_knn({"features": [f"f{i}" for i in range(37)], "fill": np.zeros(37), "mean": np.zeros(37), "sd": np.ones(37), "k": 10, "ref": ref}, spark.createDataFrame(x.tolist(), [f"f{i}" for i in range(37)]).coalesce(1).cache())
    scored.agg({"f0": "sum"}).collect()
    start = time.time()
    expected = plain(x, ref, 10)
    once = time.time() - start
    start = time.time()
    got = np.array([r["score"] for r in scored.select("score").collect()])
    assert got == pytest.approx(expected, abs=1e-5)
    for _ in range(2):
        start = time.time()
        scored.select("score").collect()
        took = time.time() - start
    assert took < once
