"""Sweep windows against a brute-force reading, with and without hot-key slicing."""

import pytest
from pyspark.sql import functions as F

from logwarden.catalog import event_queries
from logwarden.operators.quantile import exact_quantiles
from logwarden.operators.recent import sliding_values
from logwarden.operators.running import Running, previous_row, running
from logwarden.operators.sequence import last_n
from logwarden.operators.slicing import bucket_of
from logwarden.operators.sweep import Count, Distinct, Latest, Streak, sweep

from helpers import D, H, T0, attempt, frame, random_log

ROWS = random_log()
NAMES = ["row_id", "t", "uid", "username", "ip", "asn", "country", "ua", "browser", "os", "device_type", "success"]
LOG = [dict(zip(NAMES, r)) for r in ROWS]


def seen(row, boundary, w):
    for e in LOG:
        if e["ip"] != row["ip"]:
            continue
        if boundary == "open" and row["t"] - w < e["t"] < row["t"]:
            yield e
        elif boundary == "closed" and row["t"] - w <= e["t"] < row["t"]:
            yield e
        elif boundary == "trailing" and e["t"] > row["t"] - w and (e["t"], e["row_id"]) <= (row["t"], row["row_id"]):
            yield e


@pytest.mark.parametrize("slice_rows", [10_000, 60])
@pytest.mark.parametrize("boundary", ["open", "closed", "trailing"])
def test_sweep_matches_brute_force(spark, boundary, slice_rows):
    fail = ~F.col("success")
    out = sweep(
        frame(spark, ROWS), "ip",
        [Count("n1", H), Count("n24", D), Count("f24", D, fail), Distinct("u24", D, F.col("uid")), Distinct("fu", H, F.col("username"), fail)],
        boundary=boundary, slice_rows=slice_rows,
    )
    got = {r["row_id"]: r for r in out.collect()}
    assert len(got) == len(LOG)
    for e in LOG:
        day, hour = list(seen(e, boundary, D)), list(seen(e, boundary, H))
        want = (
            len(hour), len(day), sum(not x["success"] for x in day), len({x["uid"] for x in day if x["uid"] is not None}),
            len({x["username"] for x in hour if not x["success"]}),
        )
        r = got[e["row_id"]]
        assert (r["n1"], r["n24"], r["f24"], r["u24"], r["fu"]) == want, e


@pytest.mark.parametrize("slice_rows", [10_000, 40])
def test_streak_latest_and_null_key(spark, slice_rows):
    out = sweep(frame(spark, ROWS), "uid", [Streak("streak", F.col("success")), Latest("last", F.col("t"))], boundary="open", slice_rows=slice_rows)
    got = {r["row_id"]: r for r in out.collect()}
    for e in LOG:
        r = got[e["row_id"]]
        if e["uid"] is None:
            assert r["streak"] is None and r["last"] is None
            continue
        past = [x for x in LOG if x["uid"] == e["uid"] and x["t"] < e["t"]]
        ok = max((x["t"] for x in past if x["success"]), default=None)
        assert r["streak"] == sum(ok is None or x["t"] > ok for x in past)
        assert r["last"] == max((x["t"] for x in past), default=None)


@pytest.mark.parametrize("slice_rows", [10_000, 50])
def test_global_running_total_and_previous_row(spark, slice_rows):
    df = frame(spark, ROWS)
    out = running(df, [], ["t", "row_id"], [Running("pos", "sum", F.lit(1), "through_row")], slice_rows=slice_rows)
    order = sorted((e["t"], e["row_id"]) for e in LOG)
    assert {r["row_id"]: r["pos"] for r in out.collect()} == {rid: i + 1 for i, (_, rid) in enumerate(order)}
    prev = previous_row(df, ["ip"], ["t", "row_id"], ["country"], slice_rows=slice_rows)
    got = {r["row_id"]: r["prev"] and r["prev"]["row_id"] for r in prev.collect()}
    for e in LOG:
        before = [(x["t"], x["row_id"]) for x in LOG if x["ip"] == e["ip"] and (x["t"], x["row_id"]) < (e["t"], e["row_id"])]
        assert got[e["row_id"]] == (max(before)[1] if before else None)


@pytest.mark.parametrize("slice_rows", [10_000, 30])
def test_last_n_and_sliding_values(spark, slice_rows):
    df = frame(spark, ROWS)
    out = last_n(df, "ip", 5, name="ts", when=~F.col("success"), slice_rows=slice_rows)
    got = {r["row_id"]: r["ts"] for r in out.collect()}
    vals = sliding_values(df, "ip", F.col("country"), D, limit=2, when=F.col("success"), slice_rows=slice_rows)
    recent = {r["row_id"]: r["values"] for r in vals.collect()}
    for e in LOG:
        upto = sorted((x for x in LOG if x["ip"] == e["ip"] and (x["t"], x["row_id"]) <= (e["t"], e["row_id"])), key=lambda x: (x["t"], x["row_id"]))
        want = None if e["success"] else [x["t"] for x in upto if not x["success"]][-5:]
        assert got[e["row_id"]] == want
        order = []
        for x in upto:
            if x["success"] and x["country"] is not None and x["t"] > e["t"] - D:
                order = [v for v in order if v != x["country"]] + [x["country"]]
        assert recent[e["row_id"]] == list(reversed(order))[:2]


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("slice_rows", [10_000, 10])
def test_sliding_values_order_ties_by_row(spark, slice_rows, limit):
    rows = [attempt(i, (i // 4) * 1_000_000, country=f"C{(i * 7) % 5}", success=True) for i in range(60)]
    out = sliding_values(frame(spark, rows), "ip", F.col("country"), D, limit=limit, slice_rows=slice_rows)
    for r in out.collect():
        order = []
        for i in range(r["row_id"] + 1):
            v = f"C{(i * 7) % 5}"
            order = [x for x in order if x != v] + [v]
        assert r["values"] == order[::-1][:limit]


def test_window_edges(spark):
    rows = [attempt(0, 0), attempt(1, H - 1), attempt(2, H), attempt(3, H + 1)]
    for boundary, want in (("open", [0, 1, 1, 2]), ("closed", [0, 1, 2, 2]), ("trailing", [1, 2, 2, 3])):
        out = sweep(frame(spark, rows), "ip", [Count("n", H)], boundary=boundary).orderBy("row_id").collect()
        assert [r["n"] for r in out] == want, boundary


def test_empty_and_borders(spark):
    assert sweep(frame(spark, []), "ip", [Count("n", H)]).count() == 0
    borders = [3, 7, 7 + 5, 40]
    got = spark.range(0, 50).select("id", bucket_of(F.col("id"), borders).alias("b")).collect()
    assert all(r["b"] == sum(b <= r["id"] for b in borders) for r in got)


@pytest.mark.parametrize("slice_rows", [10_000, 7])
def test_exact_quantiles(spark, slice_rows):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=101), 1)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["q"] for r in exact_quantiles(df, "k", "v", [0.0, 0.1, 0.5, 0.95, 1.0], slice_rows=slice_rows).collect()}
    assert np.allclose(got["a"], np.quantile(values, [0, 0.1, 0.5, 0.95, 1.0]))
    assert got["b"] == [1.0] * 5


def test_log_integrity_sees_failed_attempts(spark, monkeypatch):
    """Gaps and backward steps planted among failed attempts."""
    times = {0: 0, 1: 10, 2: 20, 3: 12, 4: 30, 7: 40, 8: 35, 9: 50, 11: 60}
    rows = [attempt(i, t, success=i in (0, 4, 9)) for i, t in times.items()]
    monkeypatch.setattr(event_queries, "read_attempts", lambda spark, sf: frame(spark, rows))
    assert tuple(event_queries.log_integrity_all(spark, "").first()) == (9, 0, 11, 3, 2, 2, 8, False)
