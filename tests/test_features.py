"""Point-in-time features: no future leak, subset = full, slicing changes nothing."""

import math

from pyspark.sql import functions as F

from logwarden.plans.features import FEATURES, Options, compute_features

from helpers import D, frame, random_log

ROWS = random_log(280, seed=9)


def table(df):
    return {r["row_id"]: r.asDict() for r in df.collect()}


def same(a, b):
    for name in FEATURES:
        x, y = a[name], b[name]
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (name, x, y)


def test_future_rows_and_labels_do_not_matter_and_slices_agree(spark):
    full = table(compute_features(frame(spark, ROWS)))
    assert len(full) == len(ROWS) and len(FEATURES) == 50
    cut = sorted(r[1] for r in ROWS)[len(ROWS) // 2]
    early = table(compute_features(frame(spark, [r for r in ROWS if r[1] < cut])))
    for rid, row in early.items():
        same(row, full[rid])
    flipped = table(compute_features(frame(spark, [(*r[:12], True, True) for r in ROWS]), opt=Options(slice_rows=40)))
    for rid in full:
        same(flipped[rid], full[rid])
    ids = frame(spark, ROWS).where("row_id % 5 = 0").select("row_id")
    subset = table(compute_features(frame(spark, ROWS), ids))
    assert set(subset) == {r[0] for r in ROWS if r[0] % 5 == 0}
    for rid, row in subset.items():
        same(row, full[rid])


def test_against_plain_reading(spark):
    got = table(compute_features(frame(spark, ROWS)))
    names = ["row_id", "t", "uid", "username", "ip", "asn", "country", "ua", "browser", "os", "device_type", "success"]
    log = [dict(zip(names, r)) for r in ROWS]
    for e in log:
        f = got[e["row_id"]]
        past = [x for x in log if x["t"] < e["t"]]
        ok = [x for x in past if x["success"] and x["uid"] is not None]
        p = (sum((x["country"] or "∅") == (e["country"] or "∅") for x in ok) + 1) / (len(ok) + 1)
        assert math.isclose(f["rare_country"], -math.log(p), abs_tol=1e-12)
        if e["uid"] is None:
            assert f["u_n_attempts"] is None and f["new_ip"] is None and f["llr_sum"] is None
        else:
            mine = [x for x in past if x["uid"] == e["uid"]]
            assert f["u_n_attempts"] == len(mine)
            assert f["new_ip"] == float(not any(x["success"] and x["ip"] == e["ip"] for x in mine))
            own = sum(x["success"] and (x["country"] or "∅") == (e["country"] or "∅") for x in mine)
            n = sum(x["success"] for x in mine)
            assert math.isclose(f["llr_country"], math.log(p) - math.log((own + p) / (n + 1)), abs_tol=1e-12)
        near = [x for x in past if x["ip"] == e["ip"] and x["t"] > e["t"] - D]
        assert f["ip_attempts_24h"] == len(near)
        assert f["ip_fail_ratio_24h"] == (sum(not x["success"] for x in near) / len(near) if near else None)
        if e["asn"] is None:
            assert f["asn_attempts_1h"] is None


def test_value_counts_write_no_row_per_attribute(spark, monkeypatch):
    """Popular values are cut by time slices; attempts are not unpivoted and written for it."""
    from logwarden.operators import running, slicing
    from logwarden.plans import features as ft

    written, settle = [], slicing.settle
    for module in (running, slicing, ft):
        monkeypatch.setattr(module, "settle", lambda df: written.append(df.count() if "row_id" in df.columns else 0) or settle(df), raising=False)
    attempts = frame(spark, random_log(200))
    n = attempts.count()
    whole = sorted(map(tuple, ft.prior_value_counts(attempts).collect()), key=str)
    cut = sorted(map(tuple, ft.prior_value_counts(attempts, ft.Options(slice_rows=60)).collect()), key=str)
    assert cut == whole and len(cut) == n
    assert all(rows <= n for rows in written)


def test_asked_features_equal_those_of_all(spark):
    """Only the measures of the asked features are swept; history stays the whole log."""
    log = frame(spark, ROWS)
    full = table(compute_features(log))
    cut = sorted(r[1] for r in ROWS)[len(ROWS) // 2]
    for names, opt in (
        (["new_os_family", "rare_ip", "u_fail_streak", "ip_distinct_ua_24h", "asn_fail_ratio_24h"], Options(slice_rows=40)),
        (["llr_os", "asn_unknown_share_24h", "u_secs_since_last_success", "cur_success"], Options()),
    ):
        part = compute_features(log, opt=opt, only=names, until=cut)
        assert part.columns == ["row_id", *names]
        got = table(part)
        assert set(got) == {r[0] for r in ROWS if r[1] < cut}
        for rid, row in got.items():
            same({**full[rid], **row}, full[rid])


def test_train_rows_hold_what_is_read(spark, sf):
    from logwarden.catalog.evaluation_queries import train_rows
    from logwarden.plans import models as md

    assert sorted(train_rows(spark, sf).columns) == sorted(["y", "w", *md.CANDIDATE_FLAGS, *md.CANDIDATE_ZERO, *md.CANDIDATE_GE])
