"""Rule boundaries, configuration and label safety."""

import pytest
from pyspark.sql import functions as F

from logwarden.plans import blocklist as bl
from logwarden.plans import hybrid as hy
from logwarden.plans import rules as R
from logwarden.functions.scoring import Bands, noisy_or

from helpers import D, H, S, T0, attempt, frame, random_log


def fired(spark, rows, rule_id, intel=R.Intel(), params=None, **kw):
    config = R.Config.from_dict({"rules": {rule_id: {"params": params}}}) if params else None
    out = R.hits(R.evaluate(frame(spark, rows), R.Plan.of(config, [rule_id]), intel, **kw))
    return sorted(r["row_id"] for r in out.collect())


def test_brute_force_window_is_open_at_the_old_end(spark):
    exact = [attempt(i, i * 75 * S) for i in range(5)]  # fifth failure exactly 300 s after the first
    assert fired(spark, exact, "brute_force") == []
    inside = [attempt(i, i * 75 * S) for i in range(4)] + [attempt(4, 300 * S - 1)]
    assert fired(spark, inside, "brute_force") == [4]


def test_simultaneous_attempts_count_in_stream_order(spark):
    rows = [attempt(i, 0) for i in range(6)]
    assert fired(spark, rows, "brute_force") == [4, 5]
    assert fired(spark, rows, "brute_force", slice_rows=2) == [4, 5]


def test_stuffing_relaxes_under_user_agent_rotation(spark):
    rows = [attempt(i, i * S, username=f"n{i % 3}", ua=f"agent{i % 4}", asn=None) for i in range(6)]
    assert fired(spark, rows, "credential_stuffing") == [4, 5]
    same = [attempt(i, i * S, username=f"n{i % 3}", asn=None) for i in range(6)]
    assert fired(spark, same, "credential_stuffing") == []


def test_rhythm_and_scripted_client(spark):
    rows = [attempt(i, i * 5 * S) for i in range(10)]
    assert fired(spark, rows, "regular_rhythm") == [9]
    uneven = [attempt(i, i * i * 2 * S) for i in range(10)]
    assert fired(spark, uneven, "regular_rhythm") == []
    uas = [attempt(0, 0, ua=" "), attempt(1, 1, ua="CURL/8"), attempt(2, 2, ua="Mozilla")]
    assert fired(spark, uas, "scripted_client") == [0, 1]


def test_impossible_travel_needs_both_places(spark):
    rows = [attempt(0, 0, country="C0"), attempt(1, H, country="C2"), attempt(2, 2 * H, country=None), attempt(3, 3 * H, country="C0"), attempt(4, 3 * H, country="C2")]
    assert fired(spark, rows, "impossible_travel") == [1]


def test_dormant_account_needs_a_change(spark):
    rows = [attempt(0, 0, success=True), attempt(1, 91 * D, success=True), attempt(2, 190 * D, success=True, country="C3")]
    assert fired(spark, rows, "dormant_account_login") == [2]


def test_skips_carry_a_reason(spark):
    ev = R.evaluate(frame(spark, [attempt(0, 0, uid=None, ua=None, country=None)]), R.Plan.of(), R.Intel())
    got = {r["rule_id"]: r["reason"] for r in R.skipped(ev).collect()}
    assert got["success_after_failures"] == "account unknown" and got["tor_exit"] == "tor list not loaded" and got["ua_rotation"] == "user agent missing"


def test_labels_never_change_hits(spark):
    rows = [attempt(i, i * S, username=f"n{i % 7}") for i in range(40)]
    flipped = [(*r[:12], True, True) for r in rows]
    a = R.hits(R.evaluate(frame(spark, rows))).select("row_id", "rule_id").collect()
    b = R.hits(R.evaluate(frame(spark, flipped))).select("row_id", "rule_id").collect()
    assert sorted(a) == sorted(b) and a


def test_configuration_is_validated():
    R.Plan.of()
    for bad in (
        {"rule": {}}, {"rules": {"nope": {}}}, {"rules": {"brute_force": {"mode": "loud"}}}, {"rules": {"brute_force": {"params": {"threshold": 1}}}},
        {"rules": {"brute_force": {"params": {"thresholds": 5}}}}, {"rules": {"brute_force": {"params": {"threshold": 5.5}}}}, {"rules": {"brute_force": {"x": 1}}},
    ):
        with pytest.raises(R.ConfigError):
            R.Config.from_dict(bad)


def test_blocklist_priority_and_expiry(spark):
    entries = spark.createDataFrame(
        [("ip", "10.0.0.1", "a", "x", T0 + 10), ("cidr", "10.0.0.0/30", "b", "x", None), ("username", "u1", "c", "x", None), ("asn", "100", "d", "x", None)],
        "kind string, value string, reason string, added_by string, expires_at bigint",
    )
    rows = [attempt(0, 9), attempt(1, 10), attempt(2, 11, ip="9.9.9.9", asn=None, username="U1"), attempt(3, 12, ip="2001:db8::1")]
    got = {r["row_id"]: r["kind"] for r in bl.match(frame(spark, rows), entries).collect()}
    assert got == {0: "ip", 1: "cidr", 2: "username", 3: "asn"}


def test_hybrid_override_and_rounding(spark):
    df = spark.range(1).select(F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5)).alias("p"))
    assert df.select(noisy_or(F.col("p"))).first()[0] == 0.75
    entries = spark.createDataFrame([("username", "u1", "c", "x", None)], "kind string, value string, reason string, added_by string, expires_at bigint")
    ev = R.evaluate(frame(spark, [attempt(0, 0)]), R.Plan.of(None, ["blocklist_hit"]), R.Intel(blocklist=entries)).withColumn("ml_probability", F.lit(0.125))
    r = hy.combine(ev, hy.Weights()).first()
    assert (r["score"], r["action"], r["overridden_by"]) == (100, "lock", "blocklist_hit")
    with pytest.raises(ValueError):
        Bands(50, 40, 90)


@pytest.mark.parametrize("slice_rows", [10_000, 150])
def test_large_sprays_do_not_go_silent(spark, slice_rows):
    rows = [attempt(i, i * 60 * S, username=f"n{i}", asn=None) for i in range(700)]
    assert fired(spark, rows, "password_spray_slow", slice_rows=slice_rows) == list(range(14, 700))


def test_profile_merges_chosen_rungs(spark):
    from logwarden.plans import ladders as ld

    picks = spark.createDataFrame([("brute_force", 4), ("credential_stuffing/ip", 2), ("credential_stuffing/asn", 1), ("password_spray_slow/asn", 3), ("country_hop", 2), ("scripted_client", 1), ("dormant_account_login", 1)], "ladder string, rung int")
    rows = {r.rule_id: r for r in ld.profile(spark, picks).collect()}
    assert len(ld.LADDERS) == 14 and rows["brute_force"].params == {"threshold": 6.0}
    # the network scope is left out of profiles, so it is off
    assert rows["credential_stuffing"].params == {"min_fails": 6.0, "min_users": 3.0, "asn_min_fails": 1e6, "asn_min_users": 1e6}
    assert rows["password_spray_slow"].params == {"asn_min_users": 60.0, "min_users": 1e5}
    assert rows["ua_rotation"].mode == "shadow" and rows["dormant_account_login"].mode == "shadow" and rows["country_hop"].mode == "shadow"
    assert rows["scripted_client"].mode == "enforce"
    R.Config.from_dict(ld.as_config([*rows.values()]))


def test_no_step_writes_whole_attempts(spark, monkeypatch):
    """Hot keys are cut on the columns their family needs; the attempts themselves are not written again and again."""
    from logwarden.operators import running, slicing, sweep

    written, settle = [], slicing.settle
    for module in (running, slicing, sweep):
        monkeypatch.setattr(module, "settle", lambda df: written.append(set(df.columns)) or settle(df))
    attempts = frame(spark, random_log(120))
    whole = {r["row_id"]: sorted(h["rule_id"] for h in r["hits"]) for r in R.evaluate(attempts).collect()}
    assert not written
    cut = {r["row_id"]: sorted(h["rule_id"] for h in r["hits"]) for r in R.evaluate(attempts, slice_rows=30).collect()}
    assert cut == whole
    assert written and not any({"username", "ua"} <= columns or {"asn", "ua_hash"} <= columns for columns in written)
