"""A finite stream gives the batch answer."""

import random
import tempfile

from pyspark.sql import functions as F

from logwarden.operators.dedup import anchors
from logwarden.operators.sweep import Count, Distinct, sweep
from logwarden.plans import rules as R
from logwarden.streaming import rules as sr
from logwarden.streaming import sliding as sl
from logwarden.streaming import state as ss
from logwarden.streaming import views as sv

from helpers import D, H, S, SCHEMA, T0, attempt, frame


def log():
    return [attempt(i, i * 7 * S + (i % 3), username=f"n{i % 6}", uid=i % 4 or None, ip=f"10.0.0.{i % 2}", success=i % 5 == 0) for i in range(120)]


def feed(spark, rows, parts=4):
    """Write the log as consecutive files."""
    path = tempfile.mkdtemp(prefix="logwarden-stream-")
    step = -(-len(rows) // parts)
    for i in range(parts):
        frame(spark, rows[i * step : (i + 1) * step]).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", tempfile.mkdtemp(prefix="logwarden-ck-")).start().awaitTermination(180)
    return df.sparkSession.table(name)


def swept(spark, rows, key, window):
    fail = ~F.col("success")
    want = sweep(frame(spark, rows), key, [Count("f", window, fail), Count("o", window, F.col("success")), Distinct("n", window, F.col("username"), fail)])
    return {r["row_id"]: (r["f"], r["o"], r["n"]) for r in want.collect()}


def counted(spark, rows, key, window, name, feeds=4, **options):
    """The stream's answers; a last attempt far in the future lets the watermark pass all others."""
    end = attempt(10**6, max(r[1] for r in rows) - T0 + 30 * D, username="end", ip="10.9.9.9", success=True)
    path = feed(spark, rows, feeds)
    frame(spark, [end]).coalesce(1).write.mode("append").parquet(path)
    stream = sv.read_attempt_stream(spark, path, SCHEMA)
    out = drain(sl.sliding_counts(stream, key, window, **options), name).collect()
    assert len(out) == len({r["row_id"] for r in out})
    return {r["row_id"]: (r["fails"], r["oks"], r["names"]) for r in out}


def test_sliding_state_equals_sweep(spark):
    assert counted(spark, log(), "ip", 300 * S, "sliding") == swept(spark, log(), "ip", 300 * S)


def test_sliding_state_with_late_rows_and_a_hot_key(spark):
    """Rows up to 50 s late, ties, expiring names, and one address with two thirds of the rows, split in nine cells."""
    rng = random.Random(4)
    rows = [attempt(i, 2 * i * S + rng.randrange(2), username=f"n{rng.randrange(40)}", ip="10.0.0.1" if rng.random() < 0.66 else f"10.0.0.{i % 5}", success=rng.random() < 0.2) for i in range(300)]
    rows += [attempt(1_000 + i, 2 * (i + 40) * S, username=f"late{i % 7}", ip="10.0.0.1") for i in range(0, 200, 9)]
    rows.sort(key=lambda r: r[1] + (rng.randrange(50) * S if rng.random() < 0.4 else 0))
    want = swept(spark, rows, "ip", 90 * S)
    for name, hot in (("whole", ()), ("split", ("10.0.0.1",))):
        assert counted(spark, rows, "ip", 90 * S, name, feeds=5, hot=hot, parts=3) == want


def test_alert_groups_equal_batch(spark):
    rows = log()
    shape = lambda df: df.withColumns({"dedup_key": F.col("ip"), "family": F.lit("x"), "score": F.lit(50)})
    stream = shape(sv.read_attempt_stream(spark, feed(spark, rows), SCHEMA))
    got = {r["row_id"]: r["anchor_t"] for r in drain(ss.alert_groups(stream, 100 * S), "groups").collect()}
    want = anchors(shape(frame(spark, rows)), ["dedup_key", "family"], 100 * S)
    assert got == {r["row_id"]: r["anchor_t"] for r in want.collect()}


def test_rule_stream_equals_batch(spark):
    rows = log()
    plan = R.Plan.of(None, ["brute_force", "credential_stuffing", "success_after_failures"])
    out, hist = tempfile.mkdtemp(prefix="logwarden-hits-"), tempfile.mkdtemp(prefix="logwarden-log-")
    stream = sv.read_attempt_stream(spark, feed(spark, rows), SCHEMA).drop("ts")
    sr.start(stream, sr.RuleStream(hist, out, plan), tempfile.mkdtemp(prefix="logwarden-ck-")).awaitTermination(240)
    got = sorted((r["row_id"], r["rule_id"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["row_id"], r["rule_id"]) for r in R.hits(R.evaluate(frame(spark, rows), plan)).collect())
    assert got == want and got


def test_rule_stream_remembers_accounts_and_networks(spark):
    """120 days in six batches: dormant accounts, rare networks and travel need the whole past."""
    rows = [attempt(i, i * D, uid=i % 4, username=f"n{i % 4}", ip=f"10.0.{i % 3}.1", asn=100 if i % 29 else 7, country=f"C{(i // 40) % 3}", ua=f"a{i // 50}", success=True) for i in range(120)]
    rows += [attempt(200, 119 * D + H, uid=9, username="n9", success=True, country="C0"), attempt(201, 3 * D + 5, uid=9, username="n9", success=True, country="C1")]
    rows.sort(key=lambda r: r[1])
    config = R.Config.from_dict({"rules": {"rare_network_login": {"params": {"max_share": 0.01, "min_total": 100}}}})
    plan = R.Plan.of(config, ["dormant_account_login", "rare_network_login", "impossible_travel", "brute_force"])
    out, hist = tempfile.mkdtemp(prefix="logwarden-hits-"), tempfile.mkdtemp(prefix="logwarden-log-")
    handler = sr.RuleStream(hist, out, plan)
    for k in range(6):
        part = rows[k * 21 : (k + 1) * 21]
        if part:
            handler(frame(spark, part), k)
    got = sorted((r["row_id"], r["rule_id"]) for r in spark.read.parquet(out).collect())
    want = sorted((r["row_id"], r["rule_id"]) for r in R.hits(R.evaluate(frame(spark, rows), plan)).collect())
    assert got == want and (200, "dormant_account_login") in got


def _long_log():
    """120 days: busy accounts with bursts of failures, dormant accounts, changing networks, countries and devices."""
    rng = random.Random(9)
    rows = []
    for d in range(120):
        for k in range(4):
            u = rng.randrange(8)
            rows.append(attempt(len(rows), d * D + rng.randrange(D), uid=u, username=f"n{u}", ip=f"203.0.{rng.randrange(3)}.{rng.randrange(4)}", asn=rng.choice([100, 100, 200, None, 300 + d // 30]), country=f"C{rng.randrange(2) + (d > 100)}", ua=f"Mozilla/5.0 ua{u % 3 + d // 60}", success=rng.random() < 0.7))
        if d % 10 == 0:
            start = d * D + rng.randrange(D // 2)
            rows += [attempt(len(rows) + i, start + 10 * i * S, uid=None if i % 3 else 1, username=f"g{i % 12}", ip="203.0.9.9", asn=7, country=None, ua="curl/8" if i % 2 else f"ua{i}", success=i == 23) for i in range(24)]
    rows += [attempt(5_000, 2 * D, uid=77, username="old", success=True, country="C0", ua="Mozilla/5.0 a"), attempt(5_001, 118 * D, uid=77, username="old", success=True, country="C3", ua="Mozilla/5.0 b")]
    return sorted(rows, key=lambda r: r[1])


def test_rule_stream_keeps_histories(spark):
    """All nineteen rules over 120 days in six batches: equal to batch, and a late batch reads no more than an early one."""
    rows = _long_log()
    config = R.Config.from_dict({"rules": {"rare_network_login": {"params": {"max_share": 0.01, "min_total": 100}}}})
    plan = R.Plan.of(config)
    networks = [("tor", "203.0.1.0/30"), ("datacenter", "203.0.2.0/31"), ("vpn", "203.0.0.3/32")]

    def intel(s):
        return R.Intel(s.createDataFrame(networks, "list string, cidr string"), ("tor", "datacenter", "vpn"))

    out, state = tempfile.mkdtemp(prefix="logwarden-hits-"), tempfile.mkdtemp(prefix="logwarden-state-")
    handler, seen = sr.RuleStream(state, out, plan, intel), []
    context = handler.context
    handler.context = lambda *a: (lambda got: seen.append(got[0].count()) or got)(context(*a))
    step = -(-len(rows) // 6)
    for k in range(6):
        handler(frame(spark, rows[k * step : (k + 1) * step]), k)
        if k == 3:
            handler(frame(spark, rows[k * step : (k + 1) * step]), k)  # a rerun after a failure
    got = sorted((r["row_id"], r["rule_id"], str(r["evidence"])) for r in spark.read.parquet(out).collect())
    want = sorted((r["row_id"], r["rule_id"], str(r["evidence"])) for r in R.hits(R.evaluate(frame(spark, rows), plan, intel(spark))).collect())
    assert got == want and len({r[1] for r in got}) >= 12 and (5_001, "dormant_account_login") in {r[:2] for r in got}
    assert seen[-1] < len(rows) / 2 and max(seen[4:]) <= 1.25 * max(seen[1:3])


def test_rule_stream_takes_rows_older_than_its_versions(spark):
    """A success 30 days late makes the versions after it invalid; later batches know it."""
    plan = R.Plan.of(None, ["dormant_account_login"])
    out, state = tempfile.mkdtemp(prefix="logwarden-hits-"), tempfile.mkdtemp(prefix="logwarden-state-")
    handler = sr.RuleStream(state, out, plan)
    say = lambda i, day, **kw: attempt(i, day * D, uid=5, success=True, ua="Mozilla/5.0 a", **kw)
    handler(frame(spark, [say(1, 0, country="C0"), say(2, 60, country="C0")]), 0)
    handler(frame(spark, [attempt(3, 75 * D, uid=6)]), 1)
    handler(frame(spark, [say(4, 30, country="C9")]), 2)
    handler(frame(spark, [attempt(5, 100 * D, uid=6)]), 3)
    handler(frame(spark, [say(6, 155, country="C9"), say(7, 250, country="C1")]), 4)
    assert {r["row_id"] for r in spark.read.parquet(out).collect()} == {7}


def test_list_edit_takes_effect(spark):
    lists = [[("tor", "10.0.0.1/32")], [("tor", "10.0.0.2/32")]]
    now = []
    handler = sr.RuleStream(tempfile.mkdtemp(prefix="logwarden-state-"), tempfile.mkdtemp(prefix="logwarden-hits-"), R.Plan.of(None, ["tor_exit"]), lambda s: R.Intel(s.createDataFrame(now[-1], "list string, cidr string"), ("tor",)))
    for k in range(2):
        now.append(lists[k])
        handler(frame(spark, [attempt(10 * k + i, (10 * k + i) * S, ip=f"10.0.0.{i}") for i in (1, 2)]), k)
    assert {r["row_id"] for r in spark.read.parquet(handler.hits_path).collect()} == {1, 12}


def test_tumbling_view_and_unique_hits(spark):
    rows = log()
    stream = sv.read_attempt_stream(spark, feed(spark, rows + rows[-5:]), SCHEMA)
    hits = sv.unique_hits(stream.withColumn("rule_id", F.lit("r")).select("ts", "row_id", "rule_id"))
    assert drain(hits, "uniq").count() == len(rows)
    path = feed(spark, rows)
    frame(spark, [attempt(10**6, D)]).coalesce(1).write.mode("append").parquet(path)
    view = drain(sv.tumbling_failures(sv.read_attempt_stream(spark, path, SCHEMA), "ip"), "tumble")
    got = {(r["window_start"].timestamp(), r["key"]): (r["attempts"], r["fails"]) for r in view.withColumn("window_start", F.col("window_start")).collect()}
    want = {}
    for r in rows:
        at = want.setdefault((r[1] // (300 * S) * 300.0, r[4]), [0, 0])
        at[0] += 1
        at[1] += not r[11]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_progress_percentiles():
    p = sv.Progress()
    p.durations = list(range(1, 101))
    assert p.percentiles() == {"p50": 50.0, "p95": 95.0, "p99": 99.0}
