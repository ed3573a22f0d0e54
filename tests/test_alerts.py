"""Anchored de-duplication, campaigns and as-of matches against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators.asof import first_match
from logwarden.operators.components import connected_components
from logwarden.operators.dedup import anchors
from logwarden.catalog import alert_queries
from logwarden.plans import alerts as al
from logwarden.plans import campaigns as cp
from logwarden.plans import hybrid as hy

from helpers import D, H


@pytest.mark.parametrize("chunk,slice_rows", [(None, 10_000), (1_000, 10_000), (137, 40)])
def test_anchored_groups(spark, chunk, slice_rows):
    rng = random.Random(5)
    rows = [(i, rng.randrange(0, 20_000), rng.choice("aab")) for i in range(400)]
    frame = spark.createDataFrame(rows, "row_id bigint, t bigint, k string")
    got = {r["row_id"]: r["anchor_t"] for r in anchors(frame, ["k"], 100, chunk_us=chunk, slice_rows=slice_rows).collect()}
    for key in "ab":
        anchor = None
        for i, t, _ in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[0])):
            if anchor is None or t > anchor + 100:
                anchor = t
            assert got[i] == anchor


def test_short_keys_are_folded_like_long_ones(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 3_000), rng.choice(["hot", f"k{rng.randrange(60)}"])) for i in range(600)]
    frame = spark.createDataFrame(rows, "row_id bigint, t bigint, k string")
    by_fold, by_chunk, mixed = (
        {r["row_id"]: r["anchor_t"] for r in anchors(frame, ["k"], 100, chunk_us=500, fold_times=n).collect()} for n in (2_000, 0, 50)
    )
    assert by_fold == by_chunk == mixed and len(mixed) == 600


@pytest.mark.parametrize("slice_rows", [10_000, 15])
def test_messages_count_the_repeats_of_their_group(spark, slice_rows):
    rng = random.Random(9)
    minute = 60_000_000
    rows = [(i, rng.randrange(0, 60) * minute, rng.choice([None, 1, 2]), "10.0.0.1", rng.choice([None, "guessing", "automation"])) for i in range(80)]
    out = al.with_occurrences(spark.createDataFrame(rows, "row_id bigint, t bigint, uid bigint, ip string, family string"), slice_rows=slice_rows)
    facts = F.array().cast("array<struct<rank:int,attribute:string,new_value:string,usual_value:string,usual_count:bigint>>")
    hit = "array(struct('brute_force' AS rule_id, 'ip' AS scope, map('fails', '7', 'distinct_ips', null) AS evidence))"
    parts = "array(struct('brute_force' AS source, 'brute_force' AS label, 0.3D AS weight, 'rule' AS group), struct('ml' AS source, 'model' AS label, 0.1D AS weight, 'ml' AS group))"
    out = out.withColumns({"novelty": facts, "score": F.lit(40), "action": F.lit("alert"), "confidence": F.lit(0.3), "hits": F.expr(hit), "contributions": F.expr(parts)})
    got = {r["row_id"]: r["message"] for r in hy.with_hit_texts(out).select("row_id", al.message(F.col("occurrences")).alias("message")).collect()}
    groups = {}
    for i, t, uid, ip, family in sorted(rows, key=lambda r: (r[1], r[0])):
        first, n = groups.get((uid or ip, family), (None, 0))
        if family is None:
            n = 0
        elif first is None or t > first + 15 * minute:
            first, n = t, 0
        groups[(uid or ip, family)] = first, n + 1
        want = "Risk 40/100, suggested action 'alert': Many failures on one name by ip: fails 7 (30%); model (10%)."
        want += f" Suggested family: {family} (30%)." if family else ""
        assert got[i] == want + (f" Repeated {n + 1} times within 15 minutes." if n else "")
    assert len(got) == 80


def test_alert_message_names_repeats_and_evidence(spark, sf):
    merged = {r["alert_id"]: r["occurrences"] for r in alert_queries.alert_dedup(spark, sf).collect()}
    found = [r["message"] for r in alert_queries.alert_message(spark, sf).collect()]
    assert len(found) == sum(merged.values())
    for n in range(1, max(merged.values()) + 1):
        said = sum("Repeated" not in m for m in found) if n == 1 else sum(f" Repeated {n} times within" in m for m in found)
        assert said == sum(o >= n for o in merged.values())
    assert any(": fails " in m for m in found)


def test_priority_counts_novel_facets(spark, sf):
    novel = {}
    for r in alert_queries.novelty(spark, sf).collect():
        novel[r["row_id"]] = novel.get(r["row_id"], 0) + 1
    plain = {r["row_id"]: (r["uid"], r["confidence"]) for r in alert_queries.alert_rows(spark, sf).select("row_id", "uid", "confidence").collect()}
    got = {r["row_id"]: r["priority"] for r in alert_queries.alert_priority(spark, sf).collect()}
    assert got.keys() == plain.keys() and {novel.get(i, 0) for i in got} >= {0, 1}
    for i, (uid, confidence) in plain.items():
        importance = 1.0 if uid is None else 1.0 + uid % 3
        assert got[i] == pytest.approx((1 + novel.get(i, 0)) * confidence * importance, abs=5.1e-5)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[500] == 500


def test_campaigns_equal_pairwise_linking(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 30) * H, rng.randrange(5), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3, 4, 5])) for i in range(80)]
    out = cp.correlate(spark.createDataFrame(rows, "row_id bigint, t bigint, uid bigint, ip string, asn bigint"), [2 * H], slice_rows=10)
    got = {r["row_id"]: r["campaign"] for r in out.collect()}
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            shared = (a[3] is not None and a[3] == b[3]) or (a[4] is not None and a[4] == b[4])
            if shared and abs(a[1] - b[1]) <= 2 * H:
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(80)}


@pytest.mark.parametrize("slice_rows", [10_000, 25])
def test_first_foreign_match(spark, slice_rows):
    rng = random.Random(8)
    rows = [(i, rng.randrange(0, 60) * H // 4, rng.randrange(3), rng.choice("xy")) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, t bigint, uid bigint, country string")
    got = {r["anchor_id"]: (r["donor_id"], r["tier"]) for r in first_match(df, df, same=["country"], horizons=[H, D], slice_rows=slice_rows).collect()}
    for a in rows:
        later = sorted((b[1], b[0]) for b in rows if b[3] == a[3] and b[2] != a[2] and a[1] < b[1] <= a[1] + D)
        want = (later[0][1], 1 if later[0][0] <= a[1] + H else 2) if later else (None, None)
        assert got[a[0]] == want
