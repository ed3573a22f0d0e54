"""Single-feature cuts, attribution, limits and group selection against plain readings."""

import random

import pytest
from pyspark.sql import functions as F

from logwarden.plans import errors as er
from logwarden.plans import selection as sel

NAN = float("nan")


def feature_table(n=500, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 8 == 0
        missing = rng.choice([None, NAN])
        rows.append((
            "a" if i % 3 else "b", y, float(rng.choice([1, 4, 10])), rng.choice(er.BUCKETS),
            missing if i % 13 == 0 else float(rng.randrange(20) + 6 * y), float(rng.randrange(30) - 9 * y), None,
        ))
    return rows


SCHEMA = "task string, y boolean, w double, bucket string, up double, down double, absent double"


def share(rows, test):
    total = sum(r[2] for r in rows)
    return sum(r[2] for r in rows if test(r)) / total if total else None


def plain_cut(own, col, level):
    """The better side, its cut, and what it flags."""
    neg = [r for r in own if not r[1]]
    total = sum(r[2] for r in neg)
    known = lambda r: r[col] is not None and r[col] == r[col]
    best = None
    for side, sign in (("high", 1), ("low", -1)):
        over = [r[col] * sign for r in neg if known(r) and sum(x[2] for x in neg if known(x) and x[col] * sign >= r[col] * sign) > level * total]
        cut = max(over) * sign if over else None
        hit = lambda r, c=cut, s=sign: known(r) and (c is None or r[col] * s > c * s)
        recall = share([r for r in own if r[1]], hit)
        if best is None or recall > best[2] + 1e-9:
            best = (side, cut, recall, share(neg, hit), hit)
    return best


@pytest.mark.parametrize("slice_rows", [4_000_000, 7])
def test_single_feature_cuts(spark, slice_rows):
    rows = feature_table()
    out = er.single_feature_cuts(spark.createDataFrame(rows, SCHEMA), ["up", "down", "absent"], (0.05, 0.01), slice_rows=slice_rows)
    got = {(r.task, r.feature, r.level): r for r in out.collect()}
    assert len(got) == 12
    for (task, feature, level), r in got.items():
        own = [x for x in rows if x[0] == task]
        side, cut, recall, fpr, hit = plain_cut(own, {"up": 4, "down": 5, "absent": 6}[feature], level)
        assert (r.side, r.cut) == (side, cut)
        assert r.recall == pytest.approx(recall) and r.fpr == pytest.approx(fpr)
        for b in er.BUCKETS:
            assert r[f"recall_{b}"] == pytest.approx(share([x for x in own if x[1] and x[3] == b], hit))
        value = lambda x: -1e9 if x is None or x != x else x
        col = {"up": 4, "down": 5, "absent": 6}[feature]
        pairs = [(p[2] * q[2], (value(p[col]) > value(q[col])) + 0.5 * (value(p[col]) == value(q[col]))) for p in own if p[1] for q in own if not q[1]]  # noqa: B023
        assert r.roc_auc == pytest.approx(sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))
    assert got[("a", "absent", 0.05)].recall == 0 and got[("a", "down", 0.05)].side == "low"


def test_cuts_of_one_class_and_of_nothing(spark):
    one = spark.createDataFrame([("a", False, 1.0, "none", 1.0, 1.0, None)], SCHEMA)
    r = er.single_feature_cuts(one, ["up"], (0.5,)).first()
    assert r.n_pos == 0 and r.recall is None and r.roc_auc is None
    assert er.single_feature_cuts(one.limit(0), ["up"]).count() == 0


def test_attribution_segments_limits(spark):
    rng = random.Random(1)
    rows = [("t" if i % 2 else "u", i % 2 == 1 and i % 5 == 0, float(rng.choice([1, 2])), rng.random() < 0.4, rng.choice("xyz"), rng.choice([None, 5.0, 700.0, 1e7]), rng.randrange(8)) for i in range(300)]
    df = spark.createDataFrame(rows, "task string, y boolean, w double, caught boolean, triggered_by string, gap_s double, n_success int")
    for r in er.attribution(df, ["x", "y", "z"]).collect():
        own = [x for x in rows if x[0] == r.task]
        pos, neg = [x for x in own if x[1]], [x for x in own if not x[1]]
        assert r.fpr == pytest.approx(share(neg, lambda x: x[3]))
        assert r.recall == (pytest.approx(share(pos, lambda x: x[3])) if pos else None)
        parts = pos or neg
        assert [r.by_x, r.by_y, r.by_z] == pytest.approx([share(parts, lambda x, c=c: x[3] and x[4] == c) for c in "xyz"])
    cases = df.where("y")
    seen = {r.segment: r for r in er.segment_recall(cases, {"all": F.lit(True), "deep": F.col("n_success") > 4, "never": F.lit(False)}, ["x", "y", "z"]).collect()}
    assert set(seen) == {"all", "deep"} and seen["all"].by_x + seen["all"].by_y + seen["all"].by_z == seen["all"].caught
    found = {(r.cut, r.bucket): r for r in er.limits(df).collect()}
    assert {b for c, b in found if c == "gap"} <= {"under 1 min", "10-60 min", "over 30 d"} and {k[0] for k in found} == {"gap", "history"}
    long = [x for x in rows if x[0] == "t" and x[5] in (None, 1e7)]
    r = found[("gap", "over 30 d")]
    assert r.recall == pytest.approx(share([x for x in long if x[1]], lambda x: x[3])) and r.n_pos == sum(x[1] for x in long)


# ------------------------------------------------------------------- selection


def scored(spark, shift, n=600, seed=9):
    """Rows whose positives are ``shift`` above the noise."""
    rng = random.Random(seed)
    rows = [(i, i % 6 == 0, 1.0, float(rng.randrange(40) + (shift if i % 6 == 0 else 0)), f"c{i % 40}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y boolean, w double, score double, cluster string")


def test_paired_many_shares_its_draws(spark):
    frames = {"control": 5, "same": 5, "better": 25, "worse": 0}
    both = None
    for name, shift in frames.items():
        one = scored(spark, shift).withColumn("model", F.lit(name))
        both = one if both is None else both.unionByName(one)
    got = {r.model: r for r in sel.paired_many(both, "control", ["same", "better", "worse"], fpr=0.1, n_boot=100).collect()}
    assert (got["same"].diff, got["same"].lower, got["same"].upper) == (0.0, 0.0, 0.0)
    assert got["better"].lower > 0 and got["worse"].upper < 0


def test_backward_drops_what_hurts_and_the_later_period_refuses(spark):
    """Group b hides the positives of the first period; later it is the group that finds them."""

    def score(names, late=False):
        return scored(spark, 4 + (25 if ("b" in names) == late else 0))

    kept, seen = sel.backward(lambda names: score(names), ["a", "b", "c"], n_boot=80)
    assert kept == ["a", "c"] and seen[0]["accepted"] == "b" and seen[-1]["accepted"] is None
    kept, seen = sel.backward(lambda names: score(names), ["a", "b", "c"], late=lambda names: score(names, late=True), n_boot=80)
    assert kept == ["a", "b", "c"] and seen[-1]["veto"]
    kept, seen = sel.backward(lambda names: score(names), ["a", "b", "c"], late=lambda names: score(names), n_boot=80)
    assert kept == ["a", "c"] and not seen[-1]["veto"]
