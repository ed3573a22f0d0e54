"""Overlap of rules and model against a plain reading, on a small table with ties."""

import random

import pytest
from pyspark.sql import functions as F

from logwarden.plans import explain as ex
from logwarden.plans import ladders as ld
from logwarden.plans import overlap as ov

USED = [x for x in ld.LADDERS if x.name in ("brute_force", "country_hop")]


def table(n=400, seed=2):
    rng = random.Random(seed)
    rows, levels = [], []
    for i in range(n):
        y = i % 9 == 0
        rows.append((i, "a" if i % 4 else "b", y, float(rng.choice([1, 1, 2])), float(rng.randrange(12) + 4 * y), f"c{i % 7}"))
        if i % 11:
            levels.append((i, rng.randrange(5) if y else rng.randrange(3), rng.randrange(3)))
    return rows, levels


def cut(own, rate):
    """The highest negative score at which the false positive rate exceeds the target."""
    neg = [r for r in own if not r[2]]
    total = sum(r[3] for r in neg)
    over = [s for s in {r[4] for r in neg} if sum(r[3] for r in neg if r[4] >= s) > rate * total]
    return max(over, default=float("-inf"))


def test_matched_overlap(spark):
    rows, levels = table()
    frame = spark.createDataFrame(rows, "row_id long, task string, y boolean, w double, score double, cluster string")
    deep = spark.createDataFrame(levels, "row_id long, level_brute_force int, level_country_hop int")
    sets = {"one": {"brute_force": 3}, "two": {"brute_force": 2, "country_hop": 2}}
    got = {(r.task, r.level, r.rule_set): r for r in ov.matched(ov.flagged(frame, deep, sets, USED), (0.1, 0.02), n_boot=50).collect()}
    at = {i: (b, c) for i, b, c in levels}
    assert len(got) == 8
    for (task, level, name), r in got.items():
        own = [x for x in rows if x[1] == task]
        rule = {x[0]: at.get(x[0], (0, 0))[0] >= sets[name]["brute_force"] or at.get(x[0], (0, 0))[1] >= sets[name].get("country_hop", 99) for x in own}
        tau = cut(own, level)

        def share(side, flag):
            some = [x for x in own if x[2] == side]
            return sum(x[3] for x in some if flag(x)) / sum(x[3] for x in some)

        either = lambda x: x[4] > tau or rule[x[0]]  # noqa: B023, E731
        assert r.fpr_union == pytest.approx(share(False, either)) and r.recall_union == pytest.approx(share(True, either))
        assert r.pos_rules_only == pytest.approx(share(True, lambda x: rule[x[0]] and not x[4] > tau))  # noqa: B023
        alone, by_rules = cut(own, share(False, either)), cut(own, share(False, lambda x: rule[x[0]]))  # noqa: B023
        assert r.matched_to_union == pytest.approx(share(True, lambda x: x[4] > alone))  # noqa: B023
        assert r.matched_to_rules == pytest.approx(share(True, lambda x: x[4] > by_rules))  # noqa: B023
        assert r.gain == pytest.approx(r.recall_union - r.matched_to_union) and r.gain_lo <= r.gain + 1e-9 and r.gain_hi >= r.gain - 0.5
    caught = {(r.task, r.level, r.ladder): (r.share, r.n) for r in ov.attribution(frame, deep, sets["two"], (0.1,), USED).collect()}
    for task in "ab":
        own = [x for x in rows if x[1] == task]
        missed = [x for x in own if x[2] and not x[4] > cut(own, 0.1)]
        for ladder, place, rung in (("brute_force", 0, 2), ("country_hop", 1, 2)):
            hit = [x for x in missed if at.get(x[0], (0, 0))[place] >= rung]
            assert caught[(task, 0.1, ladder)] == (pytest.approx(sum(x[3] for x in hit) / sum(x[3] for x in missed)), len(hit))


def test_rows_without_levels_are_not_flagged(spark):
    frame = spark.createDataFrame([(1, "a", True, 1.0, 1.0, "c")], "row_id long, task string, y boolean, w double, score double, cluster string")
    deep = spark.createDataFrame([], "row_id long, level_brute_force int, level_country_hop int")
    assert ov.flagged(frame, deep, {"one": {"brute_force": 1}}, USED).where(F.col("rule")).count() == 0


def test_age_is_scaled_like_a_count():
    assert "u_age_days" in ex.COUNT_LIKE and "u_n_success" in ex.COUNT_LIKE and "new_ip" not in ex.COUNT_LIKE
