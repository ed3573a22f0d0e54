"""Live campaigns against a replay of the alerts one by one."""

import random

import pytest

from logwarden.plans import live_campaigns as lc

from helpers import D, H, S, T0, attempt, frame


def replay(rows, window):
    """(campaign per row, [label, first, last, alerts] per campaign), alert by alert."""
    camp, table, done = {}, {}, []
    for r in sorted(rows, key=lambda r: (r["t"], r["row_id"])):
        near = [
            x for x in done
            if x["t"] >= r["t"] - window and ((r["ip"] is not None and x["ip"] == r["ip"]) or (r["asn"] is not None and x["asn"] == r["asn"]))
            and not (x["uid"] is not None and x["uid"] == r["uid"])
        ]
        own = next((camp[x["row_id"]] for x in near if camp[x["row_id"]] is not None), None)
        if own is None and near:
            own = r["row_id"]
            table[own] = [f"ASN {r['asn']}" if r["asn"] is not None else f"IP {r['ip']}", min(x["t"] for x in near), r["t"], 0]
        camp[r["row_id"]] = None
        if own is not None:
            for x in [*near, r]:
                if camp[x["row_id"]] is None:
                    camp[x["row_id"]] = own
                    table[own][3] += 1
            table[own][2] = max(table[own][2], r["t"])
        done.append(r)
    return camp, table


def check(spark, rows, window, slice_rows=4_000_000):
    alerts = frame(spark, rows)
    want, table = replay([r.asDict() for r in alerts.collect()], window)
    assigned = lc.assign(alerts, window, slice_rows=slice_rows)
    assert {r.row_id: r.campaign for r in assigned.collect()} == want
    assert {r.campaign: [r.label, r.first_seen, r.last_seen, r.alerts] for r in lc.campaigns(alerts, assigned).collect()} == table


def log(n, seed, ips, asns, users, span):
    """Bursts of one account, ties, unknown accounts and unknown infrastructure."""
    rng = random.Random(seed)
    rows, t, uid = [], 0, 1
    for i in range(n):
        t += rng.choice([0, 0, 1, span // 7, span // 3, span, span + 1])
        uid = uid if rng.random() < 0.5 else rng.choice([None, *range(1, users + 1)])
        rows.append(attempt(rng.randrange(10**6) * 1000 + i, t, uid=uid, ip=rng.choice([None, *[f"10.0.0.{k}" for k in range(ips)]]), asn=rng.choice([None, *range(asns)])))
    return rows


@pytest.mark.parametrize("seed,ips,asns,users,slice_rows", [(1, 6, 3, 4, 4_000_000), (2, 1, 1, 2, 4_000_000), (3, 25, 12, 3, 4_000_000), (4, 2, 2, 3, 40), (5, 12, 5, 30, 25)])
def test_assignment_equals_replay(spark, seed, ips, asns, users, slice_rows):
    check(spark, log(260, seed, ips, asns, users, 100 * S), 200 * S, slice_rows)


def test_campaigns_never_merge_and_pull_in(spark):
    rows = [
        attempt(1, 0, uid=1, ip="a", asn=None), attempt(2, H, uid=2, ip="a", asn=None),  # a campaign on address a
        attempt(3, 2 * H, uid=3, ip="b", asn=7), attempt(4, 3 * H, uid=4, ip="b", asn=None),  # another on b
        attempt(5, 4 * H, uid=5, ip="a", asn=7),  # touches both: joins the one of the earliest link
        attempt(6, 5 * H, uid=6, ip="c", asn=None), attempt(7, 6 * H, uid=6, ip="c", asn=None),  # one account alone
        attempt(8, 30 * H + 1, uid=6, ip="d", asn=None), attempt(9, 7 * H, uid=None, ip="d", asn=None), attempt(10, 8 * H, uid=None, ip="d", asn=None),
    ]
    got = {r.row_id: r.campaign for r in lc.assign(frame(spark, rows)).collect()}
    assert got == {1: 2, 2: 2, 3: 4, 4: 4, 5: 2, 6: None, 7: None, 8: 10, 9: 10, 10: 10}
    opened = {r.campaign: (r.label, r.first_seen - T0, r.last_seen - T0, r.alerts, r.accounts) for r in lc.campaigns(frame(spark, rows), lc.assign(frame(spark, rows))).collect()}
    assert opened == {2: ("IP a", 0, 4 * H, 3, 3), 4: ("IP b", 2 * H, 3 * H, 2, 2), 10: ("IP d", 7 * H, 30 * H + 1, 3, 2)}
    check(spark, rows, D)


def test_no_alerts(spark):
    assert lc.assign(frame(spark, []).limit(0)).count() == 0
