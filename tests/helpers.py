"""Hand-built attempts and a plain-Python reading of the window rules."""

from __future__ import annotations

import random

SCHEMA = (
    "row_id bigint, t bigint, uid bigint, username string, ip string, asn bigint, country string, ua string, "
    "browser string, os string, device_type string, success boolean, is_attack_ip boolean, is_ato boolean"
)
S, H, D = 1_000_000, 3_600_000_000, 86_400_000_000
T0 = 1_704_067_200_000_000


def attempt(i, t, **kw):
    row = dict(
        row_id=i, t=T0 + t, uid=1, username="u1", ip="10.0.0.1", asn=100, country="C0", ua="Mozilla/5.0 x", browser="Chrome 80.0",
        os="Linux", device_type="desktop", success=False, is_attack_ip=False, is_ato=False,
    )
    row.update(kw)
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_log(n=600, seed=3):
    """Ties, NULLs, one hot address and exact window offsets."""
    rng = random.Random(seed)
    base = [rng.randrange(0, 3 * D) for _ in range(n // 4)]
    times = []
    for b in base:
        times += [b, b, b + rng.choice([H, H - 1, H + 1, D, D - 1, D + 1, 7 * D]), b + rng.randrange(0, H)]
    rows = []
    for i, t in enumerate(times):
        uid = rng.choice([None, 1, 2, 3, 4, 5])
        rows.append(
            attempt(
                i, t, uid=uid, username=f"u{uid}" if uid else f"g{rng.randrange(6)}",
                ip="10.0.0.1" if rng.random() < 0.4 else f"10.0.0.{rng.randrange(2, 6)}", asn=rng.choice([None, 100, 200]),
                country=rng.choice([None, "C0", "C1", "C2"]), ua=rng.choice([None, "a", "b", "c"]), browser=rng.choice([None, "Chrome 80.0", "Chrome 81.2"]),
                os=rng.choice([None, "Linux", "Windows 10"]), device_type=rng.choice([None, "mobile", "bot", "x"]), success=rng.random() < 0.5,
            )
        )
    return rows
