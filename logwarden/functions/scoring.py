"""Score arithmetic: severity, noisy-OR, action bands, calibration, threshold shifts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("allow", "alert", "step_up", "lock")


@dataclass(frozen=True)
class Bands:
    alert_at: int = 32
    step_up_at: int = 58
    lock_at: int = 70

    def __post_init__(self) -> None:
        if not 0 <= self.alert_at < self.step_up_at < self.lock_at <= 100:
            raise ValueError("bands must increase strictly within 0..100")


FALLBACK_BANDS = Bands(40, 65, 85)


def severity(score: Column) -> Column:
    return F.when(score < 40, "low").when(score <= 70, "medium").otherwise("high")


def clamp01(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def noisy_or(probabilities: Column) -> Column:
    """1 - prod(1 - p) over an array, skipping NULLs; 0 for an empty array."""
    known = F.filter(probabilities, lambda p: p.isNotNull())
    return F.lit(1.0) - F.aggregate(known, F.lit(1.0), lambda acc, p: acc * (F.lit(1.0) - clamp01(p)))


def action(score: Column, alert_at: Column, step_up_at: Column, lock_at: Column) -> Column:
    return F.when(score >= lock_at, "lock").when(score >= step_up_at, "step_up").when(score >= alert_at, "alert").otherwise("allow")


def band_action(score: Column, bands: Bands = Bands()) -> Column:
    return action(score, F.lit(bands.alert_at), F.lit(bands.step_up_at), F.lit(bands.lock_at))


def action_rank(a: Column) -> Column:
    return F.when(a == "lock", 3).when(a == "step_up", 2).when(a == "alert", 1).otherwise(0)


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear through the breakpoints, flat outside, clipped to [0, 1]."""
    if len(xs) != len(ys) or any(b <= a for a, b in zip(xs, xs[1:])):
        raise ValueError("breakpoints must increase strictly")
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for i in range(1, len(xs)):
        slope = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])
        out = out.when(x <= xs[i], F.lit(float(ys[i - 1])) + (x - F.lit(float(xs[i - 1]))) * F.lit(slope))
    return F.when(x.isNotNull(), clamp01(out.otherwise(F.lit(float(ys[-1])))))


MIN_FEEDBACK = 3
RELAX_PER_FALSE_POSITIVE = 4.0
MAX_RELAX = 20.0


def relax_delta(verdicts: Column, false_positives: Column) -> Column:
    """How far to raise one user's bands after analyst verdicts."""
    net = false_positives - (verdicts - false_positives)
    return (
        F.when(verdicts < MIN_FEEDBACK, 0.0)
        .when(net <= 0, 0.0)
        .otherwise(F.least(net * F.lit(RELAX_PER_FALSE_POSITIVE), F.lit(MAX_RELAX)))
    )


def safe_shift(delta: Column, bands: Bands = Bands()) -> Column:
    """The shift applied to all three bands so that their order survives."""
    return F.when(delta <= 0, 0).otherwise(F.bround(F.least(delta, F.lit(MAX_RELAX), F.lit(100.0 - bands.lock_at)), 0).cast("int"))
