"""Rule tuning: how deep each attempt reaches on a loose-to-strict ladder of parameters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slicing import DEFAULT_SLICE_ROWS
from .rules import RULES, Ask, Config, Intel, add_state, need_columns, prepare

# Ladder, rule, scope, the parameters that tighten, and their values from loose to strict.
STEPS = (
    ("brute_force", "brute_force", None, ("threshold",), ((3,), (4,), (5,), (6,), (8,), (10,), (15,), (20,), (30,), (50,))),
    ("credential_stuffing/ip", "credential_stuffing", "ip", ("min_fails", "min_users"), ((4, 2), (6, 3), (8, 4), (10, 5), (15, 8), (20, 10), (30, 15), (50, 25), (100, 50))),
    ("credential_stuffing/asn", "credential_stuffing", "asn", ("asn_min_fails", "asn_min_users"), ((20, 10), (30, 15), (40, 20), (60, 30), (80, 40), (120, 60), (160, 80), (240, 120), (400, 200))),
    ("password_spray_slow/ip", "password_spray_slow", "ip", ("min_users",), ((5,), (8,), (10,), (15,), (20,), (30,), (50,), (80,), (150,))),
    ("password_spray_slow/asn", "password_spray_slow", "asn", ("asn_min_users",), ((20,), (40,), (60,), (80,), (100,), (150,), (200,))),
    ("distributed_bruteforce", "distributed_bruteforce", None, ("min_fails", "min_ips"), ((4, 3), (6, 4), (8, 5), (12, 8), (16, 10), (24, 15), (40, 25), (80, 50))),
    ("success_after_failures", "success_after_failures", None, ("min_fails",), ((2,), (3,), (4,), (5,), (6,), (8,), (10,), (15,), (25,))),
    ("ua_rotation", "ua_rotation", None, ("min_fails", "min_distinct_ua"), ((4, 3), (6, 4), (8, 5), (12, 7), (16, 10), (24, 15), (40, 25))),
    ("dormant_account_login", "dormant_account_login", None, ("dormant_days",), ((14,), (30,), (60,), (90,), (120,), (180,), (270,), (365,))),
    ("rare_network_login", "rare_network_login", None, ("max_share",), ((1e-3,), (5e-4,), (2e-4,), (1e-4,), (5e-5,), (2e-5,), (1e-5,), (5e-6,), (2e-6,), (1e-6,), (0.0,))),
    ("multi_context_simultaneous", "multi_context_simultaneous", None, ("window_s",), ((1800,), (900,), (600,), (300,), (120,), (60,), (30,))),
    ("country_hop", "country_hop", None, ("min_countries",), ((2,), (3,), (4,), (5,), (6,))),
    ("bot_user_agent", "bot_user_agent", None, (), ((),)),
    ("scripted_client", "scripted_client", None, (), ((),)),
)
# What turns a scope of a rule off.
SCOPE_OFF = {
    ("credential_stuffing", "ip"): {"min_fails": 100_000, "min_users": 100_000},
    ("credential_stuffing", "asn"): {"asn_min_fails": 1_000_000, "asn_min_users": 1_000_000},
    ("password_spray_slow", "ip"): {"min_users": 100_000},
    ("password_spray_slow", "asn"): {"asn_min_users": 100_000},
}
# Ladders left out of a profile, as their thresholds drift with the traffic or the age of the log.
NOT_IN_PROFILE = ("credential_stuffing/asn", "dormant_account_login")


@dataclass(frozen=True)
class Ladder:
    """One scope of one rule, tightened rung by rung; the rule's other scopes are off meanwhile."""

    name: str
    rule_id: str
    scope: str | None
    parameters: tuple[str, ...]
    values: tuple[tuple, ...]

    @property
    def column(self) -> str:
        return "level_" + self.name.replace("/", "_")

    def others_off(self) -> dict[str, Any]:
        return {k: v for (rule_id, scope), off in SCOPE_OFF.items() if rule_id == self.rule_id and self.scope and scope != self.scope for k, v in off.items()}

    def rung(self, number: int) -> dict[str, Any]:
        return dict(zip(self.parameters, self.values[number - 1], strict=True))


LADDERS = tuple(Ladder(*step) for step in STEPS)


def leading_trues(flags: list[Column]) -> Column:
    """How many flags hold before the first that does not."""
    level = F.lit(len(flags))
    for i in range(len(flags) - 1, -1, -1):
        level = F.when(~F.coalesce(flags[i], F.lit(False)), i).otherwise(level)
    return level


def rule_levels(attempts: DataFrame, ladders=LADDERS, *, keep: list[str] | None = None, slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """``row_id, level_<ladder>...``: every rung of every ladder from one computation of the state."""
    from . import rulebook  # noqa: F401

    ask, built = Ask(), []
    for ladder in ladders:
        r = RULES[ladder.rule_id]
        settings = [{**ladder.others_off(), **ladder.rung(i + 1)} for i in range(len(ladder.values))]
        Config.from_dict({"rules": {r.id: {"params": settings[0]}}})
        flags = [r.build(ask, r.resolve(x)).fires for x in settings]
        built.append((ladder, r, flags))
    state = add_state(prepare(attempts), ask, Intel(), slice_rows=slice_rows)
    have = need_columns(Intel(), ask.wants)
    cols = []
    for ladder, r, flags in built:
        met = F.lit(True)
        for need in r.needs:
            met = met & have[need]
        cols.append(F.when(met, leading_trues(flags)).otherwise(0).cast("int").alias(ladder.column))
    return state.select("row_id", *(keep or []), *cols)


def ladder_metrics(levels: DataFrame, facts: DataFrame, ladders=LADDERS) -> DataFrame:
    """Per ladder, rung and partition: false alerts per 10 000 legitimate successes and recall.

    ``facts``: ``row_id, part, success, is_attack_ip, w``.
    """
    joined = levels.join(facts, "row_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(x.name).alias("ladder"), F.col(x.column).alias("level"), F.lit(len(x.values)).alias("rungs")) for x in ladders]))
    w, attack = F.col("w"), F.col("is_attack_ip")
    at = joined.select("part", "success", "is_attack_ip", "w", pairs.alias("p")).select("part", "success", "is_attack_ip", "w", "p.*")
    by_level = at.groupBy("ladder", "part", "level", "rungs").agg(
        F.sum(F.when(~attack, w).otherwise(0.0)).alias("normal"), F.sum(F.when(attack, w).otherwise(0.0)).alias("attack")
    )
    totals = joined.groupBy(F.col("part").alias("_part")).agg(
        F.sum(F.when(~attack & F.col("success"), w).otherwise(0.0)).alias("legit"), F.sum(F.when(attack, w).otherwise(0.0)).alias("all_attack")
    )
    rung = by_level.where("level > 0").withColumn("rung", F.explode(F.sequence(F.lit(1), F.col("level"))))
    fired = rung.groupBy("ladder", "part", "rung").agg(F.sum("normal").alias("normal"), F.sum("attack").alias("attack"))
    grid = by_level.groupBy("ladder", "part").agg(F.max("rungs").alias("n")).withColumn("rung", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    out = grid.join(fired, ["ladder", "part", "rung"], "left").join(F.broadcast(totals), F.col("part") == F.col("_part"))
    zero = F.lit(0.0)
    return out.select(
        "ladder", "part", "rung",
        F.round(F.coalesce("normal", zero) / F.col("legit") * 10_000, 6).alias("fa10k"),
        F.when(F.col("all_attack") > 0, F.round(F.coalesce("attack", zero) / F.col("all_attack"), 6)).alias("recall"),
    )


def select_rungs(metrics: DataFrame, budget: float, parts: list[str]) -> DataFrame:
    """The loosest rung within the false-alert budget on every named partition."""
    ok = metrics.where(F.col("part").isin(*parts)).groupBy("ladder", "rung").agg(F.max("fa10k").alias("worst"), F.count(F.lit(1)).alias("n"))
    return ok.where((F.col("worst") <= budget) & (F.col("n") == len(parts))).groupBy("ladder").agg(F.min("rung").alias("rung"))


def weights(rows: DataFrame, levels: DataFrame, chosen: dict[str, int], *, default: float = 0.05, ladders=LADDERS) -> DataFrame:
    """``ladder, fired, weight``: per chosen ladder the weighted precision of the rows that reach its rung; ``default`` if none does.

    ``rows``: ``row_id, y, w``.  All ladders are counted in one pass.
    """
    column = {x.name: x.column for x in ladders}
    hit = F.explode(F.array(*[F.struct(F.lit(k).alias("ladder"), F.coalesce(F.col(column[k]) >= rung, F.lit(False)).alias("hit")) for k, rung in chosen.items()]))
    long = rows.join(levels, "row_id", "left").select("y", "w", hit.alias("h")).select("y", "w", "h.*")
    precision = F.sum(F.when(F.col("hit") & F.col("y"), F.col("w")).when(F.col("hit"), 0.0)) / F.sum(F.when(F.col("hit"), F.col("w")))
    return long.groupBy("ladder").agg(F.count_if("hit").alias("fired"), F.coalesce(precision, F.lit(default)).alias("weight"))


def rung_table(spark: SparkSession, ladders=LADDERS) -> DataFrame:
    """``ladder, rule_id, rung, name, value``: a row per parameter of every rung; rung 0 is what turns the scope off."""
    rows = []
    for x in ladders:
        rows += [(x.name, x.rule_id, i, k, float(v)) for i in range(1, len(x.values) + 1) for k, v in x.rung(i).items()]
        rows += [(x.name, x.rule_id, 0, k, float(v)) for k, v in SCOPE_OFF.get((x.rule_id, x.scope), {}).items()]
    return spark.createDataFrame(rows, "ladder string, rule_id string, rung int, name string, value double")


def profile(spark: SparkSession, selection: DataFrame, ladders=LADDERS, excluded=NOT_IN_PROFILE) -> DataFrame:
    """``rule_id, mode, params``: the chosen rungs (``selection``: ladder, rung) merged per rule.

    A scope without a chosen rung, or left out, is switched off (rung 0 of its ladder); a rule with no chosen scope only
    shadows and has no parameters.
    """
    modes = spark.createDataFrame([(x.name, x.rule_id, RULES[x.rule_id].mode) for x in ladders], "ladder string, rule_id string, _mode string")
    kept = selection.where(F.col("rung").isNotNull() & ~F.col("ladder").isin(*excluded)).select("ladder", F.col("rung").cast("int").alias("_rung"))
    chosen = modes.join(F.broadcast(kept), "ladder", "left")
    per_rule = chosen.groupBy("rule_id").agg(F.max(F.col("_rung").isNotNull()).alias("_any"), F.max("_mode").alias("_mode"))
    at = rung_table(spark, ladders).join(F.broadcast(chosen.select("ladder", F.coalesce("_rung", F.lit(0)).alias("rung"))), ["ladder", "rung"])
    params = at.groupBy("rule_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("_params"))
    return per_rule.join(F.broadcast(params), "rule_id", "left").select(
        "rule_id", F.when(F.col("_any"), F.col("_mode")).otherwise("shadow").alias("mode"), F.when(F.col("_any"), F.col("_params")).alias("params")
    )


def as_config(rows: list) -> dict[str, Any]:
    """A rule configuration from the rows of a profile (one per rule)."""
    kind = lambda rule_id, k, v: type(RULES[rule_id].params[k].default)(v)
    return {"rules": {r.rule_id: {"mode": r.mode, "params": {k: kind(r.rule_id, k, v) for k, v in (r.params or {}).items()}} for r in rows}}
