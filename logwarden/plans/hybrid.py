"""One risk score per attempt from rule hits, reputation and a calibrated model.

Hits arrive as an array on the attempt row, so combining them needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Bands, action, band_action, noisy_or, relax_delta, safe_shift
from ..functions.text import percent_text
from .rules import REPUTATION, RULES


@dataclass(frozen=True)
class Weights:
    """Probability that a rule is right when it fires alone."""

    weights: dict[str, float] = field(default_factory=dict)
    default: float = 0.05
    overriding: tuple[str, ...] = ("blocklist_hit",)

    @classmethod
    def from_dict(cls, data: dict) -> "Weights":
        unknown = set(data) - {"weights", "default_weight", "override_rule_ids"}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        weights = {k: float(v["weight"] if isinstance(v, dict) else v) for k, v in data.get("weights", {}).items()}
        default = float(data.get("default_weight", 0.05))
        if any(not 0.0 <= w <= 1.0 for w in [*weights.values(), default]):
            raise ValueError("weights must lie in 0..1")
        return cls(weights, default, tuple(data.get("override_rule_ids", ("blocklist_hit",))))

    def of(self, rule_id: Column) -> Column:
        if not self.weights:
            return F.lit(self.default)
        pairs = [x for k, v in sorted(self.weights.items()) for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), rule_id), F.lit(self.default))


def _category(rule_id: Column) -> Column:
    from . import rulebook  # noqa: F401

    pairs = [x for r in RULES.values() for x in (F.lit(r.id), F.lit(r.category))]
    return F.try_element_at(F.create_map(*pairs), rule_id)


def combine(scored: DataFrame, weights: Weights, bands: Bands = Bands(), *, ml: str = "ml_probability") -> DataFrame:
    """Add score, action, probabilities and sorted contributions.

    ``scored`` has ``hits`` (array of rule hits) and the model probability (NULL = no model).
    """
    ids = F.array_distinct(F.transform("hits", lambda h: h["rule_id"]))
    entries = F.transform(
        ids,
        lambda r: F.struct(
            r.alias("source"),
            r.alias("label"),
            weights.of(r).alias("weight"),
            F.when(_category(r) == REPUTATION, "reputation").otherwise("rule").alias("group"),
        ),
    )
    model = F.array(F.struct(F.lit("ml").alias("source"), F.lit("model").alias("label"), F.col(ml).cast("double").alias("weight"), F.lit("ml").alias("group")))
    everything = F.when(F.col(ml).isNotNull(), F.concat(F.col("_rules"), model)).otherwise(F.col("_rules"))
    by_weight = F.transform(
        F.array_sort(F.transform(everything, lambda c, i: F.struct((-c["weight"]).alias("o"), i.alias("i"), c.alias("c")))), lambda x: x["c"]
    )

    def part(group: str) -> Column:
        return F.transform(F.filter("_rules", lambda c: c["group"] == group), lambda c: c["weight"])

    out = scored.withColumn("_rules", entries)
    out = out.withColumns(
        {
            "rule_probability": noisy_or(part("rule")),
            "reputation_probability": noisy_or(part("reputation")),
            "overridden_by": F.try_element_at(F.filter(ids, lambda r: r.isin(*weights.overriding)), F.lit(1))
            if weights.overriding
            else F.lit(None).cast("string"),
            "contributions": by_weight,
        }
    )
    evidence = F.array(
        F.col(ml),
        F.when(F.size(part("rule")) > 0, F.col("rule_probability")),
        F.when(F.size(part("reputation")) > 0, F.col("reputation_probability")),
    )
    out = out.withColumn("probability", F.when(F.col("overridden_by").isNotNull(), 1.0).otherwise(noisy_or(evidence)))
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("probability") * 100, 0).cast("int"))))
    return out.withColumn("action", F.when(F.col("overridden_by").isNotNull(), "lock").otherwise(band_action(F.col("score"), bands))).drop("_rules")


def feedback_tally(verdicts: DataFrame) -> DataFrame:
    """Verdicts and false positives per user (statuses resolved / false_positive)."""
    judged = verdicts.where(F.col("status").isin("resolved", "false_positive") & F.col("uid").isNotNull())
    return judged.groupBy("uid").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if(F.col("status") == "false_positive").alias("false_positives"))


def user_bands(tally: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Personal thresholds after analyst feedback."""
    shift = safe_shift(F.col("delta"), bands)
    out = tally.withColumn("delta", relax_delta(F.col("verdicts"), F.col("false_positives")))
    return out.withColumns(
        {
            "alert_at": F.lit(bands.alert_at) + shift,
            "step_up_at": F.lit(bands.step_up_at) + shift,
            "lock_at": F.lit(bands.lock_at) + shift,
        }
    )


def apply_user_bands(scored: DataFrame, personal: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Re-decide the action with personal thresholds where the user has some."""
    from ..operators.joins import lookup

    p = personal.where("delta > 0").select(F.col("uid").alias("_u"), *[F.col(c).alias(f"_{c}") for c in ("alert_at", "step_up_at", "lock_at")])
    joined = lookup(scored, p, [("uid", "_u")])
    decided = action(
        F.col("score"),
        F.coalesce("_alert_at", F.lit(bands.alert_at)),
        F.coalesce("_step_up_at", F.lit(bands.step_up_at)),
        F.coalesce("_lock_at", F.lit(bands.lock_at)),
    )
    return joined.withColumn("action", F.when(F.col("overridden_by").isNotNull(), "lock").otherwise(decided)).drop("_u", "_alert_at", "_step_up_at", "_lock_at")


ML_FAMILY = "unusual login (model)"


def family(scored: DataFrame, ml_component: str | None = None) -> DataFrame:
    """Suggested attack family and its confidence: the heaviest rule's category, else the model."""
    rules_only = F.filter("contributions", lambda c: c["group"] != "ml")
    top = F.try_element_at(rules_only, F.lit(1))
    model = F.try_element_at(F.col("contributions"), F.lit(1))
    label = F.coalesce(F.col(ml_component), F.lit(ML_FAMILY)) if ml_component else F.lit(ML_FAMILY)
    return scored.withColumns(
        {
            "family": F.when(top.isNotNull(), _category(top["source"])).when(model.isNotNull(), label),
            "confidence": F.coalesce(top["weight"], model["weight"]),
            "top_rule": F.coalesce(F.col("overridden_by"), top["source"]),
        }
    )


def hit_text(hit: Column) -> Column:
    """A rule hit as words: the rule's title, its scope and what was counted."""
    from . import rulebook  # noqa: F401

    titles = F.create_map(*[x for r in RULES.values() for x in (F.lit(r.id), F.lit(r.title))])
    known = F.filter(F.map_entries(hit["evidence"]), lambda e: e["value"].isNotNull())
    facts = F.array_join(F.transform(known, lambda e: F.concat(F.translate(e["key"], "_", " "), F.lit(" "), e["value"])), ", ")
    title = F.coalesce(F.try_element_at(titles, hit["rule_id"]), hit["rule_id"])
    return F.concat(title, F.coalesce(F.concat(F.lit(" by "), hit["scope"]), F.lit("")), F.when(facts != "", F.concat(F.lit(": "), facts)).otherwise(""))


def with_hit_texts(scored: DataFrame) -> DataFrame:
    """``scored`` (``contributions, hits``) with every rule's contribution labelled by the text of its first hit."""

    def label(c: Column) -> Column:
        hit = F.try_element_at(F.filter("hits", lambda h: h["rule_id"] == c["source"]), F.lit(1))
        return F.coalesce(hit_text(hit), c["label"])

    return scored.withColumn("contributions", F.transform("contributions", lambda c: c.withField("label", label(c))))


def reasons(limit: int = 3) -> Column:
    """The strongest contributions as text."""
    return F.array_join(
        F.transform(F.slice("contributions", 1, limit), lambda c: F.concat(c["label"], F.lit(" ("), percent_text(c["weight"]), F.lit(")"))), "; "
    )
