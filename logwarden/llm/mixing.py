"""Mixing sources to target weights by temperature.  DataFrame functions only.

Source token shares are raised to an exponent and normalised.  The exponent is the
largest one (nearest the natural mix) whose weights reach the target entropy, moved
back towards 1 as far as needed for no source to be repeated more than the limit.
Both are found by bisection on a grid of 1/4096; each step is one small aggregate
over the table of sources.

Weights become budgets.  A source is cut into blocks of about ``block_tokens`` tokens
by a hash of the row; every epoch takes the source's blocks in an order of its own.
Whole epochs take every block; the last, partial one takes blocks while they fit and
documents of the block at the border while they fit.  Running sums go over blocks,
never over the rows of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

GRID = 4096
ENTROPY_SHARE = 0.95
REPEATS = 4.0
BLOCK_TOKENS = 200_000


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def _bisect(passes, lo: int = 0, hi: int = GRID) -> int:
    """The largest grid step in [lo, hi] that passes, given that smaller steps pass if a larger one does; ``lo`` if none."""
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if passes(mid) else (lo, mid - 1)
    return lo


def exponent(shares: DataFrame, entropy_share: float, repeats: float, budget_share: float) -> float:
    """The exponent for ``shares`` (share in (0, 1])."""
    power = lambda k: F.pow("share", F.lit(k / GRID))
    n = shares.count()
    if n < 2:
        return 1.0

    def spread(k: int) -> bool:
        z, s = shares.agg(F.sum(power(k)), F.sum(power(k) * F.log("share"))).first()
        return round(math.log(z) - k / GRID * s / z, 9) >= round(entropy_share * math.log(n), 9)

    def repeated(k: int) -> bool:
        z, most = shares.agg(F.sum(power(k)), F.max(power(k) / F.col("share"))).first()
        return round(budget_share * most / z, 9) > repeats

    k = _bisect(spread)
    if repeated(k):
        k = min(GRID, _bisect(repeated, k) + 1)
    return k / GRID


def budgets(sized: DataFrame, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS, budget_share: float = 1.0) -> DataFrame:
    """``source, tokens, weight, budget`` per source with tokens; a null source is a source of its own."""
    sums = stored(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = stored(sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))))
    alpha = exponent(shares, entropy_share, repeats, budget_share)
    z = shares.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    weight = F.pow("share", F.lit(alpha)) / F.lit(z)
    return shares.select("source", "tokens", weight.alias("weight"), F.floor(F.round(weight * F.lit(float(budget_share * total)), 3)).alias("budget")).withColumn("alpha", F.lit(alpha))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS, budget_share: float = 1.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per drawn document and epoch: ``key, source, n_tokens, epoch, block, block_rank`` and the columns of ``docs``
    under the struct ``row``.

    Null and empty texts count 0 tokens and go with their block.  A null source is mixed as a source; a source without
    tokens gets no budget.  Repeated rows are drawn each; a row without an id is dealt to a block by its text, so only equal
    rows share a block of necessity.  An empty table gives no rows.  ``block_rank`` is the block's place in its source's
    order of that epoch.
    """
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text))).alias("_name")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_key"), name, F.col(source).cast("string").alias("source"), n_tokens(F.col(text)).alias("n_tokens"))
    slim = docs.select(F.col(source).cast("string").alias("source"), n_tokens(F.col(text)).alias("n_tokens"))
    plan = stored(budgets(slim, entropy_share, repeats, budget_share).withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))
    hashed = F.conv(F.substring(_draw(F.lit("block"), "_s", "_name"), 1, 8), 16, 10).cast("long")
    named = lambda df: df.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    # plan has a row per source: planned by statistics, hot sources split by the adaptive join
    placed = named(rows).join(plan, "_s").withColumn("block", F.pmod(hashed, blocks))
    sums = placed.groupBy("_s", "block").agg(F.sum("n_tokens").alias("_sum"), F.first("tokens").alias("_all"), F.first("budget").alias("_budget"))
    turns = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_budget") / F.col("_all")))))
    order = Window.partitionBy("_s", "epoch").orderBy(_draw(F.lit("turn"), "_s", F.col("epoch"), F.col("block")), "block")
    turns = turns.withColumn("block_rank", F.row_number().over(order)).withColumn("_upto", F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("_budget") - F.col("epoch") * F.col("_all")
    turns = stored(
        turns.withColumn("_room", left - F.col("_upto") + F.col("_sum")).withColumn("_whole", F.col("_upto") <= left)
        .where("_room > 0 or _whole").select("_s", "block", "epoch", "block_rank", "_whole", "_room")
    )
    taken = placed.select("row", "_key", "_name", "source", "n_tokens", "_s", "block").join(turns, ["_s", "block"])
    whole = taken.where("_whole").drop("_whole", "_room")
    inside = Window.partitionBy("_s", "epoch", "block").orderBy(_draw(F.lit("doc"), "epoch", "_name"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    border = turns.where("not _whole")
    fits = placed.select("row", "_key", "_name", "source", "n_tokens", "_s", "block").join(border, ["_s", "block"]).withColumn("_run", F.sum("n_tokens").over(inside)).where("_run <= _room").drop("_run", "_whole", "_room")
    return whole.unionByName(fits).drop("_s", "_name").withColumnRenamed("_key", key)
