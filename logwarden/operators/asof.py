"""Forward as-of match: the first later event of someone else.

For every anchor: the earliest event with ``t`` in (anchor, anchor + horizon], a
different user, and equal values in ``same``.  Because only the *first* foreign event
counts, no candidate pairs are formed: walking backwards in time, an event carries
"the next event" and "the next event by a user other than that one", and one of the
two is always the answer.  Both are running minima, so hot keys are sliced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import Running, running
from .slicing import DEFAULT_SLICE_ROWS


def first_match(
    anchors: DataFrame,
    events: DataFrame,
    *,
    same: list[str],
    horizons: list[int],
    period_end: Column | None = None,
    slice_rows: int = DEFAULT_SLICE_ROWS,
) -> DataFrame:
    """``anchor_id, anchor_t, anchor_uid, donor_id, donor_t, donor_uid, tier``.

    ``tier`` is the 1-based horizon that first holds a match; NULL donor = unmatched.
    Frames need ``row_id, t, uid`` and the ``same`` columns; ``period_end`` (over the
    anchor's columns) drops donors at or after that time.
    """
    keys = same or ["_any"]
    a = anchors.withColumn("_any", F.lit(1)).select(*keys, "row_id", "t", "uid", F.lit(1).alias("is_anchor"), (period_end if period_end is not None else F.lit(None).cast("bigint")).alias("_end"))
    e = events.withColumn("_any", F.lit(1)).select(*keys, "row_id", "t", "uid", F.lit(0).alias("is_anchor"), F.lit(None).cast("bigint").alias("_end"))
    stream = a.unionByName(e)
    # descending time as an ascending order column; at one instant anchors come first,
    # so that they see later events only
    stream = stream.withColumns({"_back": -F.col("t"), "_event": 1 - F.col("is_anchor"), "_rid": -F.col("row_id")})
    donor = F.when(F.col("is_anchor") == 0, F.struct("t", "row_id", "uid"))
    order = ["_back", "_event", "_rid"]
    nxt = running(stream, keys, order, [Running("_n1", "min", donor, "prior_rows")], slice_rows=slice_rows)
    # the next event by a user other than _n1's: the start of _n1's own "next other" run.
    # At each event row, _n1 is the following event; a change of user there ends a run.
    other = F.when((F.col("is_anchor") == 0) & F.col("_n1").isNotNull() & (F.col("_n1.uid") != F.col("uid")), F.struct(F.col("t").alias("at"), F.col("row_id").alias("by"), F.col("_n1").alias("d")))
    nxt = running(nxt, keys, order, [Running("_n2", "min", other, "prior_rows")], slice_rows=slice_rows)
    first = F.when(F.col("_n1.uid") != F.col("uid"), F.col("_n1")).otherwise(F.col("_n2.d"))
    out = nxt.where("is_anchor = 1").withColumn("_d", first)
    if period_end is not None:
        out = out.withColumn("_d", F.when(F.col("_d.t") < F.col("_end"), F.col("_d")))
    tier = F.lit(None).cast("int")
    for i, h in reversed(list(enumerate(horizons, start=1))):
        tier = F.when(F.col("_d.t") <= F.col("t") + h, i).otherwise(tier)
    out = out.withColumn("tier", tier)
    hit = F.col("tier").isNotNull()
    return out.select(
        F.col("row_id").alias("anchor_id"),
        F.col("t").alias("anchor_t"),
        F.col("uid").alias("anchor_uid"),
        F.when(hit, F.col("_d.row_id")).alias("donor_id"),
        F.when(hit, F.col("_d.t")).alias("donor_t"),
        F.when(hit, F.col("_d.uid")).alias("donor_uid"),
        "tier",
    )
