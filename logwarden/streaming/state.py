"""Per-key state for streams: anchored alert groups.

``applyInPandasWithState`` keeps, per key, only what a window can still need.  Event time
drives expiry through the watermark.  Sliding windows are in ``sliding``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .sliding import WATERMARK


def alert_groups(alerts: DataFrame, window_us: int, *, watermark: str = WATERMARK) -> DataFrame:
    """Anchored groups of a stream of alerts (``ts, t, row_id, dedup_key, family, score``).

    Every alert comes out with its group's first time and its position in the group.
    """
    base = alerts.select("ts", "t", "row_id", "score", F.concat_ws("|", "dedup_key", "family").alias("k"))

    def update(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, count, worst = state.get if state.exists else (None, 0, 0)
        out = []
        for t, rid, score in pd.concat(list(batches)).sort_values(["t", "row_id"])[["t", "row_id", "score"]].itertuples(index=False):
            if anchor is None or t > anchor + window_us:
                anchor, count, worst = int(t), 0, 0
            count, worst = count + 1, max(worst, int(score))
            out.append((rid, key_[0], anchor, count, worst))
        state.update((anchor, count, worst))
        state.setTimeoutTimestamp(max((anchor + window_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["row_id", "k", "anchor_t", "occurrence", "max_score"])

    return (
        base.withWatermark("ts", watermark)
        .groupBy("k")
        .applyInPandasWithState(
            update,
            "row_id bigint, k string, anchor_t bigint, occurrence bigint, max_score bigint",
            "anchor bigint, count bigint, worst bigint",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
