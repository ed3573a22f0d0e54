"""Stream sources, dashboard counts, exactly-once hits and progress metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .sliding import WATERMARK


def read_attempt_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Attempts from a growing Parquet folder, with an event-time column ``ts``."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.timestamp_micros("t"))


def tumbling_failures(attempts: DataFrame, key: str, width: str = "5 minutes") -> DataFrame:
    """Attempts and failures per key and tumbling window, for dashboards."""
    out = attempts.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), F.col(key).alias("key"))
    return out.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("success")).alias("fails")).select(
        F.col("w.start").alias("window_start"), "key", "attempts", "fails"
    )


def unique_hits(hits: DataFrame) -> DataFrame:
    """One row per (attempt, rule) even if the source repeats rows within the watermark."""
    return hits.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["row_id", "rule_id"])


class Progress(StreamingQueryListener):
    """Keeps a bounded list of batch durations and late-row counts per query."""

    def __init__(self, keep: int = 1_000) -> None:
        self.keep, self.durations, self.late = keep, [], 0

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.durations = (self.durations + [p.batchDuration])[-self.keep :]
        self.late += sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def percentiles(self) -> dict[str, float] | None:
        if not self.durations:
            return None
        ordered = sorted(self.durations)
        at = lambda q: float(ordered[min(len(ordered) - 1, max(0, -(-len(ordered) * q // 100) - 1))])
        return {"p50": at(50), "p95": at(95), "p99": at(99)}
