"""Rules on a stream: each micro-batch is scored by the batch operators over what its rules can see.

The state lies in a shared folder.  The log is kept by day, and a batch reads the days of
the longest rule window alone.  What lies before is kept as versions of two small tables:

``accounts``  of every account the attempts that still tell something about its past: the
              latest attempt, the latest success, and one success for each country and
              user agent.  They stand in for all older attempts of the account.
``networks``  successes of real accounts per network.

A version holds everything before some day and is made from an earlier version and the
days in between, once, when the windows have moved on to a new day.  So what a batch reads
depends on the days of a window and the number of accounts, not on the age of the log.
Rows that come late but within the window only touch days that no version covers; a row
older than that makes the versions it belongs to invalid, and they are made again from an
earlier one.  Attempts already scored are not scored again.

A rerun of a batch after a failure writes the same partitions, versions and hits again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import DAY
from ..plans import rules as R

#: No rule parameter allows a longer window.
WINDOW_US = 7 * DAY
#: Versions remembered, so that rows older than the newest need not start from the whole log.
VERSIONS = 4


def account_past(rows: DataFrame) -> DataFrame:
    """The attempts that decide all that rules ask of an account's past; the past of these is the past of ``rows``."""
    known = rows.where(F.col("uid").isNotNull()).select("uid", "country", "ua", "success", F.struct("t", "row_id", *[c for c in rows.columns if c not in ("t", "row_id")]).alias("r"))
    won = known.where("success")
    latest = known.groupBy("uid").agg(F.max("r").alias("r")).select("r")
    success = won.groupBy("uid").agg(F.max("r").alias("r")).select("r")
    places = won.groupBy("uid", "country").agg(F.max("r").alias("r")).select("r")
    devices = won.groupBy("uid", "ua").agg(F.max("r").alias("r")).select("r")
    kept = latest.unionByName(success).unionByName(places).unionByName(devices)
    return kept.select("r.*").dropDuplicates(["row_id"]).select(*rows.columns)


def network_past(rows: DataFrame) -> DataFrame:
    """``asn, n``: successes that the network statistics count."""
    return rows.where(F.col("success") & F.col("uid").isNotNull() & F.col("asn").isNotNull()).groupBy("asn").agg(F.count(F.lit(1)).alias("n"))


class RuleStream:
    """``foreachBatch`` handler.  Lookups are re-read per batch, so edits take effect."""

    def __init__(self, state_path: str, hits_path: str, plan: R.Plan, intel: Callable[[SparkSession], R.Intel] = lambda spark: R.Intel()) -> None:
        self.state_path, self.hits_path, self.plan, self.intel = state_path, hits_path, plan, intel
        needs = {need for r, _, _ in plan.rules for need in r.needs}
        self.remembers = bool(needs & {"history", "global_stats"})

    def _log(self, spark: SparkSession, first: int, last: int, there: int) -> DataFrame:
        """The days ``first`` to ``last`` of the log; ``there`` is a day that it has."""
        root = f"{self.state_path}/log"
        reader = spark.read.option("basePath", root)
        # a short range is named, so that no other day is even listed
        log = reader.parquet(f"{root}/day={{{','.join(map(str, {*range(first, last + 1), there}))}}}") if last - first < 64 else reader.parquet(root)
        return log.where(F.col("day").between(first, last))

    def _versions(self, spark: SparkSession, batch_id: int) -> list[tuple[int, int]]:
        """(day, batch that made it) of the versions known before a batch; at most ``VERSIONS``."""
        if batch_id == 0:
            return []
        return [(r["day"], r["made"]) for r in spark.read.parquet(f"{self.state_path}/versions/batch={batch_id - 1}").collect()]

    def _remember(self, spark: SparkSession, batch_id: int, versions: list[tuple[int, int]]) -> None:
        rows = spark.createDataFrame(sorted(versions)[-VERSIONS:], "day bigint, made bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.state_path}/versions/batch={batch_id}")

    def _version(self, spark: SparkSession, table: str, version: tuple[int, int]) -> DataFrame:
        return spark.read.parquet(f"{self.state_path}/{table}/day={version[0]}-made={version[1]}")

    def _make(self, spark: SparkSession, base: tuple[int, int] | None, day: int, batch_id: int, there: int) -> tuple[int, int]:
        """A version of everything before ``day``."""
        root = f"{self.state_path}/log"
        rows = spark.read.option("basePath", root).parquet(root) if base is None else self._log(spark, base[0], day, there)
        rows = rows.where((F.col("batch") <= batch_id) & (F.col("day") < day)).drop("day", "batch")
        accounts, networks = rows, network_past(rows)
        if base is not None:
            accounts = accounts.unionByName(self._version(spark, "accounts", base))
            networks = networks.unionByName(self._version(spark, "networks", base)).groupBy("asn").agg(F.sum("n").alias("n"))
        account_past(accounts).write.mode("overwrite").parquet(f"{self.state_path}/accounts/day={day}-made={batch_id}")
        networks.write.mode("overwrite").parquet(f"{self.state_path}/networks/day={day}-made={batch_id}")
        return day, batch_id

    def context(self, spark: SparkSession, batch_id: int, span: tuple[int, int], version: tuple[int, int] | None) -> tuple[DataFrame, DataFrame | None]:
        """The attempts that the batch's rules can see, and the successes per network before them."""
        first, last = span
        log = self._log(spark, first, last, last).where(F.col("batch") <= batch_id)
        near = log.drop("day", "batch")
        if version is None:
            return near, None
        accounts = log.where((F.col("batch") == batch_id) & F.col("uid").isNotNull()).select("uid").distinct()
        past = self._version(spark, "accounts", version).join(accounts, "uid", "left_semi")
        # the attempts that stand in for the past count for themselves
        shown = network_past(past).select("asn", (-F.col("n")).alias("n"))
        networks = self._version(spark, "networks", version).unionByName(shown).groupBy("asn").agg(F.sum("n").alias("n"))
        return near.unionByName(past.select(*near.columns)), networks

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(["row_id"]).withColumns({"day": F.expr(f"t div {DAY}"), "batch": F.lit(batch_id).cast("bigint")})
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.state_path}/log")
        oldest, newest = batch.agg(F.min("t"), F.max("t")).first()
        versions = self._versions(spark, batch_id)
        if oldest is None:
            self._remember(spark, batch_id, versions)
            return
        versions = [v for v in versions if v[0] <= oldest // DAY]
        first = (oldest - WINDOW_US) // DAY
        version = None
        if self.remembers:
            base = max((v for v in versions if v[0] <= first), default=None)
            version = base if base is not None and base[0] == first else self._make(spark, base, first, batch_id, newest // DAY)
            versions = sorted({*versions, version})
        rows, networks = self.context(spark, batch_id, (first, newest // DAY), version)
        scored = R.evaluate(rows, self.plan, self.intel(spark), networks=networks)
        mine = batch.select("row_id").distinct()
        R.hits(scored).join(mine, "row_id", "left_semi").write.mode("overwrite").parquet(f"{self.hits_path}/batch={batch_id}")
        self._remember(spark, batch_id, versions)


def start(attempts: DataFrame, handler: RuleStream, checkpoint: str):
    return attempts.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
