"""Sliding windows over a stream, exact for rows that come late within the watermark's slack.

An attempt is answered once the watermark has passed it, when every attempt before it is
known; until then it waits in the state.  A timer on the earliest waiting attempt wakes
the key, all attempts up to the watermark are walked in time order, and what no window
can reach any more is forgotten value by value.  A key that nothing waits for clears
itself when its last attempt leaves the window.

A hot key is split.  Its attempts are dealt to ``parts`` groups by name and asked from
``parts`` groups by row; each pair of groups is a state of its own (a cell), which holds
one part of the names and answers one part of the rows.  The partial counts of a row are
added downstream; a name lives in one group, so distinct names add up as well.  Other
keys are one cell.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "60 seconds"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ANSWER = "ts timestamp, row_id bigint, k string, t bigint, fails bigint, oks bigint, names bigint"


def use_rocksdb(spark: SparkSession) -> None:
    """States with maps, lists and timers need the RocksDB store; another store named by the session is left to fail there."""
    if spark.conf.get(PROVIDER, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


class SlidingCounts(StatefulProcessor):
    """One cell: waiting attempts (a list), attempts per instant and last sightings of names (maps), one timer."""

    def __init__(self, window_us: int) -> None:
        self.window = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, row_id bigint, name string, ok boolean, event boolean, asked boolean")
        self.times = handle.getMapState("times", "t bigint", "fails bigint, oks bigint")
        self.names = handle.getMapState("names", "name string", "last bigint")
        self.wake = handle.getValueState("wake", "at bigint")

    def _wake_at(self, t_us: int) -> None:
        """Keep a single timer, at the first millisecond not before ``t_us``."""
        at = -(-t_us // 1000)
        held = self.wake.get()
        if held is not None:
            if held[0] <= at:
                return
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            self.waiting.appendList(list(pdf[["t", "row_id", "name", "ok", "event", "asked"]].itertuples(index=False, name=None)))
            first = int(pdf["t"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake_at(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(r for r in rows if r[0] <= upto), [r for r in rows if r[0] > upto]
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        counts = {k[0]: list(v) for k, v in self.times.iterator()}
        seen = {k[0]: v[0] for k, v in self.names.iterator()}
        out = self._walk(due, counts, seen)
        # nothing before the watermark will come, so no window opens before it
        keep = upto - self.window
        self._store(counts, seen, due, keep)
        nexts = [min(r[0] for r in later)] if later else []
        live = [t for t in (max(counts, default=None), max(seen.values(), default=None)) if t is not None and t > keep]
        if nexts or live:
            self._wake_at(min(nexts) if nexts else max(live) + self.window)
        if out:
            yield pd.DataFrame([(pd.Timestamp(t, unit="us"), rid, key[0], t, f, o, n) for rid, t, f, o, n in out], columns=["ts", "row_id", "k", "t", "fails", "oks", "names"])

    def _walk(self, due: list[tuple], counts: dict, seen: dict) -> list[tuple]:
        """Partial answers of the due rows; ``counts`` and ``seen`` take up their events."""
        line = deque(sorted((t, f, o) for t, (f, o) in counts.items()))
        fails, oks = sum(x[1] for x in line), sum(x[2] for x in line)
        order = deque(sorted((t, name) for name, t in seen.items()))  # a name stands here once for each sighting still to expire
        alive, out = len(seen), []
        # stream order: rows of one instant see those of smaller row_id
        for t, rid, name, ok, event, asked in due:
            if event:
                counts.setdefault(t, [0, 0])[1 if ok else 0] += 1
                line.append((t, int(not ok), int(bool(ok))))
                fails, oks = fails + (not ok), oks + bool(ok)
                if not ok:
                    alive += name not in seen
                    seen[name] = t
                    order.append((t, name))
            since = t - self.window
            while line and line[0][0] <= since:
                _, f, o = line.popleft()
                fails, oks = fails - f, oks - o
            while order and order[0][0] <= since:
                last, gone = order.popleft()
                if seen.get(gone) == last:
                    del seen[gone]
                    alive -= 1
            if asked:
                out.append((rid, t, fails, oks, alive))
        return out

    def _store(self, counts: dict, seen: dict, due: list[tuple], keep: int) -> None:
        """Write what changed, drop what is out of reach."""
        touched = {r[0] for r in due if r[4]}
        for (t,), _ in list(self.times.iterator()):
            if t <= keep:
                self.times.removeKey((t,))
        for t in sorted(touched):
            if t > keep:
                self.times.updateValue((t,), tuple(counts[t]))
        for name, last in [(k[0], v[0]) for k, v in self.names.iterator()]:
            if seen.get(name, keep) <= keep:
                self.names.removeKey((name,))
        for name in sorted({r[2] for r in due if r[4] and not r[3]}):
            if seen.get(name, keep) > keep:
                self.names.updateValue((name,), (seen[name],))

    def close(self) -> None:
        pass


def sliding_counts(attempts: DataFrame, key: str, window_us: int, *, watermark: str = WATERMARK, hot: Sequence[str] = (), parts: int = 4) -> DataFrame:
    """Per attempt: failures, successes and distinct failing names of the key in (t-w, t], once the watermark has passed it.

    ``attempts`` is a stream with ``ts TIMESTAMP, t, row_id, username, success`` and the key.  Keys named in ``hot`` are
    split into ``parts * parts`` cells; naming a key changes where it is counted, never the counts.
    """
    use_rocksdb(attempts.sparkSession)
    base = attempts.where(F.col(key).isNotNull()).withWatermark("ts", watermark)
    base = base.select("ts", "t", "row_id", F.coalesce("username", F.lit("")).alias("name"), F.col("success").alias("ok"), F.col(key).cast("string").alias("k"))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    cell = lambda e, q, event, asked: F.struct(e.alias("e"), q.alias("q"), event.alias("event"), asked.alias("asked"))
    own_e, own_q, yes = group("name"), group("row_id"), F.lit(True)
    one = F.array(cell(F.lit(0), F.lit(0), yes, yes))
    grid = F.array(*[cell(F.lit(e), F.lit(q), own_e == e, own_q == q) for e in range(parts) for q in range(parts)])
    split = F.filter(grid, lambda c: c["event"] | c["asked"])
    cells = F.when(F.col("k").isin(list(hot)), split).otherwise(one) if hot else one
    dealt = base.withColumn("c", F.explode(cells)).select("ts", "t", "row_id", "name", "ok", "k", "c.e", "c.q", "c.event", "c.asked")
    partial = dealt.groupBy("k", "e", "q").transformWithStateInPandas(SlidingCounts(window_us), _ANSWER, "append", "EventTime", eventTimeColumnName="ts")
    # the partial answers of a row come in one batch: they are added and leave at once
    added = partial.groupBy("ts", "row_id", "k", "t").agg(*[F.sum(c).alias(c) for c in ("fails", "oks", "names")])
    return added.select("row_id", "k", "t", "fails", "oks", "names")
