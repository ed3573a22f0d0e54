"""Exact substring de-duplication with suffix automata.

A word goes if a window of 50 words that covers it also starts in a row of smaller id.

The reference is the corpus itself and has no size bound, so its automata are not
broadcast: reference shards and the passages asked of them are brought together by
anchors.  The anchor of a window is its word 10-gram of least hash; equal windows
have equal anchors.  The windows of a row that share an anchor form one passage.

1. Anchors seen in rows of at least two ids are kept; all others cannot repeat.
2. Of rows with the same passage at an anchor, all but that of the least id lose it
   whole.  A passage repeated a million times is one reference.
3. Anchors with several distinct passages (the places where copies differ) are the
   shards: the passages of smaller ids make up a suffix automaton, each further
   passage is streamed through it, and the spans where the matching statistic
   reaches 50 words go.
4. A shard of more than ``SHARD`` distinct passages is not built in one task: its
   windows meet by hash instead, with minima combined before the shuffle.  Same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored

WINDOW = 50
GRAM = 10
SHARD = 1_000
_CHUNK = 1 << 16
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def passages(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, passage hash, first word and end of every passage of a row's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    with np.errstate(over="ignore"):
        m, grams = mixed(h), np.zeros(len(h) - gram + 1, np.uint64)
        for j in range(gram):
            grams = grams * np.uint64(_P) + m[j : j + len(grams)]
        grams = mixed(grams)
        reach = window - gram + 1
        at = np.empty(n, np.int64)
        for lo in range(0, n, _CHUNK):
            hi = min(n, lo + _CHUNK)
            at[lo:hi] = np.lib.stride_tricks.sliding_window_view(grams[lo : hi + reach - 1], reach).argmin(axis=1) + np.arange(lo, hi)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        end = np.append(first[1:], n) + window - 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(m * _powers(_P, len(m)))))
        back = _powers(_P_INVERSE, len(m))
        whole = mixed((sums[end] - sums[first]) * back[first]) + (at[first] - first).astype(np.uint64) * np.uint64(_P) + (end - first).astype(np.uint64)
    return grams[at[first]], mixed(whole), first.astype(np.int32), end.astype(np.int32)


class Automaton:
    """A suffix automaton over integer words; sequences are kept apart by words of their own."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.breaks = [-1], [0], 0, 0

    def _state(self, length: int, link: int, then: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(then)
        return len(self.length) - 1

    def _extend(self, word: int) -> None:
        now, p = self._state(self.length[self.last] + 1, 0, {}), self.last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] != self.length[p] + 1:
                copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            self.link[now] = q
        self.last = now

    def add(self, words: list[int]) -> None:
        self.breaks += 1
        for w in words:
            self._extend(w)
        self._extend(-self.breaks)

    def statistics(self, words: list[int]) -> Iterator[int]:
        """For every word the length of the longest match that ends with it."""
        at, size = 0, 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if w in self.next[at]:
                at, size = self.next[at][w], size + 1
            yield size


def repeated_spans(shard: list[tuple], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For passages (id, words), sorted by id, the maximal spans made of windows that a passage of smaller id holds."""
    automaton, out, held = Automaton(), [], 0
    codes: dict[int, int] = {}
    coded = [(i, [codes.setdefault(w, len(codes)) for w in words]) for i, words in shard]
    for k, (i, words) in enumerate(coded):
        while coded[held][0] < i:
            automaton.add(coded[held][1])
            held += 1
        spans: list[list[int]] = []
        for end, size in enumerate(automaton.statistics(words), 1) if held else ():
            if size >= window:
                if spans and end - window <= spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([end - window, end])
        out.append([tuple(s) for s in spans])
    return out


def _marks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``_key, _id, _th, n_words, sha`` and ``parts`` per row: each distinct passage (anchor, hash) once, with its width and the
    words it starts at; the text goes."""
    kind = dict(docs.dtypes)["_key"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, shas, parts, rows, starts = [], [], [], [0], [0]
            for x in b.column("_text").to_pylist():
                words = split(x)
                fp, ctx, first, end = passages(word_hashes(words), window, gram)
                order = np.lexsort((first, ctx, fp))
                fp, ctx, first, end = fp[order], ctx[order], first[order], end[order]
                new = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])))) if len(fp) else order
                n.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                parts.append((fp[new], ctx[new], (end - first)[new], first))
                rows.append(rows[-1] + len(new))
                starts += (starts[-1] + np.append(new[1:], len(fp))).tolist() if len(new) else []
            flat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(4)]
            at = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat[3].astype(np.int32)))
            struct = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), pa.array(flat[2].astype(np.int32)), at], names=["fp", "ctx", "width", "at"])
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_id"), b.column("_th"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), struct)], names=["_key", "_id", "_th", "n_words", "sha", "parts"])

    return docs.mapInArrow(run, f"_key {kind}, _id long, _th long, n_words long, sha string, parts array<struct<fp:long,ctx:long,width:int,at:array<int>>>")


def _asked(held: DataFrame) -> DataFrame:
    """``fp, crowded, _id, _th, at, words``: the word hashes of the passages that a row asks about, with the places they start at."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, th, text, marks in zip(*(b.column(c).to_pylist() for c in ("_id", "_th", "_text", "marks")), strict=True):
                asks = [m for m in marks if m["ask"]]
                if not asks:
                    continue
                h = word_hashes(split(text)).view(np.int64)
                for lo in range(0, len(asks), 512):
                    part = asks[lo : lo + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m["fp"] for m in part], pa.int64()), pa.array([m["crowded"] for m in part], pa.bool_()), pa.array([i] * len(part), pa.int64()), pa.array([th] * len(part), pa.int64()), pa.array([m["at"] for m in part], pa.list_(pa.int32())), pa.array([h[m["at"][0] : m["at"][0] + m["width"]] for m in part], pa.list_(pa.int64()))],
                        names=["fp", "crowded", "_id", "_th", "at", "words"],
                    )

    return held.mapInArrow(run, "fp long, crowded boolean, _id long, _th long, at array<int>, words array<long>")


def _by_automata(asked: DataFrame, window: int) -> DataFrame:
    """Spans of the passages of ordinary shards; rows come sorted by shard, one shard is in memory at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(shard: list) -> pa.RecordBatch:
            rows = [(i, th, s + lo, s + hi) for (i, th, at, _), spans in zip(shard, repeated_spans([(r[0], r[3]) for r in shard], window), strict=True) for lo, hi in spans for s in at]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_id", "_th", "s", "e"])

        now, shard = None, []
        for b in it:
            for fp, *row in zip(*(b.column(c).to_pylist() for c in ("fp", "_id", "_th", "at", "words")), strict=True):
                if fp != now and shard:
                    yield answer(shard)
                    shard = []
                now = fp
                shard.append(row)
        if shard:
            yield answer(shard)

    rows = asked.where("not crowded").repartition("fp").sortWithinPartitions("fp", "_id", "_th")
    return rows.select("fp", "_id", "_th", "at", "words").mapInArrow(run, "_id long, _th long, s int, e int")


def _by_windows(asked: DataFrame, window: int) -> DataFrame:
    """Spans of the passages of crowded shards, window by window."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = _powers(_P, window)[::-1]
        for b in it:
            for i, th, at, words in zip(*(b.column(c).to_pylist() for c in ("_id", "_th", "at", "words")), strict=True):
                with np.errstate(over="ignore"):
                    m = mixed(np.array(words, np.int64).view(np.uint64))
                    seen = np.lib.stride_tricks.sliding_window_view(m, window)
                    one, two = (seen * scale).sum(axis=1, dtype=np.uint64), (mixed(seen + np.uint64(1)) * scale).sum(axis=1, dtype=np.uint64)
                n = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([i] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array([at] * n, pa.list_(pa.int32()))], names=["one", "two", "_id", "_th", "off", "at"])

    windows = stored(asked.where("crowded").mapInArrow(run, "one long, two long, _id long, _th long, off int, at array<int>"))
    first = windows.groupBy("one", "two").agg(F.min("_id").alias("_first"))
    return windows.join(first, ["one", "two"]).where("_id > _first").select("_id", "_th", "off", F.explode("at").alias("s")).select("_id", "_th", (F.col("s") + F.col("off")).alias("s"), (F.col("s") + F.col("off") + window).alias("e"))


def _removed(held: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, kept, spans = [], [], []
            for text, marks, more in zip(*(b.column(c).to_pylist() for c in ("_text", "marks", "more")), strict=True):
                words = split(text)
                keep = np.ones(len(words), bool)
                for m in marks:
                    for s in () if m["ask"] else m["at"]:
                        keep[s : s + m["width"]] = False
                for m in more or ():
                    keep[m["s"] : m["e"]] = False
                n.append(int(len(words) - keep.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode("utf-8", "replace"))
                edges = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                spans.append([{"s": s, "e": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["_id", "_th", "n_removed", "kept", "spans"])

    return held.mapInArrow(run, "_id long, _th long, n_removed long, kept string, spans array<struct<s:int,e:int>>")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(rows, changed)``: per row ``_id, _th, key, n_words, sha`` (of the whole text's words), and for rows that lose words
    ``_id, _th, n_removed, kept`` (text) and ``spans`` of removed words.

    Null and empty texts have no words.  A null key counts as larger than any other.  Rows of one key never remove each
    other's words; equal rows appear in ``changed`` once each.  Other columns of ``docs`` are not read.
    """
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"), F.col(text).alias("_text"))
    rows = stored(_marks(slim, window, gram))
    parts = rows.select("_id", "_th", F.explode("parts").alias("p")).select("_id", "_th", "p.*")
    anchors = stored(parts.groupBy("fp").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), (F.min("ctx") < F.max("ctx")).alias("_several")).where("_lo < _hi").select("fp", "_several"))  # stored, so that the joins with it can split hot anchors
    repeated = stored(parts.join(anchors, "fp"))
    firsts = stored(repeated.groupBy("fp", "ctx").agg(F.min("_id").alias("_first"), F.first("_several").alias("_several")))
    crowds = firsts.where("_several").groupBy("fp").count().where(F.col("count") > shard).select("fp", F.lit(True).alias("_crowd"))
    crowds = stored(crowds)
    told = stored(firsts.join(crowds, "fp", "left").select("fp", "ctx", "_first", "_several", F.coalesce("_crowd", F.lit(False)).alias("crowded")))
    known = repeated.drop("_several").join(told, ["fp", "ctx"]).where("_id > _first or _several")
    mark = F.struct("fp", "width", "at", "crowded", (F.col("_id") == F.col("_first")).alias("ask"))
    marks = known.groupBy("_id", "_th").agg(F.collect_list(mark).alias("marks"))  # bounded by the row's own length
    held = stored(slim.select("_id", "_th", "_text").join(stored(marks), ["_id", "_th"]))
    asked = stored(_asked(held))
    found = _by_automata(asked, window)
    if not crowds.isEmpty():
        found = found.unionByName(_by_windows(asked, window))
    more = found.groupBy("_id", "_th").agg(F.collect_list(F.struct("s", "e")).alias("more"))
    changed = _removed(held.join(more, ["_id", "_th"], "left").where(F.col("more").isNotNull() | F.exists("marks", lambda m: ~m["ask"])))
    return rows.select("_id", "_th", F.col("_key").alias(key), "n_words", "sha"), changed


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` per row of ``docs``."""
    rows, changed = dedup(docs, key, text, **options)
    lost = changed.select("_id", "_th", "n_removed", F.sha2("kept", 256).alias("_kept")).dropDuplicates(["_id", "_th"])
    return rows.join(lost, ["_id", "_th"], "left").select(key, "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("_kept", "sha").alias("kept_sha256"))
