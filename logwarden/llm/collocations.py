"""Phrase collocation mining by stripes.

A stripe belongs to a prefix of words: an associative counter of the words that follow
it, with one more entry (null) for occurrences that nothing countable follows.  Tasks
build stripes over windows of text, one shuffle brings the stripes of a prefix together
and they are merged entry by entry.  From the merged stripes come the extensions (the
frequent entries), the prefix totals (the sum of all entries, so a phrase's own count)
and the subsumption maxima (the largest extension).

Four passes, one for each length.  A pass counts only prefixes and next words whose
shorter phrases were frequent in the pass before; everything else is added to the null
entry.  Tasks ask a Bloom filter of bounded size for that: a false "yes" costs a row and
changes no count.  A word with at least 1/4096 of all words is hot (so there are at
most 4,096); a prefix made of hot words alone has its stripe cut into segments by a hash
of the next word, as many as its rarest word has such shares, and no segment holds much
more than one.

A text longer than a window is cut at a piece, or inside a piece with the last words
repeated, so that memory does not follow the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_UPPER, HEAVY, mixed, spread_join, stored

LENGTH = 4
MIN_COUNT = 30
TOP = 2_000
SUBSUMED_PERCENT = 80
SCALE = 2_000_000
HOT_SHARE = 4_096
#: Bytes of text encoded at once.
WINDOW_BYTES = 8 << 20
#: The Bloom filter: bits for each phrase, and at most 32 MB; beyond it only false positives grow.
BLOOM_BITS_EACH = 12
BLOOM_MOST_BITS = 1 << 28
PROBES = 4
RANK_SALTS = 64
#: ``next`` holds the next words separated by blanks, ``n`` their counts, ``alone`` the count of the null entry.
STRIPE = "lang string, prefix string, seg int, alone int, next string, n array<int>"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(ASCII_UPPER.encode() + b"\t" + _BREAKS, ASCII_UPPER.lower().encode() + b" " + b"\n" * len(_BREAKS))
_SEPARATOR = re.compile(rb"[ \n]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _cut(text: bytes, size: int, k: int) -> tuple[int, int, bool]:
    """Where the first window of a long text ends, where the next begins, and whether the piece goes on."""
    end = text.rfind(b"\n", 0, size)
    if end >= 0:
        return end, end + 1, False
    end = size
    while (m := _SEPARATOR.search(text, end)) is not None:
        end = m.start()
        if text[end] == 10:
            return end, end + 1, False
        back = end
        for _ in range(k - 1):
            while back > 0 and text[back - 1] == 32:
                back -= 1
            back = text.rfind(b" ", 0, back) + 1
        if back > 0:
            return end, back, True
        end += 1
    return len(text), len(text), False


def windows(texts: Iterable[bytes], k: int, size: int = WINDOW_BYTES) -> Iterator[tuple[bytes, bool]]:
    """The texts in lower case as windows of about ``size`` bytes, words between blanks, pieces between line feeds.

    The flag tells that the last piece goes on; the next window then repeats its last ``k - 1`` words.
    """
    held: list[bytes] = []
    room = size
    for text in texts:
        text = text.translate(_TABLE)
        while len(text) > size:
            end, onward, open_end = _cut(text, size, k)
            yield text[:end], open_end
            text = text[onward:]
        if len(text) > room and held:
            yield b"\n".join(held), False
            held, room = [], size
        held.append(text)
        room -= len(text) + 1
    if held:
        yield b"\n".join(held), False


def encoded(window: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word in the dictionary, number of its piece, dictionary)."""
    raw = np.frombuffer(window, np.uint8)
    gap = (raw == 32) | (raw == 10)
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    breaks = np.flatnonzero(raw == 10)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[~gap]))]).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(breaks, starts), flat.dictionary.cast(pa.string())


def word_hashes(words: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h * _STEP + word)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = mixed(h ^ _STEP) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) & np.uint64(bits - 1)


def _known(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in _probes(h, 64 * len(bloom)):
        out &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def window_stripes(window: bytes, open_end: bool, lang: str, k: int, hot: dict[str, int], bloom: np.ndarray | None) -> tuple | None:
    """The columns of ``STRIPE`` after the first: the stripes of all prefixes of ``k - 1`` words in a window."""
    ids, piece, words = encoded(window)
    n = len(ids)
    if n < max(1, k - 1):
        return None
    names = words.to_pylist()
    hashes = word_hashes(names)
    size = len(names)
    if k == 1:
        prefix, nexts, spots = np.zeros(n, np.int64), ids, np.zeros(1, np.int64)
        segments = np.full(1, HOT_SHARE, np.uint64)
    else:
        m = n - k + 2
        h = np.full(m, xxhash.xxh64_intdigest(lang), np.uint64)
        for j in range(k - 1):
            h = _chained(h, hashes[ids[j : j + m]])
        frequent = (piece[:m] == piece[k - 2 :]) & _known(bloom, h)
        follows = np.zeros(m, bool)
        follows[:-1] = (piece[: m - 1] == piece[k - 1 :]) & frequent[1:]
        if open_end:  # what follows the last words is in the next window
            frequent[-1] = False
        at = np.flatnonzero(frequent)
        if not len(at):
            return None
        nexts = np.where(follows[at], ids[np.minimum(at + k - 1, n - 1)], size)
        prefix = ids[at]
        for j in range(1, k - 1):
            prefix = np.unique(prefix * size + ids[at + j], return_inverse=True)[1]
        _, first, prefix = np.unique(prefix, return_index=True, return_inverse=True)
        spots = at[first]
        shares = np.array([hot.get(w, 1) for w in names], np.uint64)
        segments = np.minimum.reduce([shares[ids[spots + j]] for j in range(k - 1)])
    cells, counts = np.unique(prefix * (size + 1) + nexts, return_counts=True)
    prefix, nexts = np.divmod(cells, size + 1)
    none = nexts == size
    seg = np.where(none, 0, (hashes[np.where(none, 0, nexts)] % segments[prefix]).astype(np.int64))
    order = np.lexsort((nexts, seg, prefix))
    prefix, nexts, seg, counts, none = prefix[order], nexts[order], seg[order], counts[order], none[order]
    runs = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (seg[1:] != seg[:-1]))))
    owner = spots[prefix[runs]]
    parts = [words.take(pa.array(ids[owner + j])) for j in range(k - 1)]
    named = pa.array([""] * len(runs)) if k == 1 else parts[0] if k == 2 else pc.binary_join_element_wise(*parts, " ")
    alone = np.add.reduceat(np.where(none, counts, 0), runs)
    offsets = pa.array(np.concatenate(([0], np.cumsum(~none)))[np.concatenate((runs, [len(counts)]))].astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(nexts[~none]))), " ")
    cells = pa.ListArray.from_arrays(offsets, pa.array(counts[~none].astype(np.int32)))
    return named, pa.array(seg[runs].astype(np.int32)), pa.array(alone.astype(np.int32)), joined, cells


def stripes(docs: DataFrame, k: int, hot: dict[str, dict[str, int]], bloom: Broadcast | None) -> DataFrame:
    """``STRIPE`` rows, as found in each window: ``docs`` has ``lang, text`` without nulls."""
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("seg", pa.int32()), ("alone", pa.int32()), ("next", pa.string()), ("n", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for window, open_end in windows(texts, k, WINDOW_BYTES):
                    found = window_stripes(window, open_end, lang, k, hot.get(lang, {}), bloom.value if bloom else None)
                    if found is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[0]), pa.string()), *found], schema=schema)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                raw = text.as_py()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= WINDOW_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, STRIPE)


def merged(found: DataFrame, min_count: int) -> DataFrame:
    """``lang, prefix, seg, total, extensions, best``: the stripes of a prefix (and segment) added entry by entry.

    Stripes are shuffled whole; the sums need no further exchange.  ``extensions`` keeps the entries of at least
    ``min_count``, ``total`` counts them all.
    """
    cell = "array<struct<next:string,n:int>>"
    words = F.when(F.col("next") != "", F.arrays_zip(F.split("next", " ").alias("next"), "n")).otherwise(F.array()).cast(cell)
    none = F.when(F.col("alone") > 0, F.array(F.struct(F.lit(None).cast("string").alias("next"), F.col("alone").alias("n")))).otherwise(F.array()).cast(cell)
    entries = found.repartition("lang", "prefix", "seg").select("lang", "prefix", "seg", F.explode(F.concat(words, none)).alias("e")).select("lang", "prefix", "seg", F.col("e")["next"].alias("next"), F.col("e")["n"].alias("n"))
    summed = entries.groupBy("lang", "prefix", "seg", "next").agg(F.sum("n").alias("n"))
    large = F.col("next").isNotNull() & (F.col("n") >= min_count)
    return summed.groupBy("lang", "prefix", "seg").agg(
        F.sum("n").alias("total"), F.collect_list(F.when(large, F.struct("next", "n"))).alias("extensions"), F.max(F.when(large, F.col("n"))).alias("best")
    )


def extensions(table: DataFrame) -> DataFrame:
    """``lang, prefix, next, phrase, n``: the frequent entries of merged stripes."""
    rows = table.select("lang", "prefix", F.explode("extensions").alias("e")).select("lang", "prefix", F.col("e")["next"].alias("next"), F.col("e")["n"].alias("n"))
    return rows.select("lang", "prefix", "next", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "n")


def bloom_filter(phrases: DataFrame) -> np.ndarray:
    """A filter of ``lang, phrase``, built by the tasks and put together from its words, at most ``BLOOM_MOST_BITS`` bits."""
    bits = 1 << 13
    while bits < min(BLOOM_MOST_BITS, BLOOM_BITS_EACH * phrases.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            if not split:
                continue
            h = word_hashes(batch.column("lang").to_pylist())
            for j in range(len(split[0])):
                h = _chained(h, word_hashes(p[j] for p in split))
            at = np.unique(np.concatenate(list(_probes(h, bits))))
            slot, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_pydict({"slot": slot.astype(np.int64), "mask": mask.view(np.int64)})

    words = phrases.select("lang", "phrase").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words.column("slot").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return bloom


def _joined(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scores(candidates: DataFrame, totals: DataFrame, everything: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the lowest-scoring cut of each candidate (ties: the first)."""
    heavy = F.col("total") * HEAVY >= F.lit(everything)
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w")).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = spread_join(cuts, totals.select("lang", F.col("phrase").alias(part), "total"), ["lang", part], heavy, ["phrase", "k"]).withColumnRenamed("total", name)
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("l", whole("l")).withColumn("r", whole("r")).withColumn("a", whole("a"))
    cuts = cuts.withColumn("score", F.expr(f"CAST(a * {SCALE} div (l + r) AS BIGINT)"))
    low = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c"))
    return low.select("lang", "phrase", *[F.col("c")[c].cast("long").alias(c) for c in ("a", "l", "r", "score")])


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", *, length: int = LENGTH, min_count: int = MIN_COUNT, top: int = TOP, subsumed_percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each language.

    Null texts are empty, a null language is ``und`` (together with the value ``und``).  Repeated rows count each.  Equal
    scores are ordered by ``a`` and then by the phrase's bytes, so no two share a rank.  Texts without words add nothing,
    an empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tables = [stored(merged(stripes(rows, 1, {}, None), min_count))]
    n = tables[0].groupBy("lang").agg(F.sum("total").alias("n"))
    everything = n.agg(F.sum("n")).first()[0] or 0
    frequent = extensions(tables[0])
    # at most HOT_SHARE words
    hot: dict[str, dict[str, int]] = {}
    for r in frequent.where(F.col("n") * HOT_SHARE >= F.lit(everything)).collect():
        hot.setdefault(r["lang"], {})[r["phrase"]] = -(-r["n"] * HOT_SHARE // everything)
    for k in range(2, length + 1):
        bloom = spark.sparkContext.broadcast(bloom_filter(extensions(tables[-1])))
        tables.append(stored(merged(stripes(rows, k, hot, bloom), min_count)))
        bloom.destroy()
    longer = tables[1:]
    totals = candidates = above = None
    for table in longer:
        prefixes = table.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("total"), F.max("best").alias("best"))
        found = extensions(table)
        lefts = found.select("lang", F.concat_ws(" ", F.expr("substring(prefix, locate(' ', prefix) + 1)"), "next").alias("phrase"), F.col("n").alias("best")).where("locate(' ', prefix) > 0") if table is not longer[0] else None
        part = found.select("lang", "phrase", F.col("n").alias("a"))
        totals = prefixes.select("lang", "phrase", "total") if totals is None else totals.unionByName(prefixes.select("lang", "phrase", "total"))
        candidates = part if candidates is None else candidates.unionByName(part)
        if lefts is not None:
            both = lefts.unionByName(prefixes.select("lang", "phrase", "best").where("best is not null"))
            above = both if above is None else above.unionByName(both)
    candidates = stored(candidates)
    scored = scores(candidates, totals, everything)
    if above is not None:
        # a phrase inside a longer candidate is inside one that is a single word longer and at least as frequent
        above = above.groupBy("lang", "phrase").agg(F.max("best").alias("best"))
        whole = lambda c, m: F.col(c).cast("decimal(20,0)") * m
        scored = scored.join(above, ["lang", "phrase"], "left").where(F.col("best").isNull() | (whole("best", 100) < whole("a", subsumed_percent))).drop("best")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
