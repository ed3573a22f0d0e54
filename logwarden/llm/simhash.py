"""SimHash near-duplicates by segment popcounts.

A fingerprint is 64 bits.  Each half is cut into sixteen 2-bit segments and mapped to
its per-segment bit counts, a point of a small grid.  The Manhattan distance of two
points never exceeds the Hamming distance of the halves, and of 4 differing bits at
most 2 lie in one of the halves.  So linked fingerprints lie within Manhattan
distance 2 in a half; both then reach a common grid cell by a step of at most one.
Every fingerprint is put into the cells one step away (about 25 a half), cells are
joined, and candidates are verified on all 64 bits.

No pairs are emitted inside a cell: a cell yields a spanning forest of its verified
links, at most one edge per member.  A cell of more than ``CELL`` fingerprints is not
compared pairwise: its members meet in exact midpoints instead (two fingerprints
differ in at most 4 bits exactly if they share a point 2 bits from one and 1 or 2
bits from the other), which is linear and exact.  Equal fingerprints are collapsed
before, so copies never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stored
from .forest import components

BITS = 4
CELL = 512
SHINGLE = 4
SEED = 42
_CHUNK = 1 << 14
_DEAL = 1_000  # fingerprints of a task that makes points


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK].tolist(), last[at : at + _CHUNK].tolist(), strict=False)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``fp``, the fingerprint of the whole text as a signed long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(x, shingle) for x in b.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            rest = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(fps)], names=[*rest, "fp"])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != text), "fp long"]))


def _cells(fps: DataFrame) -> DataFrame:
    """``cell, fp``: the grid cells within one step of the counts of either half."""
    out = []
    for half, part in enumerate((F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))):
        pairs = F.lit(0x55555555)
        counts = (part.bitwiseAND(pairs) + F.shiftrightunsigned(part, 1).bitwiseAND(pairs)).cast("long")
        around = [counts]
        for lane in range(16):
            one = 1 << (2 * lane)
            here = counts.bitwiseAND(F.lit(3 * one))
            around += [F.when(here < 2 * one, counts + one), F.when(here > 0, counts - one)]
        tag = half << 33
        out.append(fps.select(F.explode(F.array_compact(F.array(*around))).alias("cell"), "fp").withColumn("cell", F.col("cell") + F.lit(tag)))
    return out[0].unionByName(out[1])


def _forests(cells: DataFrame, bits: int) -> DataFrame:
    """Spanning forests of the verified links inside each cell, as edges ``a, b``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column("fps")
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes, a, b = np.diff(offsets), [], []
            two = offsets[:-1][sizes == 2]
            near = np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= bits
            a.append(values[two][near])
            b.append(values[two + 1][near])
            for i in np.flatnonzero(sizes > 2):
                v = np.sort(values[offsets[i] : offsets[i + 1]])
                left = np.arange(len(v))  # not reached yet
                front = left[:0]
                while len(left):
                    if not len(front):
                        front, left = left[:1], left[1:]
                        continue
                    x, front = front[0], front[1:]
                    hit = np.bitwise_count((v[left] ^ v[x]).view(np.uint64)) <= bits
                    if hit.any():
                        a.append(v[left[hit]])
                        b.append(np.full(int(hit.sum()), v[x]))
                        front, left = np.concatenate((front, left[hit])), left[~hit]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _midpoints(fps: DataFrame) -> DataFrame:
    """Edges from every fingerprint to the least one that shares a point 1 or 2 bits away (the exact test for at most 4 bits).

    A point has 2,080 fingerprints around it, so groups are small whatever the input.  There is no join: the size of
    what Python makes is not known before it runs, and the planner would send all points through the driver.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        i, j = np.triu_indices(64, 1)
        masks = np.concatenate((one, one[i] ^ one[j]))
        for batch in it:
            v = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(v), 64):
                x = v[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(x, len(masks)).view(np.int64))], names=["point", "fp"])

    points = fps.repartition(1 + fps.count() // _DEAL).mapInArrow(run, "point long, fp long")
    near = points.select("fp", F.min("fp").over(Window.partitionBy("point")).alias("b"))
    return near.where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """Edges ``a, b`` of a graph on distinct ``fp`` with the same components as all links of at most 4 bits."""
    if bits > 4:
        raise ValueError("the grid covers at most 4 differing bits")
    cells = _cells(fps)
    full = stored(cells.groupBy("cell").count().where(F.col("count") > cell).select("cell"))
    rest = cells.join(full, "cell", "left_anti").groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    edges = _forests(rest, bits)
    if full.isEmpty():
        return edges.distinct()
    crowded = stored(cells.join(full, "cell", "left_semi").select("fp").distinct())
    if bits < 4:
        raise ValueError("crowded cells are linked at exactly 4 bits")
    return edges.unionByName(_midpoints(crowded)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``_id, _th, key, fp, component, component_id`` per row of ``docs``; ``component`` is the group's least fingerprint.

    Null and empty texts have fingerprint 0 and link like any other.  Repeated rows give repeated
    results; a row with a null key takes part, and the component's id is the least non-null key.
    An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs.select(*row_key(key, text), F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")), "_text", shingle))
    classes = prints.groupBy("fp").agg(F.min("_key").alias("_least"))
    nodes = components(classes.select(F.col("fp").alias("node")), links(stored(classes.select("fp")), bits))
    least = classes.join(nodes.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("_least").alias("component_id"))
    named = nodes.join(least, "component").select(F.col("node").alias("fp"), "component", "component_id")
    return prints.join(named, "fp").withColumnRenamed("_key", key)
