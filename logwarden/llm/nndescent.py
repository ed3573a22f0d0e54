"""Embedding near-duplicates by NN-descent.

Equal vectors are one class, so copies never meet.  Among classes:

1. Start: a forest of random-hyperplane orders.  Rows are sorted by the signs of their
   products with random hyperplanes, cut into leaves of ``LEAF`` rows, and every row
   takes its nearest rows of the leaf as first neighbours.  There are so many trees that
   a lone pair at the threshold shares a leaf with probability ``RECALL``.
2. Descent: every node joins its neighbours, both ways, with each other
   (neighbours of neighbours), where a new edge lies within ``MARGIN`` of the threshold;
   each row keeps its ``K`` nearest.  Rounds go on until
   a round adds less than ``STOP`` of the threshold links.  Long reverse lists are
   dealt into groups, none is cut.
3. Audit: rows are drawn, and their links counted by brute force, until ``LINKED`` rows
   with links are seen or all rows are drawn; below ``RECALL`` the trees are doubled and
   the descent goes on.  When more trees would cost as much as comparing all rows, all
   are compared.
4. Enlarging: a row whose whole list lies above the threshold is saturated.  The
   closure of its neighbours-of-neighbours joins is its component; its list is
   enlarged to all rows of the component above the threshold, block against block,
   where blocks too far apart by the angle between their centres and their radii are
   left out.  Only counts leave a block, never its pairs.  Before that, saturated rows
   of different components meet in the same way: two full lists can hide a link from
   each other, and one such link makes one component.

Cosines are decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .forest import components

COSINE = 0.95
K = 10
LEAF = 64
TREES = 8
PLANES = 48
ROUNDS = 4
STOP = 0.002
MARGIN = 0.25
RECALL = 0.97
AUDIT = 512
MOST_ASKED = 8192
LINKED = 300
MEMBERS = 48
BLOCK = 256
CHUNK = 1024
SEED = 11


def with_units(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``x`` in place of ``vector``: the vector over its length in double precision; null if it is null, empty,
    zero or holds null or non-finite parts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(vector).cast(pa.list_(pa.float64()))
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            out = []
            for i, known in enumerate(lists.is_valid().to_pylist()):
                v = flat[offsets[i] : offsets[i + 1]]  # null parts have become NaN
                most = np.abs(v).max() if known and len(v) else 0.0
                if np.isfinite(most) and most > 0:
                    v = v / most  # no overflow in the squares
                    out.append(v / np.linalg.norm(v))
                else:
                    out.append(None)
            rest = [n for n in b.schema.names if n != vector]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(out, pa.list_(pa.float64()))], names=[*rest, "x"])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n != vector), "x array<double>"]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows are filled with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    n = np.diff(offsets)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _planes(tree: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree]).standard_normal((dim, PLANES))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, cosine): the k nearest other rows of each row."""
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], cos.ravel()[:0]
    best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(cos, best, 1).ravel()


def _edges(a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cos"])


def _sorted_leaves(x: DataFrame, trees: list[int], dim: int, also: str | None = None) -> DataFrame:
    """``tree, code, cid, x`` sorted by tree and hyperplane signs within range partitions (equal codes are spread by id)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [(t, _planes(t, dim)) for t in trees]
        weights = (1 << np.arange(PLANES, dtype=np.int64))[::-1]
        for b in it:
            m = _matrix(b.column("x"), dim)
            rest = [n for n in b.schema.names]
            for t, p in planes:
                code = ((m @ p > 0) * weights).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(code), *(b.column(n) for n in rest)], names=["tree", "code", *rest])

    order = ["tree", *([also] if also else []), "code", "cid"]
    return x.mapInArrow(run, ", ".join(["tree int", "code long", *(f"{n} {t}" for n, t in x.dtypes)])).repartitionByRange(*order).sortWithinPartitions(*order)


def _start(x: DataFrame, trees: list[int], dim: int, k: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.zeros(0, np.int64), np.zeros((0, dim))
        for b in it:
            ids, rows = np.concatenate((ids, b.column("cid").to_numpy())), np.concatenate((rows, _matrix(b.column("x"), dim)))
            full = max(0, len(ids) // LEAF - 1) * LEAF  # the last leaf may grow to nearly two
            for at in range(0, full, LEAF):
                yield _edges(*_nearest(ids[at : at + LEAF], rows[at : at + LEAF], k))
            ids, rows = ids[full:], rows[full:]
        if len(ids) > 1:
            yield _edges(*_nearest(ids, rows, k))

    return _sorted_leaves(x, trees, dim).select("cid", "x").mapInArrow(run, "a long, b long, cos double").where("a <> b")


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest ``b`` of every ``a``, once each."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    # one exchange serves both steps; a row has at most k entries from each tree or group
    return edges.repartition("a").groupBy("a", "b").agg(F.max("cos").alias("cos")).withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _descend(x: DataFrame, graph: DataFrame, fresh: DataFrame, dim: int, k: int) -> DataFrame:
    """Candidates from joining neighbours of neighbours; only nodes next to a ``fresh`` edge have news."""
    both = graph.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(graph.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct()
    news = fresh.select(F.col("a").alias("v")).unionByName(fresh.select(F.col("b").alias("v"))).distinct()
    both = both.join(news, "v", "left_semi")
    size = both.groupBy("v").count()
    dealt = both.join(size, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.ceil(F.col("count") / MEMBERS)).cast("int")).select("v", "part", "u")
    members = dealt.unionByName(dealt.select("v", "part").distinct().withColumn("u", F.col("v")))
    rows = members.join(x.select(F.col("cid").alias("u"), "x"), "u").repartition("v", "part").sortWithinPartitions("v", "part")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in it:
            v, part, u, m = b.column("v").to_numpy(), b.column("part").to_numpy(), b.column("u").to_numpy(), _matrix(b.column("x"), dim)
            if tail is not None:
                v, part, u, m = (np.concatenate(z) for z in zip(tail, (v, part, u, m), strict=True))
            cuts = np.flatnonzero((np.diff(v) != 0) | (np.diff(part) != 0)) + 1
            last, out = cuts[-1] if len(cuts) else 0, []
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
                out.append(_nearest(u[lo:hi], m[lo:hi], k))
            tail = v[last:], part[last:], u[last:], m[last:]
            if out:
                yield _edges(*(np.concatenate(z) for z in zip(*out, strict=True)))
        if tail is not None and len(tail[0]):
            yield _edges(*_nearest(tail[2], tail[3], k))

    return rows.select("v", "part", "u", "x").mapInArrow(run, "a long, b long, cos double").where("a <> b")


def _trees_for(rows: int, cosine: float) -> int:
    """Trees after which two rows at the threshold have shared a leaf with probability ``RECALL``: log2(rows / LEAF) planes must agree."""
    met = (1 - np.arccos(cosine) / np.pi) ** max(1.0, np.log2(max(rows, 1) / LEAF))
    return max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - met))))


def _grown(x: DataFrame, graph: DataFrame | None, trees: range, dim: int, k: int) -> DataFrame:
    """``graph`` with the leaf neighbours of ``trees``, ``TREES`` at a time."""
    for at in range(trees.start, trees.stop, TREES):
        more = _start(x.select("cid", "x"), list(trees[at - trees.start :][:TREES]), dim, k)
        graph = stored(_top(graph.unionByName(more) if graph is not None else more, k))
    return graph


def _asked(x: DataFrame, ids: np.ndarray, asked: np.ndarray, dim: int, cosine: float) -> dict[int, int]:
    """The true number of links of each asked row, by brute force."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(len(ids), np.int64)
        for b in it:
            own, m = b.column("cid").to_numpy(), _matrix(b.column("x"), dim)
            for at in range(0, len(ids), BLOCK):
                near[at : at + BLOCK] += ((m @ asked[at : at + BLOCK].T >= cosine) & (own[:, None] != ids[at : at + BLOCK])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near)], names=["a", "n"])

    return {r.a: r.n for r in x.select("cid", "x").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()}


def _audit(x: DataFrame, rows: int, links: DataFrame, dim: int, cosine: float, k: int) -> float:
    """The share of true neighbours (at most k a row count) that the links hold, over rows drawn until ``LINKED`` have neighbours.

    Rows with fewer than k neighbours, whose lists are all that counts for them, must reach the share on their own.
    """
    span = 1 << 30
    draw = lambda c: F.pmod(F.xxhash64(F.lit("audit"), c), F.lit(span))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    want, got, low, ask = {}, {}, 0, AUDIT
    while low < span and len(want) < LINKED:
        high = min(span, low + max(1, span * ask // max(rows, 1)))
        inside = lambda c: (draw(c) >= low) & (draw(c) < high)  # noqa: B023, E731
        sample = x.where(inside("cid")).select("cid", "x").collect()  # about MOST_ASKED rows at most
        if sample:
            asked = np.zeros((len(sample), dim))
            for i, r in enumerate(sample):
                asked[i, : len(r.x)] = r.x
            truth = _asked(x, np.array([r.cid for r in sample]), asked, dim, cosine)
            want |= {a: min(n, k) for a, n in truth.items() if n}
            got |= {r.a: r.n for r in both.where(inside("a")).groupBy("a").agg(F.count_distinct("b").alias("n")).collect()}
        low, ask = high, min(2 * ask, MOST_ASKED)

    def share(of: dict[int, int]) -> float:
        return sum(min(got.get(a, 0), n) for a, n in of.items()) / max(1, sum(of.values())) if of else 1.0

    return min(share(want), share({a: n for a, n in want.items() if n < k}))


def _all_links(x: DataFrame, rows: int, dim: int, cosine: float, k: int) -> DataFrame:
    """The k nearest links of every row, by comparing all rows in chunks."""

    def chunk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, CHUNK):
                c = b.slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array([c.column("cid").to_numpy().tobytes()], pa.binary()), pa.array([_matrix(c.column("x"), dim).tobytes()], pa.binary())], names=["ids", "xs"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ia, xa, ib, xb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ia, ib = np.frombuffer(ia, np.int64), np.frombuffer(ib, np.int64)
                cos = np.frombuffer(xa).reshape(-1, dim) @ np.frombuffer(xb).reshape(-1, dim).T
                cos[ia[:, None] == ib] = -2
                best = np.argpartition(-cos, min(k, len(ib)) - 1, axis=1)[:, :k]
                a, c = np.repeat(ia, best.shape[1]), np.take_along_axis(cos, best, 1).ravel()
                near = c >= cosine
                yield _edges(a[near], ib[best].ravel()[near], c[near])

    chunks = stored(x.select("cid", "x").repartition(-(-rows // CHUNK) or 1).mapInArrow(chunk, "ids binary, xs binary"))
    met = chunks.select(F.col("ids").alias("ia"), F.col("xs").alias("xa")).crossJoin(chunks.select(F.col("ids").alias("ib"), F.col("xs").alias("xb")))
    return _top(met.mapInArrow(compare, "a long, b long, cos double"), k)


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """At most ``BLOCK`` near rows (``component, cid, x, size, asks``) of one component as one row, with their centre and radius."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(comp: int, ids: list, xs: list, sizes: list, asks: list) -> pa.RecordBatch:
            m = np.stack(xs)
            centre = m.sum(axis=0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 0 else centre
            radius = float(np.arccos(np.clip((m @ centre).min(), -1, 1))) if norm > 0 else np.pi
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[0]], pa.int64()), pa.array([comp], pa.int64()), pa.array([centre], pa.list_(pa.float64())), pa.array([radius]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), pa.array([np.array(asks, bool).tobytes()], pa.binary())],
                names=["block", "component", "centre", "radius", "ids", "xs", "sizes", "asks"],
            )

        held, comp = ([], [], [], []), None
        for b in it:
            for c, row in zip(b.column("component").to_pylist(), zip(b.column("cid").to_pylist(), _matrix(b.column("x"), dim), b.column("size").to_pylist(), b.column("asks").to_pylist(), strict=True), strict=True):
                if held[0] and (c != comp or len(held[0]) == BLOCK):
                    yield block(comp, *held)
                    held = ([], [], [], [])
                comp = c
                for h, value in zip(held, row, strict=True):
                    h.append(value)
        if held[0]:
            yield block(comp, *held)

    out = _sorted_leaves(rows, [0], dim, "component").select("component", "cid", "x", "size", "asks")
    return out.mapInArrow(cut, "block long, component long, centre array<double>, radius double, ids binary, xs binary, sizes binary, asks binary")


def _bridges(x: DataFrame, saturated: DataFrame, member: DataFrame, dim: int, cosine: float) -> DataFrame:
    """``a, b``: components with a link between saturated classes.  Other links are in a list, as a list that is not full drops none."""
    asking = saturated.select(F.col("a").alias("cid")).join(member, "cid").join(x, "cid")
    blocks = stored(_blocks(asking.select("cid", "x", "size", "component", F.lit(True).alias("asks")), dim))
    most = float(np.arccos(cosine)) + 1e-6

    def chunk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, CHUNK):
                c = b.slice(at, CHUNK)
                ids = c.column("block").to_numpy()
                packed = (ids, c.column("component").to_numpy(), _matrix(c.column("centre"), dim), c.column("radius").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([ids[0]], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in packed)], names=["chunk", "ids", "comps", "centres", "radii"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ia, ca, xa, ra, ib, cb, xb, rb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ia, ca, ib, cb = (np.frombuffer(v, np.int64) for v in (ia, ca, ib, cb))
                ra, rb = np.frombuffer(ra), np.frombuffer(rb)
                angle = np.arccos(np.clip(np.frombuffer(xa).reshape(-1, dim) @ np.frombuffer(xb).reshape(-1, dim).T, -1, 1))
                i, j = np.nonzero((angle - ra[:, None] - rb <= most) & (ca[:, None] < cb))
                k, m = np.nonzero((angle - ra[:, None] - rb <= most) & (ca[:, None] > cb)) if ia[0] != ib[0] else (i[:0], j[:0])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ia[i], ia[k]))), pa.array(np.concatenate((ib[j], ib[m])))], names=["a", "b"])

    chunks = stored(blocks.select("block", "component", "centre", "radius").repartition(-(-blocks.count() // CHUNK) or 1).mapInArrow(chunk, "chunk long, ids binary, comps binary, centres binary, radii binary"))
    side = lambda n: chunks.select(*(F.col(c).alias(f"{n}_{c}") for c in chunks.columns))
    met = side("a").crossJoin(side("b")).where("a_chunk <= b_chunk").drop("a_chunk", "b_chunk")
    pairs = met.mapInArrow(meet, "a long, b long")
    left, right = (blocks.select(F.col("block").alias(n), F.col("component").alias(f"c{n}"), F.col("xs").alias(f"x{n}")) for n in "ab")

    def linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ca, cb = b.column("ca").to_numpy(), b.column("cb").to_numpy()
            near = [bool((np.frombuffer(p).reshape(-1, dim) @ np.frombuffer(q).reshape(-1, dim).T >= cosine).any()) for p, q in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)]
            near = np.array(near, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ca[near]), pa.array(cb[near])], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("ca", "xa", "cb", "xb").mapInArrow(linked, "a long, b long").distinct()


def _enlarged(x: DataFrame, saturated: DataFrame, member: DataFrame, dim: int, cosine: float) -> DataFrame:
    """``a, n``: for each saturated class the rows (by class sizes) of its component within the threshold, itself left out."""
    full = member.join(saturated.join(member.withColumnRenamed("cid", "a"), "a").select("component").distinct(), "component", "left_semi")
    rows = x.join(full, "cid").join(saturated.select(F.col("a").alias("cid"), F.lit(True).alias("asks")), "cid", "left").select("cid", "x", "size", "component", F.coalesce("asks", F.lit(False)).alias("asks"))
    blocks = stored(_blocks(rows, dim))
    side = lambda n: blocks.select("component", F.col("block").alias(n), F.col("centre").alias(f"c{n}"), F.col("radius").alias(f"r{n}"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("ra") - F.col("rb")
    pairs = side("a").join(side("b"), "component").where(apart <= float(np.arccos(cosine)) + 1e-6).select("a", "b")
    left = blocks.select(F.col("block").alias("a"), F.col("ids").alias("ia"), F.col("xs").alias("xa"), F.col("asks").alias("qa"))
    right = blocks.select(F.col("block").alias("b"), F.col("ids").alias("ib"), F.col("xs").alias("xb"), F.col("sizes").alias("sb"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ia, xa, qa, ib, xb, sb in zip(*(b.column(c).to_pylist() for c in ("ia", "xa", "qa", "ib", "xb", "sb")), strict=True):
                asks = np.frombuffer(qa, bool)
                ids, other = np.frombuffer(ia, np.int64)[asks], np.frombuffer(ib, np.int64)
                near = (np.frombuffer(xa).reshape(-1, dim)[asks] @ np.frombuffer(xb).reshape(-1, dim).T >= cosine) & (ids[:, None] != other)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ np.frombuffer(sb, np.int64))], names=["a", "n"])

    met = pairs.join(left, "a").join(right, "b").select("ia", "xa", "qa", "ib", "xb", "sb")
    return met.mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, k: int = K) -> DataFrame:
    """``key, n_links, component_id, kept`` per row of ``vectors``.

    Null, empty and zero vectors and vectors with null or non-finite parts link with nothing.  Vectors of different lengths
    compare as if filled with zeros.  Equal vectors link (cosine 1), repeated rows as well: each row counts.  Rows with a null
    key take part; a component's id is its least non-null key.  An empty table gives no rows.  Other columns are not read.
    """
    rows = stored(with_units(vectors.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(vector).alias("_v")), "_v"))
    good = rows.where(F.col("x").isNotNull())
    classes = good.groupBy("x").agg(F.min("_row").alias("cid"), F.count(F.lit(1)).alias("size"), F.min("_key").alias("_least"))
    classes = stored(classes.select("cid", "x", "size", "_least"))
    dim = classes.agg(F.max(F.size("x"))).first()[0] or 0
    x = classes.select("cid", "x", "size")
    n = classes.count()
    trees = _trees_for(n, cosine)
    graph = _grown(x, None, range(trees), dim, k)
    # descent starts from edges within reach of the threshold; others lead to no link
    near_enough = F.col("cos") >= cosine - MARGIN
    fresh, links = graph.where(near_enough), -1
    while True:
        for _ in range(ROUNDS):
            found = graph.where(F.col("cos") >= cosine).count()
            if links >= 0 and found - links <= STOP * max(found, 1):
                break
            links = found
            grown = stored(_top(graph.unionByName(_descend(x, graph, fresh, dim, k)), k))
            fresh = grown.where(near_enough).join(graph.select("a", "b"), ["a", "b"], "left_anti")
            graph = grown
        if _audit(x, n, graph.where(F.col("cos") >= cosine), dim, cosine, k) >= RECALL:
            break
        if 2 * trees * LEAF >= n:
            graph = stored(_all_links(x, n, dim, cosine, k))
            break
        grown = _grown(x, graph, range(trees, 2 * trees), dim, k)
        trees, links = 2 * trees, -1
        fresh, graph = grown.where(near_enough).join(graph.select("a", "b"), ["a", "b"], "left_anti"), grown
    near = graph.where(F.col("cos") >= cosine)
    edges = stored(near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    member = stored(components(classes.select(F.col("cid").alias("node")), edges).withColumnRenamed("node", "cid"))
    saturated = stored(near.groupBy("a").count().where(F.col("count") >= k).select("a"))
    if not saturated.isEmpty():
        bridges = stored(_bridges(x, saturated, member, dim, cosine))
        if not bridges.isEmpty():
            joined = components(member.select(F.col("component").alias("node")).distinct(), bridges).withColumnRenamed("component", "_to")
            member = stored(member.join(joined.withColumnRenamed("node", "component"), "component").select("cid", F.col("_to").alias("component")))
    sizes = classes.select(F.col("cid").alias("b"), "size")
    degree = edges.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("_some"))
    if not saturated.isEmpty():
        degree = degree.join(_enlarged(x, saturated, member, dim, cosine), "a", "left").select("a", F.greatest("_some", F.coalesce("n", F.lit(0).cast("long"))).alias("_some"))
    least = classes.join(member, "cid").groupBy("component").agg(F.min("_least").alias("component_id"))
    told = classes.join(member, "cid").join(least, "component").join(degree.withColumnRenamed("a", "cid"), "cid", "left")
    told = stored(told.select("x", (F.coalesce("_some", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links"), "component_id"))
    out = good.join(told, "x").select("_key", "n_links", "component_id").unionByName(rows.where(F.col("x").isNull()).select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").cast("long").alias("component_id")))
    return out.select(F.col("_key").alias(key), "n_links", F.col("component_id").cast("long").alias("component_id"), (F.col("_key") == F.col("component_id")).alias("kept"))
