"""Toxicity by nearest labelled examples.

A bounded sample of labelled texts is the index.  Texts are TF-IDF vectors; a term's
weight is also scaled by the evidence that ties it to a label, 1 - ``CHI2`` / chi-square,
so that a long text is not drowned by words that say nothing.  There is no limit on the
terms; one whose chi-square does not pass chance (``CHI2``, the 0.1 % level) has weight 0.
Document frequencies are counted over the whole corpus.

The k most cosine-similar examples are found exactly through an inverted index: every
term has its postings (example, weight) in blocks of examples, and the largest weight of
each block.  Blocks are visited by falling upper bound until none can hold a better
example.  Neighbours vote with weights that fall with distance; an isotonic fit of
leave-one-out votes on the sample turns votes into probabilities.  The neighbours and the
terms shared are the evidence.  A text without any weighted term is at distance 0 of the
examples without any, so its vote is their share of label 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, stratified_sample

SAMPLE = 3_000
CHI2 = 10.83
#: Words on either side that tell apart two places of a term.
AROUND = 5
K = 15
BLOCK = 64
#: Blocks visited before the bounds are asked; beyond ``MANY`` blocks left the postings are read list by list instead.
STEP = 4
MANY = 16
SOFT = 0.05
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")


def terms_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Index:
    """Examples: ids, labels, vote weights and sparse unit vectors (places, weights, none empty); ``idf`` holds the weight of each term.

    Postings lie in runs, one for each term and block: ``_ex, _val`` are the postings, run r covers ``_at[r]:_at[r + 1]`` of
    them, belongs to block ``_blk[r]`` and has the largest weight ``_top[r]``; term t has the runs ``_runs[t]:_runs[t + 1]``.
    """

    terms: dict[str, int]
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    weights: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    base: float
    knots: tuple = field(default=((0.0, 1.0), (0.0, 1.0)))

    def __post_init__(self) -> None:
        ex = np.repeat(np.arange(len(self.vectors)), [len(at) for at, _ in self.vectors]).astype(np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in self.vectors)])
        val = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        self._places, self._weights = term, val
        self._row = np.append(0, np.cumsum([len(at) for at, _ in self.vectors], dtype=np.int64))
        order = np.lexsort((ex, term))
        self._ex, self._val, term = ex[order], val[order], term[order]
        block = self._ex // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self._at = np.append(starts, len(term))
        self._blk = block[starts]
        self._top = np.maximum.reduceat(self._val, starts) if len(term) else np.zeros(0)
        self._runs = np.searchsorted(term[starts], np.arange(len(self.idf) + 1))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and unit weights of a text, by places."""
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log([counts[i] for i in at.tolist()])) * self.idf[at]
        return at, (w / np.linalg.norm(w)).astype(np.float64)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, example), ties to the earlier example; exact."""
        n = len(self.vectors)
        bounds, query = np.zeros(-(-n // BLOCK)), np.zeros(len(self.idf))
        query[at] = w
        lists = list(zip(self._runs[at].tolist(), self._runs[at + 1].tolist(), w.tolist(), strict=True))
        for lo, hi, x in lists:
            bounds[self._blk[lo:hi]] += x * self._top[lo:hi]
        order = np.lexsort((np.arange(len(bounds)), -bounds))
        order = order[bounds[order] > 0]
        found, seen, least = [np.zeros((2, 0))], 0, -1.0

        def keep(first: int, cos: np.ndarray) -> None:
            cos = np.round(cos, 9)
            if first <= without < first + len(cos):
                cos[without - first] = 0.0
            some = np.flatnonzero((cos > 0) & (cos >= least))
            found.append(np.stack((cos[some], some + first)))

        def best() -> np.ndarray:
            cos, ids = np.concatenate(found, axis=1)
            return np.stack((cos, ids))[:, np.lexsort((ids, -cos))[:k]]

        while seen < len(order) and bounds[order[seen]] >= least - 1e-9:
            if seen >= STEP and int((bounds[order[seen:]] >= least - 1e-9).sum()) > MANY:
                # the bounds rule out too little: whole lists, term by term
                sums = np.zeros(n)
                for lo, hi, x in lists:
                    posts = slice(self._at[lo], self._at[hi])
                    sums[self._ex[posts]] += x * self._val[posts]
                found = [np.zeros((2, 0))]
                keep(0, sums)
                break
            for b in order[seen : seen + STEP].tolist():
                lo, hi = b * BLOCK, min(n, (b + 1) * BLOCK)
                posts = slice(self._row[lo], self._row[hi])
                keep(lo, np.add.reduceat(query[self._places[posts]] * self._weights[posts], self._row[lo:hi] - self._row[lo]))
            seen += STEP
            found = [best()]
            least = found[0][0, -1] if found[0].shape[1] == k else -1.0
        cos, ids = best()
        return list(zip(cos.tolist(), ids.astype(np.int64).tolist(), strict=True))

    def vote(self, counts: dict[int, int], k: int = K, without: int = -1) -> tuple[float, list[tuple[float, int]]]:
        if not counts:
            return self.base, []
        near = self.nearest(*self.vector(counts), k, without)
        if not near:
            return self.base, []
        w = [self.weights[i] / (1 + SOFT - c) for c, i in near]
        return float(sum(x * self.labels[i] for x, (_, i) in zip(w, near, strict=True)) / sum(w)), near

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(votes, *self.knots), 0, 1)

    def counts(self, text: str | None) -> dict[int, int]:
        found = Counter(t for t in terms_of(text) if t in self.terms)
        return {self.terms[t]: n for t, n in found.items()}


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple:
    """Knots (votes, probabilities) of the weighted least-squares rising fit, each pool smoothed by half a row either way."""
    pools: list[list[float]] = []
    for v in np.unique(votes):
        own = votes == v
        pools.append([float(v), float(v), float((weights * labels)[own].sum()), float(weights[own].sum())])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    x, y = [], []
    for lo, hi, hits, total in pools:
        p = (hits + 0.25) / (total + 0.5)
        x += [lo, hi] if hi > lo else [lo]
        y += [p, p] if hi > lo else [p]
    return tuple(x), tuple(y)


def evidence(rows: DataFrame) -> dict[str, float]:
    """The terms tied to a label and the weight of their evidence, 1 - ``CHI2`` / chi-square, where above 0.

    A term counts once for each surrounding of its first place in a text (``AROUND`` words on either side), so that copies of
    one text, whose words all share a label, count as one, and the words of a fixed phrase count wherever it stands.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            labels, words, around = [], [], []
            for y, t in zip(b.column("_label").to_pylist(), b.column("_text").to_pylist(), strict=True):
                line = terms_of(t)
                own = {w: i for i, w in reversed([*enumerate(line)])}
                labels += [y] * len(own)
                words += own
                around += [xxhash.xxh64_intdigest(" ".join([*line[max(0, i - AROUND) : i], "", *line[i + 1 : i + 1 + AROUND]])) - (1 << 63) for i in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(around, pa.int64())], names=["term", "label", "around"])

    n = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    a, c = F.col("a"), F.col("b")
    once = rows.mapInArrow(run, "term string, label int, around long").distinct()
    table = once.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    off = a * (n0 - c) - c * (n1 - a)
    chi2 = off * off * F.lit(float(n0 + n1)) / (F.lit(float(max(n1, 1)) * max(n0, 1)) * (a + c) * (n0 + n1 - a - c + 0.5))
    kept = table.withColumn("chi2", chi2).where(F.col("chi2") > CHI2).select("term", (1 - CHI2 / F.col("chi2")).alias("w"))
    return {r.term: r.w for r in kept.collect()}  # terms of the bounded sample


def document_frequencies(docs: DataFrame, terms: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of ``docs`` and, for each term, the rows that hold it; sums per task, then over all."""
    wanted = frozenset(terms)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for b in it:
            for t in b.column(text).to_pylist():
                n += 1
                seen.update(wanted.intersection(terms_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["term", "n"])

    got = {r.term: r.n for r in docs.select(text).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Index:
    """Index at most ``sample`` labelled texts of each label, those of smallest key hash.

    Labels other than 0 and 1 and labels without a row are left out; of repeated labels of a key the largest counts, of
    repeated rows the least text.  With one label only, or none, every score is that label or 0.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return Index({}, np.zeros(0), [], np.zeros(0), np.zeros(0), [], float(1 in counts))
    chosen = stratified_sample(marked, "_label", "_key", counts, sample)
    rows = stored(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")))  # bounded by sample
    force = evidence(rows)
    names = sorted(force)
    n, frequency = document_frequencies(docs, names, text)
    place = {t: i for i, t in enumerate(names)}
    idf = np.array([(math.log((1 + n) / (1 + frequency.get(t, 0))) + 1) * force[t] for t in names])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [sorted(Counter(place[t] for t in terms_of(x) if t in place).items()) for x in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_label"), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32()))], names=["key", "label", "at", "n"])

    kind = dict(rows.dtypes)["_key"]
    examples = rows.mapInArrow(count, f"key {kind}, label int, at array<int>, n array<int>").collect()  # at most sample rows a label
    # neighbours in the order share their label and heaviest terms, which keeps block bounds tight
    examples.sort(key=lambda r: (r.label, sorted(r.at, key=lambda i: -idf[i])[:4], r.key))
    seen = Counter(r.label for r in examples)
    share = {y: counts[y] / seen[y] for y in seen}
    held = [r for r in examples if r.at]
    index = Index(place, idf, [r.key for r in held], np.array([r.label for r in held], float), np.array([share[r.label] for r in held]), [], 0.0)
    index.vectors = [index.vector(dict(zip(r.at, r.n, strict=True))) for r in held]
    index.__post_init__()
    empty = [r for r in examples if not r.at]
    ones, zeros = (sum(share[y] for r in (empty or examples) if r.label == y) for y in (1, 0))
    index.base = ones / max(ones + zeros, 1e-9)
    votes = np.array([index.vote(dict(zip(r.at, r.n, strict=True)), without=i)[0] for i, r in enumerate(held)] + [index.base] * len(empty))
    weights = np.array([share[r.label] for r in held + empty])
    index.knots = isotonic(np.round(votes, 6), np.array([r.label for r in held + empty], float), weights / weights.mean())
    return index


def score(docs: DataFrame, index: Index, text: str = "text", evidence: int = 3) -> DataFrame:
    """``docs`` without ``text``, with ``score``, ``predicted`` (1 from 0.5 on), and as evidence ``neighbours`` (example id, cosine)
    and ``matched`` (terms); like-named columns are replaced.  Null and empty texts hold no term and get the score of such texts.
    """
    docs = docs.withColumn("_text", F.col(text)).drop(text, "score", "predicted", "neighbours", "matched")
    parts = (index.terms, index.idf, index.ids, index.labels, index.weights, index.vectors, index.base)
    shared = docs.sparkSession.sparkContext.broadcast((parts, index.knots))  # the weighted terms of at most 2 x sample examples

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(*shared.value[0])
        own.knots = shared.value[1]
        names = list(own.terms)
        done: dict = {}
        for b in it:
            votes, near, matched = [], [], []
            for x in b.column("_text").to_pylist():
                counts = own.counts(x) if own.terms else {}
                asked = tuple(sorted(counts.items()))
                if asked not in done:
                    if len(done) > 50_000:
                        done.clear()
                    done[asked] = own.vote(counts)
                vote, best = done[asked]
                votes.append(vote)
                near.append([{"id": own.ids[i], "cosine": c} for c, i in best[:evidence]])
                matched.append([names[i] for i, _ in asked])
            p = own.probability(np.round(np.array(votes, float), 6)) if own.terms else np.array(votes, float)
            rest = [n for n in b.schema.names if n != "_text"]
            kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(near, kind), pa.array(matched, pa.list_(pa.string()))], names=[*rest, "score", "predicted", "neighbours", "matched"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != "_text"), "score double, predicted int, neighbours array<struct<id:long,cosine:double>>, matched array<string>"])
    return docs.mapInArrow(run, schema)
