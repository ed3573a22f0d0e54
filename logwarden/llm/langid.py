"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams
(n = 1 to 4) that both hold, normalised by the sizes of their n-gram sets.  N-grams of
the lower-cased whole text are hashed into a fixed table per n; a text is the set of
its table cells, so its size is bounded whatever its length.

Training: a bounded sample per language; from it landmarks, the Nyström map
``K(x, landmarks) @ (K_landmarks)^(-1/2)``, and one-versus-rest kernel ridge
regression on the mapped texts.  As the kernel is a dot product of presence vectors,
landmarks, map and ridge weights fold into one matrix (table cells x languages), and a
batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stratified_sample

#: Bits of the hash table of each n-gram length.
TABLE_BITS = (12, 14, 15, 15)
CELLS = sum(1 << b for b in TABLE_BITS)
SAMPLE = 400
LANDMARKS = 64
RIDGE = 1e-2
BATCH = 64
CHUNK = 1 << 20
UNKNOWN = "und"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str, out: np.ndarray) -> None:
    """Mark in ``out`` (bool, CELLS) the cells of the n-grams of a whole text; works in chunks that overlap by n - 1."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for at in range(0, len(points), CHUNK):
        codes, base = points[at : at + CHUNK + len(TABLE_BITS) - 1].astype(np.uint64), 0
        gram = np.zeros(len(codes), np.uint64)
        for n, bits in enumerate(TABLE_BITS):
            if len(codes) <= n:
                break
            with np.errstate(over="ignore"):
                gram = gram[: len(codes) - n] * np.uint64(1_000_003) + codes[n:] + np.uint64(1)
                cells = (gram * _FACTOR) >> np.uint64(64 - bits)
            out[base + cells.astype(np.int64)] = True
            base += 1 << bits


@dataclass
class Model:
    """``weights``: CELLS x languages; ``names``: the learned values in order."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on at most ``sample`` keys per language, those of smallest key hash.  Rows without text or language are left out.

    A key counts once for a language, by the first of its texts in order that holds a letter.  Sampled texts come to the
    driver as bit sets of fixed size, not as text.
    """
    usable = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bits = []
            for x in b.column("text").to_pylist():
                row = np.zeros(CELLS, bool)
                presence(x, row)
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(bits, pa.binary())], names=["lang", "bits"])

    keys = usable.select("key", "lang").distinct()
    counts = keys.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros(0))
    names = sorted(r.lang for r in counts)
    picked = stratified_sample(keys, "lang", "key", {r.lang: r["count"] for r in counts}, sample)  # at most sample rows a language
    chosen = usable.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(picked), ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text"))
    rows = chosen.select("lang", "text").mapInArrow(pack, "lang string, bits binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.bits)))
    return fit(names, [r.lang for r in rows], [bytes(r.bits) for r in rows], landmarks, ridge)


def _unit(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)[:, :CELLS].astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(names: list[str], langs: list[str], bits: list[bytes], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge weights for sampled bit sets; ``landmarks`` texts per language, evenly spread over its sample."""
    marks = []
    for n in names:
        own = [i for i, x in enumerate(langs) if x == n]
        if own:
            marks += [own[j] for j in np.unique(np.linspace(0, len(own) - 1, min(landmarks, len(own))).astype(int))]
    if not marks:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros(0))
    base = _unit([bits[i] for i in marks])
    kernel = (base @ base.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = np.concatenate([_unit(bits[i : i + BATCH]) @ base.T for i in range(0, len(bits), BATCH)]).astype(np.float64) @ root
    target = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    # every language counts alike, however many texts its sample holds
    share = 1 / np.maximum(target.sum(axis=0), 1)
    w = (target @ share)[:, None]
    mean, goal = (w * mapped).sum(0) / w.sum(), (w * target).sum(0) / w.sum()
    centred = mapped - mean
    gram = centred.T @ (w * centred) / w.sum() + ridge * np.eye(centred.shape[1]) / len(names)
    beta = np.linalg.solve(gram, centred.T @ (w * (target - goal)) / w.sum())
    return Model(names, (base.T @ (root @ beta).astype(np.float32)).astype(np.float32), goal - mean @ beta)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score`` (0 to 1).

    Null texts, and texts without a letter, are ``und`` with score 0; so is everything if nothing was learned.  Ties go to
    the first name in order.  Columns of ``docs`` named like the results are replaced.
    """
    docs = docs.withColumn("_text", F.when(F.col(text).rlike(r"\p{L}"), F.col(text))).drop(text, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))  # fixed table size x languages

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        x = np.zeros((BATCH, CELLS), bool)
        for b in it:
            texts = b.column("_text").to_pylist()
            names, scores = [], []
            for at in range(0, len(texts), BATCH):
                part = texts[at : at + BATCH]
                x[: len(part)] = False
                for i, t in enumerate(part):
                    if t is not None:
                        presence(t, x[i])
                got = x[: len(part)].astype(np.float32)
                raw = (got @ m.weights) / np.sqrt(np.maximum(got.sum(axis=1, keepdims=True), 1)) + m.bias
                raw = np.clip(raw, 1e-6, None) if m.names else np.zeros((len(part), 1))
                best, part_of = raw.argmax(axis=1), raw.max(axis=1) / np.maximum(raw.sum(axis=1), 1e-6)
                for t, k, s in zip(part, best.tolist(), part_of.tolist(), strict=True):
                    known = t is not None and bool(m.names)
                    names.append(m.names[k] if known else UNKNOWN)
                    scores.append(min(1.0, s) if known else 0.0)
            rest = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != "_text"), "lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)
