"""Quality classifier: a sparse ensemble of rules.

Every text is described by statistics of its whole length.  A small forest of shallow
trees is grown on a bounded labelled sample; each path from a root to a node is a
conjunction of thresholds, a rule.  A lasso logistic regression over the rules (and
the statistics, clipped to their 2.5 and 97.5 percentiles) keeps few of them.  The
kept rules are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside, stratified_sample, stored

SAMPLE = 6_000
TREES = 24
DEPTH = 4
LASSO = 0.003
THRESHOLD = 0.3
SEED = 7
STATS = (
    "log_chars", "log_words", "word_len", "upper", "digit", "symbol", "punct", "space", "non_ascii", "bang", "lines", "line_len",
    "distinct", "repeat_next", "top_word", "top5", "symbol_words", "upper_words", "long_words", "short_words", "distinct_lines", "ends_well", "distinct_pairs",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_PUNCT, _SYMBOL, _SPACE, _BANG = _class(".,;:'\"?()-"), _class("#$%&*@|<>{}[]\\^_~`+=/"), _class(" \t\n\r\v\f"), _class("!")


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``STATS`` for a whole text; null counts as empty."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, w = max(1, int(raw.sum())), max(1, len(words))
    counts = Counter(words)
    common = counts.most_common(5)
    share = lambda which: float(raw[which].sum()) / n
    body = sum(map(len, words))
    return [
        math.log1p(len(text)), math.log1p(len(words)), body / w, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_PUNCT), share(_SPACE), float(raw[128:].sum()) / n, share(_BANG),
        len(lines) / w, math.log1p(len(text) / max(1, len(lines))), len(counts) / w, sum(map(str.__eq__, words, words[1:])) / w, (common[0][1] if common else 0) / w, sum(c for _, c in common) / w,
        sum(c for x, c in counts.items() if not x.isalnum() and not x.rstrip(".,;:!?").isalnum()) / w, sum(c for x, c in counts.items() if x.isupper() and len(x) > 1) / w,
        sum(c for x, c in counts.items() if len(x) > 14) / w, sum(c for x, c in counts.items() if len(x) < 3) / w, len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?:" for x in lines) / max(1, len(lines)), len(set(zip(words, words[1:], strict=False))) / w,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_stats``, an array of ``STATS``, in place of ``text``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rest = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array([statistics(x) for x in b.column(text).to_pylist()], pa.list_(pa.float64()))], names=[*rest, "_stats"])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != text), "_stats array<double>"]))


@dataclass
class Rules:
    """``intercept``, weighted conjunctions and weighted clipped statistics: (weight, ((stat, is_greater, cut), ...)) and (weight, stat, low, high)."""

    intercept: float
    rules: list
    linear: list

    def score(self, stats: str = "_stats") -> Column:
        """The probability of label 1 as one column expression."""
        total = F.lit(self.intercept)
        at = [F.get(stats, i) for i in range(len(STATS))]
        for weight, tests in self.rules:
            total = total + F.when(_holds(at, tests), weight).otherwise(0.0)
        for weight, i, low, high in self.linear:
            total = total + weight * F.greatest(F.lit(low), F.least(F.lit(high), at[i]))
        return 1 / (1 + F.exp(-total))


def _holds(at: list[Column], tests: tuple) -> Column:
    out = F.lit(True)
    for i, above, cut in tests:
        out = out & ((at[i] > cut) if above else (at[i] <= cut))
    return out


def _paths(node, tests: tuple = ()) -> Iterator[tuple]:
    """Conjunctions on the way to every node below the root."""
    if tests:
        yield tests
    if node.subtreeDepth() > 0:
        split = node.split()
        i, cut = split.featureIndex(), round(split.threshold(), 6)
        yield from _paths(node.leftChild(), (*tests, (i, False, cut)))
        yield from _paths(node.rightChild(), (*tests, (i, True, cut)))


def _simplified(tests: tuple) -> tuple:
    """One bound per statistic and side."""
    bound: dict = {}
    for i, above, cut in tests:
        old = bound.get((i, above), cut)
        bound[i, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((i, above, cut) for (i, above), cut in bound.items()))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Rules:
    """Fit on at most ``sample`` labelled texts of each label.

    Labels other than 0 and 1 and labels without a text row are left out; of repeated labels of a key the smallest counts,
    of repeated texts of a key the first in order.  The rows are sorted, so the same input gives the same rules.
    With no label the score is 0.5, with one label only it is near that label.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return Rules(0.0 if not counts else (4.0 if 1 in counts else -4.0), [], [])
    chosen = stratified_sample(marked, "_label", "_key", counts, sample)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # bounded by sample
    texts = texts.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    rows = stored(with_statistics(texts, "_text").repartition(4, "_key").sortWithinPartitions(F.xxhash64("_key"), "_key"))
    seen = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(seen) < 2:
        return Rules(0.0 if not seen else (4.0 if 1 in seen else -4.0), [], [])
    # rows stand for their label's share of all labels
    weight = F.when(F.col("_label") == 1, counts[1] / seen[1]).otherwise(counts[0] / seen[0]) * F.lit(sum(seen.values()) / sum(counts.values()))
    data = rows.select("_stats", array_to_vector("_stats").alias("features"), F.col("_label").cast("double").alias("label"), weight.alias("weight"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, weightCol="weight", subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=8, seed=SEED).fit(data)
    rules = sorted({_simplified(p) for t in forest.trees for p in _paths(t._call_java("rootNode"))})
    at = [F.get("_stats", i) for i in range(len(STATS))]
    low, high = zip(*rows.agg(*[F.percentile(a, F.array(F.lit(0.025), F.lit(0.975))).alias(f"p{i}") for i, a in enumerate(at)]).first(), strict=True)
    columns = [F.when(_holds(at, r), 1.0).otherwise(0.0) for r in rules]
    columns += [F.greatest(F.lit(a), F.least(F.lit(b), x)) for x, a, b in zip(at, low, high, strict=True)]
    wide = data.select(array_to_vector(F.array(*columns)).alias("rules"), "label", "weight")
    fitted = LogisticRegression(featuresCol="rules", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, maxIter=120, standardization=True).fit(stored(wide))
    w = [round(float(x), 6) for x in fitted.coefficients.toArray()]
    kept = [(x, r) for x, r in zip(w, rules, strict=False) if x]
    linear = [(x, i, a, b) for i, (x, a, b) in enumerate(zip(w[len(rules) :], low, high, strict=True)) if x]
    return Rules(float(fitted.intercept), kept, linear)


def score(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1, empty texts too) and ``predicted`` (1 from 0.3 on); like-named columns are replaced."""
    seen = with_statistics(docs.withColumn("_text", F.col(text)).drop(text, "score", "predicted"), "_text")
    return seen.withColumn("score", rules.score()).drop("_stats").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not rejected, with their columns, whatever the names of the others."""
    plain = set_aside(docs, text)
    seen = with_statistics(plain.withColumn("_text", F.col(text)), "_text")
    return seen.where(rules.score() >= THRESHOLD).select(*plain.columns).toDF(*docs.columns)
