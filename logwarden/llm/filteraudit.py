"""Filter interaction audit by decision diagrams.

Every document is a mask of the filters it fails.  Masks are counted per part in one
map-side combined aggregate (2^filters rows a part), and each part's counts become a
count-weighted decision diagram: one level per filter, a node's weight is the number
of documents below it, equal sub-diagrams are one node.  All orders of the filters are
reached by swapping two neighbouring levels at a time, which rewrites those two levels
alone.  In each order the all-pass path from the root gives the steps: at a node of the
path, the fail child holds what the filter removes and the pass child what it keeps.

A text's copies are found by its 128-bit hash and the least id that has it; hot texts
are met by broadcast, repeated ids are added up before they meet the labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, HEAVY, spread_join, stored

#: The letter of the filter that fails copies of a document with a smaller id.
COPY = "E"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def few_words(text: Column, w: Column) -> Column:
    return F.size(w) < 50


def repetitive(text: Column, w: Column) -> Column:
    return F.lit(100).cast("long") * F.size(F.array_distinct(w)) < F.lit(65).cast("long") * F.size(w)


def shouting(text: Column, w: Column) -> Column:
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{ASCII_UPPER[0]}-{ASCII_UPPER[-1]}]+", ""))
    return F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.char_length(text)


def symbols(text: Column, w: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Letter and failure condition, on a text without nulls and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}


class Diagram:
    """A count-weighted decision diagram over the letters of ``order``.

    ``levels[i]`` lists the distinct nodes of level i as (pass child, fail child), numbers of the next level;
    below the last level stand the distinct terminal counts.  Level 0 holds the root.
    """

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]], width: int):
        """``counts`` maps failure masks (bit i: fails ``order[i]``) to their counts, ``width`` numbers each."""
        self.order = list(order)
        none = (0,) * width
        known: dict = {}
        below = [known.setdefault(counts.get(self._mask(i), none), len(known)) for i in range(1 << len(order))]
        self.weights = [list(known)]
        self.levels: list[list[tuple[int, int]]] = []
        for _ in order:
            known = {}
            below = [known.setdefault((below[i], below[i + 1]), len(known)) for i in range(0, len(below), 2)]
            self.levels.insert(0, list(known))
            self.weights.insert(0, self._weigh(self.levels[0], self.weights[0]))

    def _mask(self, path: int) -> int:
        """Terminals stand in path order, first letter decides first: its bit is the highest of the path."""
        n = len(self.order)
        return sum(1 << i for i in range(n) if path >> (n - 1 - i) & 1)

    @staticmethod
    def _weigh(nodes: list[tuple[int, int]], below: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        return [tuple(a + b for a, b in zip(below[p], below[f], strict=True)) for p, f in nodes]

    def swap(self, i: int) -> None:
        """Exchange the letters of levels i and i + 1; every other level, and the weight of each node of level i, stays."""
        lower: dict = {}
        upper = []
        for p, f in self.levels[i]:
            (pp, pf), (fp, ff) = self.levels[i + 1][p], self.levels[i + 1][f]
            upper.append((lower.setdefault((pp, fp), len(lower)), lower.setdefault((pf, ff), len(lower))))
        self.levels[i], self.levels[i + 1] = upper, list(lower)
        self.weights[i + 1] = self._weigh(self.levels[i + 1], self.weights[i + 2])
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(letter, kept, removed) along the all-pass path."""
        node = 0
        for i, letter in enumerate(self.order):
            node, fail = self.levels[i][node]
            yield letter, self.weights[i + 1][node], self.weights[i + 1][fail]


def neighbour_swaps(n: int) -> Iterator[int]:
    """The swaps (Steinhaus, Johnson and Trotter) that lead through all n! orders, each by exchanging neighbours."""
    if n < 2:
        return
    inner, down = list(neighbour_swaps(n - 1)), True
    for k in range(len(inner) + 1):
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if k < len(inner):
            yield inner[k] + 1 if down else inner[k]
        down = not down


def orders(letters: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """The result rows of one part, without its name, from counts (documents, good, toxic) per mask."""
    diagram = Diagram(letters, counts, 3)
    walks = {"".join(diagram.order): list(diagram.steps())}
    for i in neighbour_swaps(len(letters)):
        diagram.swap(i)
        walks["".join(diagram.order)] = list(diagram.steps())
    failing, alone, shapley = {}, {}, dict.fromkeys(letters, 0)
    for walk in walks.values():
        failing[walk[0][0]] = walk[0][2][0]
        alone[walk[-1][0]] = walk[-1][2][0]
        for letter, _, removed in walk:
            shapley[letter] += removed[0]
    return [
        (order, at + 1, kept[0], gone[0], failing[x] - gone[0], alone[x], gone[1], gone[2], shapley[x])
        for order, walk in walks.items()
        for at, (x, kept, gone) in enumerate(walk)
    ]


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", filters: dict | None = None) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and failure mask (bit i: fails the i-th filter, the copy filter last)."""
    filters = FILTERS if filters is None else filters
    plain = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    plain = plain.withColumn("_th", F.unhex(F.md5("_text")))
    copies = stored(plain.groupBy("_th").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_seen")).where("_seen > 1"))
    total = copies.agg(F.sum("_seen")).first()[0] or 0
    fails = [F.when(f(F.col("_text"), F.col("_words")), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters.values())]
    slim = plain.withColumn("_words", words(F.col("_text"))).select("_id", "_th", "part", sum(fails, F.lit(0)).alias("mask"))
    slim = spread_join(slim, copies, ["_th"], F.col("_seen") * HEAVY >= F.lit(total), ["_id", "part"])
    copy = F.when(F.col("_id") > F.col("_least"), F.lit(1 << len(filters))).otherwise(F.lit(0))
    # rows of an id become one row per part and mask before they meet the labels; rows without an id meet none
    slim = slim.withColumn("mask", F.col("mask") + copy).groupBy("_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic")
    )
    rows = slim.join(marks, "_id", "left")
    marked = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("_good").alias("good"), marked("_toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", filters: dict | None = None) -> DataFrame:
    """One row per part, order of the filters and step (``RESULT``).

    Null texts are empty; a null part is the part named by the empty string.  A row without an id is nobody's copy, makes
    none and has no labels.  Repeated rows count each, and rows of one id and one text are not copies of each other.  An id
    labelled more than once is good (toxic) if any label says so.  An empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    letters = "".join(FILTERS if filters is None else filters) + COPY
    cells = F.struct("mask", "n", "good", "toxic")
    # at most 2^filters cells a part
    parts = masks(docs, labels, key, text, part, filters).groupBy("part").agg(F.collect_list(cells).alias("cells"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["cells"]}
                table = [(row["part"], *r) for r in orders(letters, counts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], schema.field(i).type) for i in range(len(names))], schema=schema)

    return parts.mapInArrow(run, RESULT)
