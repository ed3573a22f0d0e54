"""Benchmark decontamination by a positional inverted index.  DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window).
For every window its two rarest terms, by counts over the whole corpus, are chosen;
postings (row, position) of the chosen terms are stored.  A posting minus the term's
offset in the item is an alignment of item and document; alignments on which both
rare terms of a window meet are candidates, and the words under them are compared.
Maximal runs of at least a window's length are the exact phrase matches.

``proximity`` returns the looser matches: documents in which the rare terms of a
window lie within ``slop`` words of their places.

Benchmark side tables are broadcast only up to ``SMALL_WORDS`` words; beyond it the
same joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, set_aside, stored

WINDOW = 13
SMALL_WORDS = 1_000_000
#: Words are runs of digits, a-z and all characters beyond ASCII.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


class Index:
    """What is asked for (items and their rare terms) and where the corpus holds it (postings)."""

    def __init__(self, docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW):
        self.window = window
        self.docs = docs.select(*row_key(key, text), F.col(text).alias("_text"))
        self.items = stored(
            items.select(F.col(item_key).cast("string").alias("item"), words(F.col(item_text)).alias("iwords"))
            .where(F.size("iwords") > 0).distinct()
            .select(F.sha2(F.concat_ws(" ", F.coalesce("item", F.lit("")), F.concat_ws(" ", "iwords")), 256).alias("ikey"), "item", "iwords")
        )
        self.small = (self.items.agg(F.sum(F.size("iwords"))).first()[0] or 0) <= SMALL_WORDS
        self.places = self._places()
        self.postings = stored(self._tokens().join(self._side(self.places.select("term").distinct()), "term"))

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def _tokens(self) -> DataFrame:
        return self.docs.select("_id", "_th", F.posexplode(words(F.col("_text"))).alias("pos", "term"))

    def _places(self) -> DataFrame:
        """``ikey, first, second, term, ipos``: for every window the places of its two rarest terms, one row for each place."""
        spots = self.items.select("ikey", F.size("iwords").alias("n"), F.posexplode("iwords").alias("ipos", "term"))
        tokens = self.docs.select(F.explode(words(F.col("_text"))).alias("term"))
        counts = tokens.join(self._side(spots.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
        spots = spots.join(counts, "term", "left").withColumn("rank", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "ipos"))
        ahead = Window.partitionBy("ikey").orderBy("ipos").rowsBetween(0, self.window - 1)
        rare = F.slice(F.array_sort(F.collect_list("rank").over(ahead)), 1, 2)
        pairs = spots.withColumn("rare", rare).where(F.col("ipos") <= F.greatest(F.lit(0), F.col("n") - self.window))
        pairs = pairs.select("ikey", F.col("rare")[0]["ipos"].alias("first"), F.element_at("rare", -1)["ipos"].alias("second")).distinct()
        both = pairs.withColumn("ipos", F.explode(F.array_distinct(F.array("first", "second"))))
        return stored(both.join(spots.select("ikey", "ipos", "term"), ["ikey", "ipos"]))

    def alignments(self) -> DataFrame:
        """``_id, _th, ikey, delta``: where the two rarest terms of some window stand at their offsets."""
        at = self.postings.join(self._side(self.places.select("term", "ikey", "ipos").distinct()), "term")
        met = at.groupBy("_id", "_th", "ikey", (F.col("pos") - F.col("ipos")).alias("delta")).agg(F.collect_set("ipos").alias("met"))
        pairs = self.places.groupBy("ikey").agg(F.collect_set(F.struct("first", "second")).alias("pairs"))
        both = met.join(self._side(pairs), "ikey")
        return both.where(F.exists("pairs", lambda p: F.array_contains("met", p["first"]) & F.array_contains("met", p["second"]))).select("_id", "_th", "ikey", "delta")

    def proximity(self, slop: int = 5) -> DataFrame:
        """``_id, _th, item``: both rare terms of a window stand within ``slop`` words of their distance, in any order of error."""
        sides = {}
        for name in ("first", "second"):
            sides[name] = self.postings.join(self._side(self.places.where(F.col("ipos") == F.col(name)).select("term", "ikey", "first", "second")), "term").select(
                "_id", "_th", "ikey", "first", "second", F.floor((F.col("pos") - F.col(name)) / (slop + 1)).alias("cell"), (F.col("pos") - F.col(name)).alias(f"at_{name}")
            )
        # one row for each cell and place: the extremes of a cell decide whether a neighbour is within reach
        near = sides["first"].groupBy("_id", "_th", "ikey", "first", "second", "cell").agg(F.sort_array(F.collect_set("at_first")).alias("firsts"))
        reach = sides["second"].withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        hit = reach.join(near, ["_id", "_th", "ikey", "first", "second", "cell"]).where(F.exists("firsts", lambda a: F.abs(a - F.col("at_second")) <= slop))
        return hit.select("_id", "_th", "ikey").distinct().join(self._side(self.items.select("ikey", "item")), "ikey").select("_id", "_th", "item").distinct()

    def matches(self) -> DataFrame:
        """``_id, _th, item, start, stop``: maximal runs of words that are whole windows of an item (stop exclusive)."""
        sized = self.alignments().join(self._side(self.items.select("ikey", F.size("iwords").alias("n"))), "ikey")
        asked = sized.groupBy("_id", "_th").agg(F.collect_list(F.struct("ikey", "delta", "n")).alias("asked"))
        held = self.docs.join(asked, ["_id", "_th"]).select("_id", "_th", "asked", words(F.col("_text")).alias("dwords"))
        # a row for each alignment carries only the words under the item
        under = lambda c: F.slice(F.col("dwords"), F.greatest(c["delta"], F.lit(0)) + 1, c["n"] + F.least(c["delta"], F.lit(0)))
        seen = held.select("_id", "_th", F.explode(F.transform("asked", lambda c: F.struct(c["ikey"].alias("ikey"), c["delta"].alias("delta"), under(c).alias("seg")))).alias("c")).select("_id", "_th", "c.*")
        both = seen.join(self._side(self.items), "ikey")
        lead = F.greatest(-F.col("delta"), F.lit(0))
        same = F.transform(F.sequence(F.lit(0), F.size("iwords")), lambda i: F.coalesce((i < F.size("iwords")) & (i >= lead) & (F.get("seg", i - lead) == F.get("iwords", i)), F.lit(False)))
        need = F.least(F.lit(self.window), F.size("iwords"))
        none = F.array().cast("array<struct<start:int,stop:int>>")
        run = lambda acc, hit: F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(hit, acc["run"] + 1).otherwise(0).alias("run"),
            F.when(~hit & (acc["run"] >= need), F.concat(acc["out"], F.array(F.struct((F.col("delta") + acc["i"] - acc["run"]).alias("start"), (F.col("delta") + acc["i"]).alias("stop"))))).otherwise(acc["out"]).alias("out"),
        )
        runs = F.aggregate(same, F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), none.alias("out")), run)["out"]
        return both.select("_id", "_th", "item", F.explode(runs).alias("r")).select("_id", "_th", "item", "r.start", "r.stop").distinct()


def hits(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``_id, _th, key, n_words, n_hit, n_items, items, contaminated`` per row of ``docs``.

    ``items`` holds the ids (as text, sorted, null ids left out) of items with an occurring window; ``n_items`` counts
    items without an id as one.  A row is contaminated if at least one in ``share`` of its words is hit.  Null and empty texts have no words.  Items without words, and an
    empty benchmark, hit nothing.  Items of one id count once.  Repeated rows give repeated results.
    """
    index = Index(docs, items, key=key, text=text, item_key=item_key, item_text=item_text, window=window)
    found = index.matches().groupBy("_id", "_th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("stop") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("_nameless"),
    )
    base = docs.select(*row_key(key, text), F.col(key), F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = base.join(found, ["_id", "_th"], "left").withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    )
    return out.withColumn("n_items", F.size("items") + F.coalesce("_nameless", F.lit(0).cast("long"))).drop("_nameless").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with the columns of ``docs``, whatever the names of the others."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    bad = hits(docs, items, **options).where("contaminated").select("_id", "_th").distinct()
    plain = set_aside(docs, key, text)
    return plain.select("*", *row_key(key, text)).join(bad, ["_id", "_th"], "left_anti").select(*plain.columns).toDF(*docs.columns)
