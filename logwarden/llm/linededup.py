"""Line de-duplication.  DataFrame functions only.

Lines are exploded with their position, normalised and hashed to 128 bits.  Distinct
documents are counted per hash; a hash found in enough documents loses its lines
everywhere but in the document of largest id.  The lost positions come back to their
row, and the other positions are joined again in order.

Only hashes, ids and positions are shuffled before the last step.  Counting combines
the lines of a task first and is dealt out by hash and document; the few hashes that
hold a thousandth of all repeated lines are met by broadcast (``spread_join``), so a
line that stands in a third of all documents is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, ascii_lower, row_key, spread_join, stored

MIN_CHARS = 20
MIN_DOCS = 3
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``_id, _th, pos, h`` for every line long enough to be judged."""
    # the row's hash is taken before the explode, not once a line
    rows = docs.select(*row_key(key, text), F.col(text).alias("_text")).select("_id", "_th", F.posexplode(_split(F.col("_text"))).alias("pos", "line"))
    keyed = rows.select("_id", "_th", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return keyed.select("_id", "_th", "pos", F.unhex(F.md5("k")).alias("h"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h, n, last, seen``: the hashed line keys found in at least ``min_docs`` documents, their documents, largest id and lines."""
    lines = _lines(docs, key, text, min_chars)
    return lines.groupBy("h").agg(F.count_distinct("_id").alias("n"), F.max("_id").alias("last"), F.count(F.lit(1)).alias("seen")).where(F.col("n") >= min_docs)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``key, n_lines, n_dropped, kept`` and the other columns under the struct ``row``.

    Null and empty texts are one empty line (``kept`` is empty).  Rows of one id are one document, and so are all rows
    without an id, which count as the smallest; of a line repeated within the document that keeps it, all stay.  An
    empty table gives no rows.  Other columns, whatever their names, are only carried.
    """
    common = stored(repeated_lines(docs, key, text, min_chars=min_chars, min_docs=min_docs))
    total = common.agg(F.sum("seen")).first()[0] or 0
    met = spread_join(_lines(docs, key, text, min_chars), common, ["h"], F.col("seen") * HEAVY >= F.lit(total), ["_id", "_th", "pos"])
    gone = met.where(F.col("_id") < F.col("last")).groupBy("_id", "_th").agg(F.collect_set("pos").alias("_gone"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.col(key).alias("_key"), *row_key(key, text), F.col(text).alias("_text"), F.struct(*others).alias("row"))
    back = rows.join(gone, ["_id", "_th"], "left").withColumn("_lines", _split(F.col("_text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    # positions without the lost ones: linear in the lines, however long the text
    return back.withColumn("_left", F.when(F.col("_gone").isNotNull(), left)).select(
        F.col("_key").alias(key),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_left")).cast("long").alias("n_dropped"),
        F.when(F.col("_left").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.transform("_left", lambda p: F.get("_lines", p)), "\n")).alias("kept"),
        "row",
    )


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text of every row replaced by its kept lines; null texts stay null."""
    named = docs.select("*", F.col(text).isNull().alias("_was_null")) if "_was_null" not in docs.columns else docs.withColumn("_was_null", F.col(text).isNull())
    out = deduplicate(named, key, text, min_chars=min_chars, min_docs=min_docs)
    value = {key: F.col(f"`{key}`"), text: F.when(~F.col("row")["_was_null"], F.col("kept"))}
    return out.select(*[value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
