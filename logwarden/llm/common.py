"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: str, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def row_key(key: str, text: str) -> list[Column]:
    """``_id, _th``: equality on both joins a row back to itself (equal rows share a key, and their results)."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")]


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with every column but ``used`` renamed by position, out of the way of an operator's own names; ``toDF`` of the old names undoes it."""
    return docs.toDF(*[c if c in used else f"_aside{i}" for i, c in enumerate(docs.columns)])


def stratified_sample(df: DataFrame, stratum: str, key: str, counts: dict, rows: int) -> DataFrame:
    """At most ``rows`` rows of each stratum, those of smallest key hash; the same on every run.

    ``counts`` holds the rows of each stratum; only about 1.5 times the wanted rows are ranked.
    """
    size = df.sparkSession.createDataFrame(list(counts.items()), df.select(stratum, F.lit(0).cast("long").alias("_n")).schema)
    drawn = F.xxhash64(F.lit("sample"), F.col(key))
    near = df.withColumn("_draw", drawn).join(F.broadcast(size), stratum).where(F.pmod("_draw", F.lit(1 << 30)) < F.lit(float((1 << 30) * (1.5 * rows + 64))) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.pmod("_draw", F.lit(1 << 30)), "_draw", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= rows).select(*df.columns)


#: A key with at least this share of all weight has fewer than ``HEAVY`` peers: their number is bounded whatever the input.
HEAVY = 1_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], heavy: Column, deal: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` (unique and not null on ``on``), null where nothing matches.

    ``heavy`` marks rows of ``right`` whose number is bounded by construction; they are broadcast, and the left rows
    that meet them are dealt out by a hash of the columns ``deal``, so that no hot key lands in one task.
    """
    rest = [c for c in right.columns if c not in on]
    top = right.where(heavy).select(*on, F.struct(*rest).alias("_top"))
    low = right.where(~heavy).select(*on, F.struct(*rest).alias("_low"), F.lit(0).cast("long").alias("_deal"))
    met = left.join(F.broadcast(top), on, "left").withColumn("_deal", F.when(F.col("_top").isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(*deal), 1) + 1).cast("long"))
    met = met.join(low, [*on, "_deal"], "left").withColumn("_top", F.coalesce("_top", "_low"))
    return met.select(*left.columns, *[F.col("_top").getField(c).alias(c) for c in rest])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  Pure ASCII takes the fast path, other texts are translated letter by letter."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def batches(table_or_batch: pa.RecordBatch, columns: list[str]) -> list[list]:
    return [table_or_batch.column(c).to_pylist() for c in columns]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
