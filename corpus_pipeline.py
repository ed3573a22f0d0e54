"""From raw documents to a training mix: five stages, each a text operator at work on all its predecessor kept.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows and empty tables.  Further columns
of the documents pass through under their names, whatever these are; only the last stage replaces those that are named
like its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import decontaminate, mixing, pii, quality, simhash
from logwarden.llm.common import remainder, row_key, set_aside, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labels that the operator's query learns from.

    Null and empty texts are scored as empty; equal rows are kept or dropped alike.
    """
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash component the document of least id, once (without ids: one of its documents).

    Null and empty texts are near copies of each other; of different texts under the least id the one of least hash stays.
    """
    seen = simhash.near_duplicates(docs)
    keep = seen.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("_id", "_th")).alias("_one")).select("_one.*")
    plain = set_aside(docs, "doc_id", "text")
    keyed = plain.select("*", *row_key("doc_id", "text"))
    return keyed.join(keep, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(*plain.columns).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; null and empty texts have no words and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text.  Null texts stay null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights: one row per document and epoch, in block order by ``epoch, block_rank``.

    A null source is a source; columns of the documents named like the four results are replaced.
    """
    drawn, made = mixing.mix(docs), ("n_tokens", "epoch", "block", "block_rank")
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in made], *made)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
