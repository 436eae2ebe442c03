"""A corpus pipeline of five stages; each takes the documents that the one before it kept.

Every stage takes tables with nulls in any column, empty and very long texts, repeated rows and further columns, also
such as are named like an operator's own; it returns the columns that it got, and an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.llm import decontaminate, langid, linededup, mixing, simhash
from sphaera.llm.common import read, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters, and nulls, go. Learns from four fifths of docs; where
    nothing could be learnt, all texts with letters stay."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.rows.num_rows:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # The operator replaces columns that are named like its results, which docs may have of its own.
    own = docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns})
    told = langid.identify(own, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return told.select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the one with the largest id. Null texts stay null; a text that
    loses all of its lines is empty and stays."""
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    out = linededup.dedup_lines(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; null ids go before all others. Rows that repeat
    the document that stays are copies of it and stay with it."""
    return simhash.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null texts and benchmarks have none."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn with calibrated probabilities, with their weights. Nulls of source and lang are values of
    their own; documents without tokens have weight 0 and are not drawn."""
    tokens = mixing.token_count(F.col("text"))
    found = mixing.mix(docs.withColumn("n_tokens", tokens).withColumn("topic", mixing.topic_of(F.col("text"), F.col("n_tokens"))), ("source", "lang", "topic"), "n_tokens")
    return found.where("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing_to_targets", mixing_to_targets),
]
#: SQL has no SimHash with this hash; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
