"""A corpus pipeline: five stages over the documents, each of which takes what the one before it kept.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the result is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Defined cases: an empty table gives an empty result with the same columns; null texts are empty ones, which
the classifier rejects as soon as there are labels (without any it rejects nothing); of rows that repeat id and
text, and of equal texts, one goes on, with the smallest id (one without an id only if all are); a document
without words is no near duplicate and not contaminated; other columns go through all stages but
the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe_codec, decontam, exact_dedup, near_dedup, quality_knn
from tessella.llm.common import shared_path, table
from tessella.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_knn.accepted(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words and a similarity of 0.8 or more."""
    return near_dedup.dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text and the text that they decode to."""
    return bpe_codec.encode_column(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), keep=["doc_id"])


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("encode", encode)]

#: The classifier and the components of near duplicates are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to ids."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
