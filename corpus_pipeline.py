"""From raw documents to encoded training rows, in five stages; each is written as Parquet and read again by the next.

Every stage keeps null ids, null texts, repeated rows and further columns as its operator defines, and an empty table stays
empty. Columns of its own carry a leading double underscore or live in one struct, so columns of the documents may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import dedup, mixing, pieces, pii, quality
from kinelake.llm.common import stage
from kinelake.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table; null and empty texts go."""
    return docs.where(quality.keeps(F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are linked at similarity 0.8 or more."""
    return dedup.drop_duplicates(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by marks of its kind."""
    return pii.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources at their target weights, budgets met by length."""
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document in the mix: doc_id, sample, ids and their probabilities."""
    return pieces.encode(docs, vocabulary(spark)).drop("round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing_weights),
    ("encode_pieces", encode_pieces),
]

#: Neither linking near duplicates transitively nor the sampled search over segmentations is SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
