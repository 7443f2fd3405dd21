"""The corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes what the one before kept. Shares of a stage's result are decisions of whole texts; nothing is
sampled but the labelled documents that a classifier is fitted on (``quality.SAMPLE``, ``toxicity.SAMPLE``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import jaccard, packing, quality, toxicity
from logwarden.llm.common import table, vocabulary_path
from logwarden.session import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, likeness of 0.8."""
    return jaccard.one_of_each(spark, docs, size=5, percent=80)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, each with its place in a sequence of at most 4,096 ids."""
    return packing.pack(spark, docs, vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality", good_documents),
    ("toxicity", clean_documents),
    ("near_duplicates", different_documents),
    ("packing", packed_sequences),
]

#: Classifiers and tokenisation are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
