"""Text features of log lines: words, word pairs and their TF-IDF weights."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY_SIZE = 1000


def _term_stages() -> list:
    words = RegexTokenizer(
        inputCol="value", outputCol="_words", pattern=r"(?U)\w+", gaps=False, toLowercase=True
    )
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    both = SQLTransformer(
        statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"
    )
    return [words, pairs, both]


def _transform(stages: list, df: DataFrame) -> DataFrame:
    for one in stages:
        df = one.transform(df)
    return df


def count_terms(lines: DataFrame) -> DataFrame:
    """``term, term_count, line_count``: occurrences, and lines with the term.

    Terms of a line are sorted, so the first of each run marks the line once: both counts come from
    one partial aggregation, without a row per (line, term).
    """
    terms = _transform(_term_stages(), lines.select("value")).select(
        F.array_sort("_terms").alias("terms")
    )
    runs = F.transform(
        "terms",
        lambda term, i: F.struct(
            term.alias("term"),
            F.when((i > 0) & (term == F.get(F.col("terms"), i - 1)), 0).otherwise(1).alias("first"),
        ),
    )
    return (
        terms.select(F.inline(runs))
        .groupBy("term")
        .agg(F.count("*").alias("term_count"), F.sum("first").alias("line_count"))
    )


def fit_features(lines: DataFrame, size: int = VOCABULARY_SIZE) -> PipelineModel:
    """The ``size`` most frequent terms (ties by text), weighted ln((1+n)/(1+df)) + 1, unit length.

    Only the chosen terms reach the driver.
    """
    n = lines.count()
    terms = (
        count_terms(lines).orderBy(F.desc("term_count"), "term").limit(size).collect()
    )
    if not terms:
        raise ValueError("no terms to build features from")
    weights = [math.log((1 + n) / (1 + row["line_count"])) + 1 for row in terms]
    counts = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in terms], inputCol="_terms", outputCol="_counts"
    )
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(weights), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")
    return PipelineModel([*_term_stages(), counts, weighted, unit])


def add_features(model: PipelineModel, lines: DataFrame) -> DataFrame:
    """Add ``features`` computed from ``value``."""
    made = ("_words", "_pairs", "_terms", "_counts", "_weighted")
    return model.transform(lines).drop(*made)
