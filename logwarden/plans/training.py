"""Weak labels, model training and retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import (
    MIN_RETRAIN_LINES,
    Models,
    bootstrap_lines,
    fit_models,
    has_models,
    load_models,
    save_models,
)
from ..operators.parse import parse_lines
from ..operators.rules import add_rules, add_rules_in_two_jobs


def label_lines(lines: DataFrame, in_two_jobs: bool = False) -> DataFrame:
    """``line_no, value, label``: 1 where the rules see a threat, 0 elsewhere and if unparsed."""
    texts = lines.select("line_no", "value", F.col("value").alias("text"))
    parsed = parse_lines(texts, mode="keep")
    ruled = add_rules_in_two_jobs(parsed) if in_two_jobs else add_rules(parsed)
    is_threat = F.col("log_type").isNotNull() & F.col("rule.is_threat")
    label = F.when(is_threat, 1.0).otherwise(0.0).alias("label")
    return ruled.select("line_no", F.col("text").alias("value"), label)


def train(lines: DataFrame, names: list[str] | None = None) -> Models:
    """Fit features and classifiers on ``line_no, value`` with rule labels."""
    return fit_models(lines, label_lines(lines, in_two_jobs=True), names)


def load_or_bootstrap(spark: SparkSession, path: str) -> Models:
    """Stored models, or a first set fitted on the bootstrap lines and stored."""
    if not has_models(spark, path):
        save_models(train(bootstrap_lines(spark)), spark, path)
    return load_models(spark, path)


def retrain(lines: DataFrame, path: str) -> Models:
    """Fit on all lines, replace the stored models and return them."""
    if len(lines.take(MIN_RETRAIN_LINES)) < MIN_RETRAIN_LINES:
        raise ValueError(f"retraining needs at least {MIN_RETRAIN_LINES} lines")
    spark = lines.sparkSession
    save_models(train(lines), spark, path)
    return load_models(spark, path)
