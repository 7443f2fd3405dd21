"""Rule verdicts on parsed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unquote
from ..functions.threats import is_sensitive_path, rule_number, rule_verdict, signature_name
from ..session import stage
from .rates import add_counts_over_limit, add_trailing_counts


def with_decoded_url(rows: DataFrame) -> DataFrame:
    if "decoded_url" in rows.columns:
        return rows
    # Two steps: the first result is used several times in the second.
    once = rows.withColumn("_once", unquote(F.col("url")))
    return once.withColumn("decoded_url", unquote(F.col("_once"))).drop("_once")


def add_rules(rows: DataFrame, earlier_cells: DataFrame | None = None) -> DataFrame:
    """Add ``requests_10s, failed_logins_60s`` and the ``rule`` verdict, by event time."""
    return _add_verdict(add_trailing_counts(_match_url(rows), earlier_cells))


def add_rules_in_two_jobs(rows: DataFrame) -> DataFrame:
    """The same verdicts; the counts of rows within the limits are NULL.

    For large tables: the parsed rows are written once, so that lines are read and parsed once. The rate limits
    are checked first, on five narrow columns of that table, and the wide rows are then judged without a
    shuffle unless very many of them break a limit.
    """
    return _add_verdict(_match_url(add_counts_over_limit(stage(rows, "parsed"))))


def add_url_rules(rows: DataFrame) -> DataFrame:
    """``rule`` from url and status alone, for rows without a time."""
    return _add_verdict(
        _match_url(rows)
        .withColumn("requests_10s", F.lit(0).cast("bigint"))
        .withColumn("failed_logins_60s", F.lit(0).cast("bigint"))
    )


def _match_url(rows: DataFrame) -> DataFrame:
    """Pattern tests, before the shuffle: the input has more tasks than the counted rows."""
    url = F.col("decoded_url")
    return (
        with_decoded_url(rows)
        .withColumn("_signature", signature_name(url))
        .withColumn("_sensitive", is_sensitive_path(url))
    )


def _add_verdict(counted: DataFrame) -> DataFrame:
    url, status, signature = F.col("decoded_url"), F.col("status"), F.col("_signature")
    counts = F.col("requests_10s"), F.col("failed_logins_60s")
    number = rule_number(url, status, signature, F.col("_sensitive"), *counts)
    rule = rule_verdict(F.col("_rule"), url, status, signature, *counts)
    ruled = counted.withColumn("_rule", number).withColumn("rule", rule)
    return ruled.drop("_rule", "_signature", "_sensitive")


def flat_rule(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, "rule.*")
