"""Merges of row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name."""
    return old.unionByName(new, allowMissingColumns=True)


def add_missing(rows: DataFrame, extra: DataFrame, key: str = "ip") -> DataFrame:
    """``rows`` plus those of ``extra`` whose key ``rows`` does not have."""
    missing = extra.join(rows.select(key), key, "left_anti").select(*rows.columns)
    return rows.unionByName(missing)
