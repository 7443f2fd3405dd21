"""Order, pages and retention. ``ingest_seq`` makes "newest first" explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 500
INDEX_BITS = 16


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("ingest_seq"))


def keep_latest(rows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows: every task keeps its own best ``n``, no full sort."""
    return newest_first(rows).limit(n)


def newest_part(rows: DataFrame, n: int) -> DataFrame:
    """Rows at least as new as the ``n``-th newest, found by one small job.

    That job reads one column; afterwards the scan skips all parts of a stored table that are older.
    """
    newest = newest_first(rows.select("ingest_seq")).limit(n)
    oldest = newest.agg(F.min("ingest_seq")).first()[0]
    return rows if oldest is None else rows.filter(F.col("ingest_seq") >= oldest)


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, newest first."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page {number} of {size} rows (at most {MAX_PAGE})")
    return newest_first(rows).offset((number - 1) * size).limit(size)


def page_before(rows: DataFrame, ingest_seq: int, size: int = 50) -> DataFrame:
    """The page after the row ``ingest_seq``: its cost does not grow with the page's depth."""
    return keep_latest(rows.filter(F.col("ingest_seq") < ingest_seq), size)


def page_index(rows: DataFrame, bits: int = INDEX_BITS) -> DataFrame:
    """``range, count``: rows in each range of 2^``bits`` numbers; one pass over one column.

    Written once (and added to with each batch), it finds any page without a sort of the table.
    """
    return rows.groupBy(F.shiftright("ingest_seq", bits).alias("range")).agg(F.count("*").alias("count"))


def page_by_index(
    rows: DataFrame, index: DataFrame, number: int = 1, size: int = 50, bits: int = INDEX_BITS
) -> DataFrame:
    """``page`` by the counts of ``page_index``: only the ranges that hold the page are read and sorted.

    A sum over the index, newest range first, finds them; one row with their bounds comes to the driver. The index must be that of the same rows, filters included.
    """
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page {number} of {size} rows (at most {MAX_PAGE})")
    first = (number - 1) * size
    newer = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("newer", F.coalesce(F.sum("count").over(newer), F.lit(0)))
    reached = placed.filter(
        (F.col("newer") < first + size) & (F.col("newer") + F.col("count") > first)
    )
    found = reached.agg(
        F.min("range").alias("oldest"), F.max("range").alias("newest"), F.min("newer").alias("newer")
    ).first()
    if found["oldest"] is None:
        return newest_first(rows).limit(0)
    low, high = found["oldest"] << bits, (found["newest"] + 1) << bits
    near = rows.filter((F.col("ingest_seq") >= low) & (F.col("ingest_seq") < high))
    return newest_first(near).offset(first - found["newer"]).limit(size)


def page_counts(rows: DataFrame, condition: Column, size: int = 50) -> DataFrame:
    """One row: all rows, rows that pass ``condition``, and pages they fill."""
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(condition).alias("filtered_count")
    )
    pages = F.greatest(F.lit(1), F.ceil(F.col("filtered_count") / size)).cast("bigint")
    return counts.withColumn("pages", pages)


def top_by_count(counts: DataFrame, key: str, k: int, count: str = "count") -> DataFrame:
    """Largest counts first, ties by key."""
    return counts.orderBy(F.desc(count), F.asc(key)).limit(k)


def last_keys(series: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` greatest keys, in ascending order."""
    return series.orderBy(F.desc(key)).limit(n).orderBy(key)


def latest_threats(rows: DataFrame, n: int = 100) -> DataFrame:
    if not 1 <= n <= 1000:
        raise ValueError(f"1 to 1000 threats, not {n}")
    return keep_latest(rows.filter(F.col("prediction") == "Anomaly"), n)
