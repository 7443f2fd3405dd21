"""Trailing per-address counts that stay exact and balanced when one address is very hot.

Rows of one address are never one task. They are split into cells (address, second, block of 65,536
row numbers), which are pre-aggregated. The trailing sums run over seconds, one group per address and
ten minutes, with the last minute of the ten minutes before; a second's cells are summed among themselves.
Each row adds its rank in its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import unquote
from ..functions.threats import names_login
from ..functions.times import epoch_seconds
from ..session import stage

CELL_BITS = 16
SPAN_SECONDS = 600
OVERLAP_SECONDS = max(V.FLOOD_SECONDS, V.FAILED_LOGIN_SECONDS)

# The hash comes first: sorts then compare one long instead of address texts.
CELL = ["_cell", "ip", "_second", "_block"]


def with_cell(rows: DataFrame) -> DataFrame:
    # Only urls of refused requests are decoded for the login test.
    refused = F.when(F.col("status").isin(*V.REFUSED_STATUS), F.col("url"))
    timed = rows.select(
        "*",
        epoch_seconds(F.col("event_time")).alias("_second"),
        F.shiftright("line_no", CELL_BITS).alias("_block"),
        unquote(refused).alias("_refused"),
    )
    decoded = unquote(F.col("_refused"))
    failed = names_login(F.col("_refused")).cast("bigint").alias("_failed")
    return timed.withColumns({"_cell": cell_hash(), "_refused": decoded}).select(
        *rows.columns, "_cell", "_second", "_block", failed
    )


def cell_hash() -> Column:
    return F.xxhash64("ip", "_second", "_block")


def count_cells(rows: DataFrame) -> DataFrame:
    """Requests and failed logins per cell, of rows that carry an event time."""
    return (
        rows.filter(F.col("_second").isNotNull())
        .groupBy(*CELL)
        .agg(F.count("*").alias("_requests"), F.sum("_failed").alias("_failures"))
    )


def trailing_before_cell(cells: DataFrame, over_limit: bool = False) -> DataFrame:
    """Requests and failed logins of the trailing windows that precede each cell's first row.

    Two levels of sums. Over the seconds of a span there is one row a second, however many cells a second has;
    within a second there is one row a block of line numbers. So no group grows with an address's rows, also
    where line numbers do not run with time and every row is a cell of its own.

    ``over_limit`` keeps only the cells of seconds whose last row breaks a rate limit: other seconds have no such
    row, and their cells are neither joined nor sorted.
    """
    span = F.expr(f"_second div {SPAN_SECONDS}")
    near_end = F.col("_second") % SPAN_SECONDS >= SPAN_SECONDS - OVERLAP_SECONDS
    cells = cells.withColumn("_span", span)

    def copy(offset: int) -> Column:
        return F.struct(
            (F.col("_span") + offset).alias("_in"), F.lit(offset > 0).alias("_overlap")
        )

    copies = F.when(near_end, F.array(copy(0), copy(1))).otherwise(F.array(copy(0)))
    seconds = cells.groupBy("_span", "ip", "_second").agg(
        F.sum("_requests").alias("_requests"), F.sum("_failures").alias("_failures")
    )
    in_span = Window.partitionBy("ip", "_in_span").orderBy("_second")

    def earlier_seconds(column: str, reach: int) -> Column:
        return F.coalesce(F.sum(column).over(in_span.rangeBetween(-reach, -1)), F.lit(0))

    before = (
        seconds.select("*", F.inline(copies)).withColumnRenamed("_in", "_in_span")
        .withColumn("_requests_before", earlier_seconds("_requests", V.FLOOD_SECONDS))
        .withColumn("_failures_before", earlier_seconds("_failures", V.FAILED_LOGIN_SECONDS))
        .filter(~F.col("_overlap"))
    )
    if over_limit:
        before = before.filter(
            _over_limit(
                F.col("_requests_before") + F.col("_requests"), F.col("_failures_before") + F.col("_failures")
            )
        )
    before = before.select(
        F.col("_span").alias("_span_of"), F.col("ip").alias("_ip"), F.col("_second").alias("_at"),
        "_requests_before", "_failures_before",
    )
    same = (
        (cells["_span"] == before["_span_of"])
        & (cells["_second"] == before["_at"])
        & cells["ip"].eqNullSafe(before["_ip"])
    )
    in_second = Window.partitionBy("_span", "ip", "_second").orderBy("_block")
    so_far = in_second.rowsBetween(Window.unboundedPreceding, -1)

    def earlier_here(column: str) -> Column:
        return F.coalesce(F.sum(column).over(so_far), F.lit(0))

    # Spark guesses the seconds' size from that of compressed files and would broadcast millions of them.
    return cells.join(before.hint("merge"), same).select(
        *CELL,
        "_requests",
        "_failures",
        (F.col("_requests_before") + earlier_here("_requests")).alias("_requests_before"),
        (F.col("_failures_before") + earlier_here("_failures")).alias("_failures_before"),
    )


def _in_cell(column: Column) -> Column:
    """Running aggregate of a row's cell, up to the row; a cell has at most 65,536 rows."""
    rows = Window.partitionBy(*CELL).orderBy("line_no")
    return column.over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _requests() -> Column:
    return F.col("_requests_before") + F.col("_requests_in")


def _failures() -> Column:
    return F.col("_failures_before") + F.col("_failures_in")


def add_trailing_counts(rows: DataFrame, earlier_cells: DataFrame | None = None) -> DataFrame:
    """Add ``requests_10s`` and ``failed_logins_60s``, each up to and including the row itself.

    Needs ``ip, event_time, url, status`` and ``line_no`` (unique; orders rows of one second).
    ``earlier_cells`` are cells of rows that came before (a stream's earlier batches).
    """
    split = with_cell(rows)
    cells = count_cells(split)
    if earlier_cells is not None:
        cells = cells.unionByName(earlier_cells)
    before = trailing_before_cell(cells).drop("_requests", "_failures")
    counted = (
        split.withColumn("_requests_in", _in_cell(F.count("*")))
        .withColumn("_failures_in", _in_cell(F.sum("_failed")))
        .join(before, CELL, "left")
    )
    timed = F.col("_second").isNotNull()
    return counted.select(
        *rows.columns,
        F.when(timed, _requests()).otherwise(0).alias("requests_10s"),
        F.when(timed, _failures()).otherwise(0).alias("failed_logins_60s"),
    )


def counts_over_limit(rows: DataFrame) -> DataFrame:
    """``line_no, requests_10s, failed_logins_60s`` of the rows that break a rate limit.

    Only narrow columns move: seconds and then cells whose last row stays within both limits are left out, and
    rows are ranked in the other cells alone.
    """
    narrow = with_cell(rows.select("line_no", "ip", "event_time", "url", "status")).select(
        "line_no", *CELL, "_failed"
    )
    cells = trailing_before_cell(count_cells(narrow), over_limit=True)
    most_requests = F.col("_requests_before") + F.col("_requests")
    most_failures = F.col("_failures_before") + F.col("_failures")
    hot = cells.filter(_over_limit(most_requests, most_failures)).drop("_requests", "_failures")
    counted = (
        narrow.join(hot, CELL)
        .withColumn("_requests_in", _in_cell(F.count("*")))
        .withColumn("_failures_in", _in_cell(F.sum("_failed")))
    )
    return counted.filter(_over_limit(_requests(), _failures())).select(
        "line_no", _requests().alias("requests_10s"), _failures().alias("failed_logins_60s")
    )


def _over_limit(requests: Column, failures: Column) -> Column:
    return (requests > V.FLOOD_MORE_THAN) | (failures >= V.FAILED_LOGIN_AT_LEAST)


def add_counts_over_limit(rows: DataFrame) -> DataFrame:
    """Like ``add_trailing_counts``, but NULL for rows within both limits.

    Runs a job first: it writes the rows over a limit. Spark knows that table's size, so the wide
    rows are not shuffled at all while it is small enough to broadcast; otherwise they are shuffled
    by line number, which no address can skew.
    """
    over = stage(counts_over_limit(rows), "over-limit")
    return rows.join(over, "line_no", "left")
