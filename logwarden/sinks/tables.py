"""Writers. All of them write in parallel; none collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXPORT_COLUMNS


def write_store(
    rows: DataFrame, path: str, mode: str = "append", gather_dates: bool = False
) -> None:
    """The enriched table: parquet, one folder per event date, so time filters prune files.

    ``gather_dates`` is for rows of many dates: one more shuffle puts each date into few files, and
    still splits a date that holds most rows.
    """
    dated = rows.withColumn("event_date", F.to_date("event_time"))
    if gather_dates:
        dated = dated.hint("rebalance", "event_date")
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def export_rows(rows: DataFrame) -> DataFrame:
    """The 13 export columns; severity is the display name."""
    named = rows.withColumn("threat_severity", F.col("display_severity"))
    return named.select(*EXPORT_COLUMNS)


def page_rows(rows: DataFrame) -> DataFrame:
    """The 9 columns of the log list export."""
    return rows.select(
        F.col("timestamp").alias("Timestamp"),
        F.col("ip").alias("IP Address"),
        F.col("method").alias("Method"),
        F.col("url").alias("URL"),
        F.col("status").alias("Status Code"),
        F.col("severity").alias("Severity"),
        F.col("prediction").alias("Verdict"),
        F.col("anomaly_score").alias("Probability Score"),
        F.col("country").alias("Country"),
    )


def map_rows(rows: DataFrame) -> DataFrame:
    """The 13 columns of the threat map export."""
    return rows.select(
        F.col("timestamp").alias("Timestamp"),
        F.col("ip").alias("IP Address"),
        F.col("country").alias("Country"),
        F.col("city").alias("City"),
        F.col("isp").alias("ISP"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.col("display_severity").alias("Severity"),
        F.col("threat_type").alias("Attack Type"),
        F.col("method").alias("Method"),
        F.col("url").alias("URL"),
        F.col("status").alias("Status Code"),
        F.col("anomaly_score").alias("Anomaly Score"),
    )


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header (also for no rows); quotes inside a value are doubled."""
    flat = rows.select(*[_flat(rows, f.name) for f in rows.schema])
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}
    flat.write.mode(mode).options(**options).csv(path)


def _flat(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.typeName()
    column = F.col(f"`{name}`")
    return F.to_json(column).alias(name) if kind in ("struct", "map", "array") else column


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Whole records as JSON lines, nested fields kept."""
    rows.write.mode(mode).json(path)


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("record"))


def append_raw(lines: DataFrame, path: str, batch_id: int) -> None:
    """Add raw lines to the archive; writing the same batch again replaces it."""
    lines.select("value").write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch_id}")
