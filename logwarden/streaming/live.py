"""Live ingest and running figures on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..functions import fixed_values as V
from ..functions.text import attack_label, percent
from ..functions.threats import is_failed_login
from ..operators.filters import is_anomaly, is_failed_request, is_high_alert
from ..operators.models import Models
from ..operators.parse import parse_lines, tag_batch
from ..operators.rates import (
    OVERLAP_SECONDS,
    add_trailing_counts,
    cell_hash,
    count_cells,
    with_cell,
)
from ..operators.rules import with_decoded_url
from ..plans.pipeline import STORE_COLUMNS, judge
from ..session import observed
from ..sinks.tables import write_store
from ..sources.text import BLOCK, use_all_cores

ALLOWED_LATENESS_SECONDS = 120
ROW_BITS = 24
PARTITION_BITS = 14
EARLIER_BLOCK = -1  # cells of earlier batches come before every cell of this one

IDLE_SECONDS = 86_400  # an address that sends nothing for a day of wall time loses its history

CELL_SCHEMA = (
    "ip string, _second bigint, _block bigint, _cell bigint, _requests bigint, _failures bigint"
)
HISTORY_SCHEMA = f"{CELL_SCHEMA}, _seen bigint"


def number_rows(batch: DataFrame, batch_id: int) -> DataFrame:
    """Add ``ingest_seq``: batch, then partition, then row, so later batches sort after.

    Spark packs files into partitions by size, so a batch that names its blocks is numbered by path and
    block instead of partition.
    """
    columns = batch.columns
    if set(BLOCK) <= set(columns):
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        blocks = rows.groupBy(*BLOCK).agg(F.min("_row").alias("_first"))
        place = F.row_number().over(Window.orderBy(*BLOCK)).cast("bigint") - 1
        batch = rows.join(F.broadcast(blocks.withColumn("_place", place)), BLOCK)
        row, part = F.col("_row") - F.col("_first"), F.col("_place")
        columns = [c for c in columns if c not in BLOCK]
    else:
        row = F.monotonically_increasing_id() % (1 << 33)
        part = F.spark_partition_id().cast("bigint")
    fits = (row < (1 << ROW_BITS)) & (part < (1 << PARTITION_BITS))
    packed = F.lit(batch_id << (ROW_BITS + PARTITION_BITS)).cast("bigint") + part * (1 << ROW_BITS) + row
    too_many = F.raise_error(F.lit("too many rows in one batch: lower maxFilesPerTrigger"))
    number = F.when(fits, packed).otherwise(too_many.cast("bigint"))
    return batch.select(*columns, number.alias("ingest_seq"))


# --- per-address history -----------------------------------------------------------------------
def earlier_cells(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """Cells the batch before ``batch_id`` left; none for the first batch."""
    if batch_id == 0:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(_history_folder(state, batch_id - 1))


def _history_folder(state: str, batch_id: int) -> str:
    """Two folders in turn: a batch never overwrites the history it reads."""
    return f"{state}/{batch_id % 2}"


def save_cells(parsed: DataFrame, earlier: DataFrame, state: str, batch_id: int) -> None:
    """Write the history after this batch: one row per address and second still in reach.

    Reach is counted back from an address's own newest second, so another address's wrong clock cannot
    cut it; addresses go ``IDLE_SECONDS`` of wall time after their last rows came, however many batches that
    is. A repeated batch reads the same history again and writes the same counts.
    """
    now = int(time.time())
    cells = count_cells(with_cell(parsed)).withColumn("_seen", F.lit(now).cast("bigint"))
    seconds = cells.unionByName(earlier, allowMissingColumns=True).groupBy("ip", "_second").agg(
        F.sum("_requests").alias("_requests"),
        F.sum("_failures").alias("_failures"),
        F.max("_seen").alias("_seen"),
    )
    newest = seconds.groupBy("ip").agg(
        F.max("_second").alias("_newest"), F.max("_seen").alias("_last_seen")
    )
    in_reach = F.col("_second") >= F.col("_newest") - (OVERLAP_SECONDS + ALLOWED_LATENESS_SECONDS)
    kept = seconds.join(newest, seconds["ip"].eqNullSafe(newest["ip"])).drop(newest["ip"])
    kept = kept.filter(in_reach & (F.col("_last_seen") > now - IDLE_SECONDS))
    merged = kept.withColumn("_block", F.lit(EARLIER_BLOCK).cast("bigint"))
    merged.withColumn("_cell", cell_hash()).drop("_newest", "_last_seen").write.mode(
        "overwrite"
    ).parquet(_history_folder(state, batch_id))


def _with_history(
    state: str, parse: Callable[[DataFrame], DataFrame], use: Callable[[DataFrame, DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: parse once, use rows and history, then save the history."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        numbered = number_rows(batch, batch_id)
        if "line_no" not in batch.columns:
            numbered = numbered.withColumn("line_no", F.col("ingest_seq"))
        # A file of some megabytes is one task; the numbers are given before its rows are dealt out.
        parsed = parse(use_all_cores(numbered)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            earlier = earlier_cells(spark, state, batch_id)
            use(parsed, earlier.drop("_seen"), batch_id)
            save_cells(parsed, earlier, state, batch_id)
        finally:
            parsed.unpersist()

    return run


def trailing_stream(
    lines: DataFrame, output: str, state: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append rows with exact trailing counts, which reach back into earlier batches.

    The counts are the batch operator's, so a hot address is split here too: the history is a table
    of (address, second) counts, not one keyed state that a single task must hold.
    """

    def use(parsed: DataFrame, earlier: DataFrame, batch_id: int) -> None:
        add_trailing_counts(parsed, earlier).write.mode("overwrite").parquet(
            f"{output}/batch={batch_id}"
        )

    run = _with_history(state, lambda batch: parse_lines(batch, "apache"), use)
    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_batch(
    store: str,
    state: str,
    figures: str | None = None,
    models: Models | None = None,
    classifier: str = "isolation_forest",
    profile_places: bool = True,
    strict: bool = False,
    metadata: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """What ``ingest_stream`` does with each batch of lines and its number.

    Every batch owns the folder ``batch=<id>`` of the store, the ``figures`` and the ``metadata``: a repeated
    batch replaces its rows, partial figures and metadata, so nothing is counted twice.
    """

    def use(parsed: DataFrame, earlier: DataFrame, batch_id: int) -> None:
        rows = judge(parsed, models, classifier, profile_places, True, earlier)
        seen, start = Observation(f"batch {batch_id}"), time.perf_counter()
        tagged = tag_batch(rows, batch_id).select(*STORE_COLUMNS).observe(seen, F.count("*").alias("rows"))
        own = f"{store}/batch={batch_id}"
        # Each date in few files: a batch has few rows for each date and task, and a file has its fixed cost.
        write_store(tagged, own, "overwrite", gather_dates=True)
        if metadata is not None:
            seconds = max(time.perf_counter() - start, 1e-3)
            n = observed(seen, rows=0)["rows"]
            row = (n, round(seconds, 3), int(n / seconds), parsed.rdd.getNumPartitions(), f"RDD-0{batch_id}")
            one = parsed.sparkSession.createDataFrame([row], METADATA_SCHEMA).coalesce(1)
            one.write.mode("overwrite").parquet(f"{metadata}/batch={batch_id}")
        if figures is not None:
            # From the stored columns, not by judging the lines again.
            stored = parsed.sparkSession.read.schema(tagged.schema).parquet(own)
            figure_counts(stored).write.mode("overwrite").parquet(f"{figures}/batch={batch_id}")

    return _with_history(state, lambda batch: parse_lines(batch, "apache", strict=strict), use)


def ingest_stream(
    lines: DataFrame,
    store: str,
    state: str,
    checkpoint: str,
    models: Models | None = None,
    classifier: str = "isolation_forest",
    profile_places: bool = True,
    strict: bool = False,
    trigger: dict | None = None,
    figures: str | None = None,
    metadata: str | None = None,
) -> StreamingQuery:
    """Parse, judge and place each batch and add it to the store, exactly once per batch.

    With ``figures``, each batch's partial counts are kept there for ``read_kpis`` and ``read_counts``; with
    ``metadata``, a row for each batch (``METADATA_SCHEMA``) for ``read_metadata``.
    """
    run = ingest_batch(store, state, figures, models, classifier, profile_places, strict, metadata)
    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_store(spark: SparkSession, store: str, files_per_batch: int | None = None) -> DataFrame:
    """The store as a stream of enriched rows."""
    schema = spark.read.parquet(store).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(store)


# --- running figures ---------------------------------------------------------------------------
FIGURES_SCHEMA = (
    "prediction string, display_severity string, label string, failed boolean, high boolean,"
    " count bigint"
)


METADATA_SCHEMA = (
    "records_processed bigint, execution_time_sec double, processing_speed_lps bigint,"
    " partitions int, batch_id string"
)


def read_metadata(spark: SparkSession, metadata: str) -> DataFrame:
    """The newest row of every batch."""
    return spark.read.schema(METADATA_SCHEMA).parquet(metadata)


def figure_counts(rows: DataFrame) -> DataFrame:
    """Partial figures of some rows: counts that add up over batches, a few dozen rows at most."""
    label = F.when(is_anomaly(), attack_label(F.col("url"))).otherwise("")
    return rows.groupBy(
        "prediction",
        "display_severity",
        label.alias("label"),
        F.coalesce(is_failed_request(), F.lit(False)).alias("failed"),
        F.coalesce(is_high_alert(), F.lit(False)).alias("high"),
    ).agg(F.count("*").alias("count"))


def read_figures(spark: SparkSession, figures: str) -> DataFrame:
    """The newest partial counts of every batch."""
    return spark.read.schema(FIGURES_SCHEMA).parquet(figures)


def read_kpis(spark: SparkSession, figures: str) -> DataFrame:
    """One row of totals over all batches."""

    def total(condition: Column | None = None) -> Column:
        counted = F.col("count") if condition is None else F.when(condition, F.col("count"))
        return F.coalesce(F.sum(counted), F.lit(0))

    totals = read_figures(spark, figures).agg(
        total().alias("total_logs"),
        total(is_anomaly()).alias("total_anomalies"),
        total(F.col("failed")).alias("failed_requests"),
        total(is_anomaly() & F.col("high")).alias("high_severity_alerts"),
    )
    rate = percent(F.col("total_anomalies"), F.col("total_logs"), 2)
    return totals.withColumn("detection_rate", rate)


def read_counts(spark: SparkSession, figures: str) -> DataFrame:
    """Counts per verdict, display severity and attack label over all batches."""
    by = ["prediction", "display_severity", "label"]
    return read_figures(spark, figures).groupBy(*by).agg(F.sum("count").alias("count"))


def running_kpis(rows: DataFrame) -> DataFrame:
    """One row of totals of a stream of rows; output mode ``complete``.

    The stream must bring every row once. A store whose batches may be written again brings them again:
    use ``ingest_stream(figures=...)`` and ``read_kpis`` for one.
    """
    return rows.agg(
        F.count("*").alias("total_logs"),
        F.count_if(is_anomaly()).alias("total_anomalies"),
        F.count_if(is_failed_request()).alias("failed_requests"),
        F.count_if(is_anomaly() & is_high_alert()).alias("high_severity_alerts"),
    ).withColumn("detection_rate", percent(F.col("total_anomalies"), F.col("total_logs"), 2))


def running_counts(rows: DataFrame) -> DataFrame:
    """Counts per verdict, display severity and attack label; modes ``update`` or ``complete``.

    As with ``running_kpis``, every row must come once; else use ``read_counts``.
    """
    label = F.when(is_anomaly(), attack_label(F.col("url"))).otherwise("")
    return rows.groupBy("prediction", "display_severity", label.alias("label")).agg(
        F.count("*").alias("count")
    )


def pane_alerts(parsed: DataFrame, delay: str = "2 minutes") -> tuple[DataFrame, DataFrame]:
    """``window_alerts`` in output mode ``append``, from panes of one second.

    Rows are counted once per address and second; only these counts, not the rows, go to the 10 and 60 windows
    they lie in. A window is given out once, when the watermark passes its end, and its state and panes
    are dropped.
    """
    timed = with_decoded_url(parsed).withWatermark("event_time", delay)
    failed = is_failed_login(F.col("decoded_url"), F.col("status"))

    def alerts(rows: DataFrame, seconds: int, at_least: int, name: str) -> DataFrame:
        panes = rows.groupBy(F.window("event_time", "1 second").alias("pane"), "ip").agg(
            F.count("*").alias("n")
        )
        span = F.window(F.window_time("pane"), f"{seconds} seconds", "1 second")
        counts = panes.groupBy(span.alias("w"), "ip").agg(F.sum("n").alias("count"))
        return counts.filter(F.col("count") >= at_least).select(
            F.lit(name).alias("alert"), "ip", F.col("w.start").alias("window_start"), "count"
        )

    return (
        alerts(timed, V.FLOOD_SECONDS, V.FLOOD_MORE_THAN + 1, "flood"),
        alerts(
            timed.filter(failed), V.FAILED_LOGIN_SECONDS, V.FAILED_LOGIN_AT_LEAST, "failed logins"
        ),
    )


def window_alerts(
    parsed: DataFrame, slide: str = "1 second", delay: str = "2 minutes"
) -> tuple[DataFrame, DataFrame]:
    """Sliding-window alerts per address: floods (10 s) and failed logins (60 s)."""
    timed = with_decoded_url(parsed).withWatermark("event_time", delay)

    def alerts(rows: DataFrame, seconds: int, at_least: int, name: str) -> DataFrame:
        span = F.window("event_time", f"{seconds} seconds", slide)
        counts = rows.groupBy(span.alias("w"), "ip").agg(F.count("*").alias("count"))
        return counts.filter(F.col("count") >= at_least).select(
            F.lit(name).alias("alert"), "ip", F.col("w.start").alias("window_start"), "count"
        )

    failed = is_failed_login(F.col("decoded_url"), F.col("status"))
    return (
        alerts(timed, V.FLOOD_SECONDS, V.FLOOD_MORE_THAN + 1, "flood"),
        alerts(
            timed.filter(failed), V.FAILED_LOGIN_SECONDS, V.FAILED_LOGIN_AT_LEAST, "failed logins"
        ),
    )


def write_result(
    result: DataFrame, path: str, checkpoint: str, mode: str = "complete", trigger: dict | None = None
) -> StreamingQuery:
    """Keep the newest result of an aggregation as a table.

    ``complete`` replaces the table with each batch; ``append`` and ``update`` add one folder per
    batch.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        folder = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)

    writer = result.writeStream.outputMode(mode).foreachBatch(save)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drain(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query; its error, if any, is raised."""
    query.awaitTermination()
