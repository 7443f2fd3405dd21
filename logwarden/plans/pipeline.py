"""Whole jobs: lines to enriched rows, analysis of a batch, and the store."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, metrics
from ..operators.fuse import add_verdict
from ..operators.geo import add_place, add_profile_place
from ..operators.models import Models, add_scores, chosen
from ..operators.paging import keep_latest, newest_part
from ..operators.parse import add_rebuilt_line, parse_lines, tag_batch
from ..operators.rules import add_rules, add_rules_in_two_jobs
from ..session import observed, stage
from ..sinks.tables import append_raw, write_store
from ..sources.text import read_lines
from .training import retrain

STORE_ROWS = 10_000

STORE_COLUMNS = [
    "ingest_seq", "timestamp", "event_time", "ip", "method", "url", "protocol", "status", "size",
    "log_type", "is_fallback", "native_threat", "requests_10s", "failed_logins_60s", "prediction",
    "severity", "display_severity", "threat_type", "details", "anomaly_score", "scores", "country",
    "city", "latitude", "longitude", "isp", "batch_id",
]


def judge(
    parsed: DataFrame,
    models: Models | None = None,
    classifier: str = "isolation_forest",
    profile_places: bool = False,
    keep_protocol: bool = False,
    earlier_cells: DataFrame | None = None,
    in_two_jobs: bool = False,
) -> DataFrame:
    """Parsed rows to enriched rows: rules, model scores, merged verdict, place.

    ``in_two_jobs`` checks the rate limits in a job of its own, for large tables.
    """
    ruled = add_rules_in_two_jobs(parsed) if in_two_jobs else add_rules(parsed, earlier_cells)
    scored = add_scores(models, add_rebuilt_line(ruled, keep_protocol), "line").drop("line")
    if models is None:
        judged = add_verdict(scored)
    else:
        judged = add_verdict(scored, *chosen(classifier))
    if profile_places:
        return add_profile_place(judged).withColumn("isp", F.lit(None).cast("string"))
    return add_place(judged)


def enrich(
    lines: DataFrame,
    log_type: str | Column = "apache",
    models: Models | None = None,
    classifier: str = "isolation_forest",
    mode: str = "drop",
    batch_number: int = 1,
    fallback_time: Column | None = None,
    in_two_jobs: bool = False,
) -> DataFrame:
    """``line_no, value`` to the enriched table of one batch."""
    parsed = parse_lines(lines, log_type, mode=mode, fallback_time=fallback_time)
    judged = judge(parsed, models, classifier, in_two_jobs=in_two_jobs)
    return tag_batch(judged.withColumn("ingest_seq", F.col("line_no")), batch_number)


@dataclass
class Analysis:
    """Results of one batch; all of them are lazy reads of the staged enriched table."""

    records: DataFrame
    metadata: DataFrame
    aggregations: dict[str, DataFrame]


def analyze(
    lines: DataFrame,
    log_type: str | Column = "apache",
    models: Models | None = None,
    classifier: str = "isolation_forest",
    mode: str = "fallback",
    batch_number: int = 1,
    **conditions,
) -> Analysis:
    """Enrich once, write once, then filter and aggregate from columns.

    ``conditions`` are the arguments of ``filters.filter_batch``.
    """
    enriched = enrich(
        lines, log_type, models, classifier, mode, batch_number, in_two_jobs=True
    )
    seen = Observation("batch")
    start = time.perf_counter()
    rows = stage(
        enriched.select(*STORE_COLUMNS).observe(seen, F.count("*").alias("rows")), "analysis"
    )
    seconds = time.perf_counter() - start
    n = observed(seen, rows=0)["rows"]
    records = filters.filter_batch(rows, **conditions)
    metadata = records.agg(F.count("*").alias("records_filtered")).select(
        F.lit(n).cast("bigint").alias("records_processed"),
        "records_filtered",
        F.lit(round(seconds, 3)).alias("execution_time_sec"),
        F.lit(int(n / seconds)).cast("bigint").alias("processing_speed_lps"),
        F.lit(lines.rdd.getNumPartitions()).alias("partitions"),
        F.lit(f"RDD-0{batch_number}").alias("batch_id"),
    )
    return Analysis(
        records=records,
        metadata=metadata,
        # One scan of the records for all six; each figure then reads a table of counts.
        aggregations=metrics.figures_of(stage(metrics.batch_figures(records), "figures")),
    )


def parse_statistics(lines: DataFrame) -> dict[str, DataFrame]:
    """Lenient parse of web log lines, with its basic counts."""
    parsed = stage(parse_lines(lines, "apache", strict=False), "parsed")
    return {
        "data": parsed,
        "total_logs": metrics.line_count(parsed),
        "status_distribution": metrics.status_breakdown(parsed),
        "top_ips": metrics.top_ips(parsed),
    }


# --- the store ---------------------------------------------------------------------------------
# The first version lies in the store's folder, later ones in folders whose names Spark's readers of the
# first one pass over. The ledger has a row for each batch of a version, so that no ingest scans the store.
LEDGER_SCHEMA = "version string, batch int, rows bigint, next_seq bigint, done boolean"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row for each batch of every version; none for a folder without a store."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path.rstrip('/')}/_ledger")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LEDGER_SCHEMA)
        raise


def _enter(spark: SparkSession, path: str, version: str, batch: int, rows: int, next_seq: int, done: bool) -> None:
    """Write a batch's ledger row, replacing what it had."""
    row = spark.createDataFrame([(version, batch, rows, next_seq, done)], LEDGER_SCHEMA).coalesce(1)
    row.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_ledger/entry={version or 'first'}-{batch}")


def current_version(spark: SparkSession, path: str) -> str:
    """Name of the version that readers see; empty for the first one."""
    try:
        return spark.read.schema("version string").parquet(f"{path.rstrip('/')}/_current").first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return ""
        raise


def _folder(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/_{version}" if version else path


def _write_batch(rows: DataFrame, path: str, version: str, batch: int, mode: str, gather_dates: bool) -> int:
    """Write a batch and enter it in the ledger; the next free number."""
    spark, seen = rows.sparkSession, Observation(f"batch {batch}")
    counted = rows.observe(seen, F.count("*").alias("rows"), F.max("ingest_seq").alias("newest"))
    write_store(counted, _folder(path, version), mode, gather_dates=gather_dates)
    got = observed(seen, rows=0, newest=None)
    next_seq = 0 if got["newest"] is None else got["newest"] + 1
    _enter(spark, path, version, batch, got["rows"], next_seq, True)
    return next_seq


def build_store(lines: DataFrame, path: str, models: Models | None = None) -> None:
    """Write the store anew from the whole raw log, as a new version if there is one already."""
    _build(lines.sparkSession, [(1, lines)], path, models)


def _build(spark: SparkSession, batches: list[tuple[int, DataFrame]], path: str, models: Models | None) -> None:
    """Judge all batches into a new version, then let readers see it."""
    version = "" if _ledger(spark, path).isEmpty() else f"v{uuid.uuid4().hex[:12]}"
    start = 0
    for place, (batch, lines) in enumerate(batches):
        rows = _store_rows(lines, start, models, True, batch)
        start = max(start, _write_batch(rows, path, version, batch, "overwrite" if place == 0 else "append", True))
    pointer = spark.createDataFrame([(version,)], "version string").coalesce(1)
    pointer.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_current")


def ingest(
    lines: DataFrame,
    path: str,
    archive: str,
    models: Models | None = None,
    full_places: bool = False,
    batch_number: int = 2,
) -> None:
    """Add lines to the store after its newest row, and to the raw archive.

    A batch number can be used once; a second use raises instead of adding the rows again. The archive is
    written first: a repeat after a failure writes the same archive folder again, then the store. Only the
    ledger is read; the store itself is only after a failure that left a batch begun, to see whether its rows came.
    """
    spark = lines.sparkSession
    version = current_version(spark, path)
    entries = {r["batch"]: r for r in _ledger(spark, path).filter(F.col("version") == version).collect()}
    own = entries.get(batch_number)
    if own is not None and not own["done"]:
        there = spark.read.parquet(_folder(path, version)).filter(F.col("batch_id") == f"RDD-0{batch_number}")
        found = there.agg(F.count("*").alias("rows"), F.max("ingest_seq").alias("newest")).first()
        if found["rows"]:
            _enter(spark, path, version, batch_number, found["rows"], found["newest"] + 1, True)
            own = found
        else:
            own = None
    if own is not None:
        raise ValueError(f"batch {batch_number} is already in the store")
    start = max((r["next_seq"] for r in entries.values()), default=0)
    append_raw(lines, archive, batch_number)
    _enter(spark, path, version, batch_number, 0, start, False)
    rows = _store_rows(lines, start, models, not full_places, batch_number)
    _write_batch(rows, path, version, batch_number, "append", False)


def _store_rows(
    lines: DataFrame, start: int, models: Models | None, profile_places: bool, batch_number: int
) -> DataFrame:
    parsed = parse_lines(lines, "apache", strict=False)
    judged = judge(
        parsed, models, profile_places=profile_places, keep_protocol=True, in_two_jobs=True
    )
    numbered = judged.withColumn("ingest_seq", F.col("line_no") + start)
    return tag_batch(numbered, batch_number).select(*STORE_COLUMNS)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version."""
    return spark.read.parquet(_folder(path, current_version(spark, path)))


def latest_store(spark: SparkSession, path: str, n: int = STORE_ROWS) -> DataFrame:
    """The newest rows, as many as the live views keep."""
    return keep_latest(newest_part(read_store(spark, path), n), n)


def retrain_store(lines: DataFrame, models_path: str, path: str, archive: str | None = None) -> Models:
    """Fit on the whole raw log, then judge it again with the new models, as a new version of the store.

    The whole raw log is ``lines`` and every batch that was ingested since, which ``archive`` holds; without
    it a store that has such batches raises, since they would be lost. Readers see the old version to the end.
    """
    spark = lines.sparkSession
    added = sorted(
        r["batch"]
        for r in _ledger(spark, path).filter(F.col("version") == current_version(spark, path)).collect()
        if r["done"] and r["batch"] != 1
    )
    if added and archive is None:
        raise ValueError(f"batches {added} were ingested: name the archive that holds their lines")
    batches = [(1, lines), *[(n, read_lines(spark, f"{archive.rstrip('/')}/batch={n}")) for n in added]]
    whole, start = lines, 0
    for before, (_, own) in zip(batches, batches[1:]):
        newest = before[1].agg(F.max("line_no")).first()[0]
        start += 0 if newest is None else newest + 1
        whole = whole.unionByName(own.withColumn("line_no", F.col("line_no") + start))
    models = retrain(whole, models_path)
    _build(spark, batches, path, models)
    return models


def score_lines(
    lines: DataFrame, models: Models | None, classifier: str = "isolation_forest"
) -> DataFrame:
    """Verdicts of raw web log lines, with all classifiers; unparsed lines are flagged, not lost."""
    texts = lines.withColumn("log_line", F.col("value"))
    ruled = add_rules(parse_lines(texts, "apache", strict=False, mode="keep"))
    flags, score = chosen(classifier)
    judged = add_verdict(
        add_scores(models, ruled, "log_line"), flags, score, f"ML Anomaly ({classifier})"
    )
    is_parsed = F.col("log_type").isNotNull()
    results = {
        "prediction": "prediction",
        "anomaly_score": "anomaly_score",
        "threat_severity": "severity",
        "threat_type": "threat_type",
        "details": "details",
        "all_predictions": "scores",
    }
    return judged.select(
        "line_no",
        "log_line",
        is_parsed.alias("is_parsed"),
        *[F.when(is_parsed, F.col(c)).alias(name) for name, c in results.items()],
    )
