"""Every registered query: ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.text import (
    attack_label,
    http_label,
    score_percent,
    shorten,
)
from logwarden.functions.threats import is_sensitive_path, signature_name
from logwarden.functions.times import clock_label, epoch_seconds, event_time
from logwarden.operators import filters, geo, metrics, paging, sets
from logwarden.operators.features import count_terms
from logwarden.operators.fuse import add_verdict
from logwarden.operators.models import (
    Models,
    TrainingSet,
    add_scores,
    fit_classifier,
    training_set,
)
from logwarden.operators.parse import add_rebuilt_line, parse_lines, tag_batch
from logwarden.operators.rates import add_trailing_counts, counts_over_limit
from logwarden.operators.rules import (
    add_rules,
    add_rules_in_two_jobs,
    flat_rule,
    with_decoded_url,
)
from logwarden.plans import pipeline, views
from logwarden.plans.pipeline import enrich, score_lines
from logwarden.plans.training import label_lines, retrain
from logwarden.plans.views import LOG_COLUMNS as LOG_ROW
from logwarden.plans.views import MAP_COLUMNS as GEO_ROW
from logwarden.plans.views import threat_map
from logwarden.schemas import CLASSIFIERS, RAW_LINE
from logwarden.session import prepare, scratch_folder
from logwarden.sinks import tables
from logwarden.sources import samples
from logwarden.sources.text import clean_lines, read_lines, stream_lines, use_all_cores, with_blocks
from logwarden.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

#: Deal line numbers out over a large range: multiplied modulo a prime, so that they stay different.
SPREAD, SPREAD_PRIME = 1_000_003, 1_073_741_827

FORMAT_ROW = ["line_no", "log_type", "timestamp", "ip", "method", "url", "status"]


def second() -> F.Column:
    return epoch_seconds(F.col("event_time")).alias("second")


def parsed(spark: SparkSession, sf: str, log_type: str = "apache", strict: bool = True) -> DataFrame:
    return parse_lines(samples.log_lines(spark, sf, log_type), log_type, strict=strict)


def mixed(spark: SparkSession, sf: str, mode: str = "drop") -> DataFrame:
    lines = samples.mixed_lines(spark, sf)
    return parse_lines(lines, F.col("log_type"), mode=mode, fallback_time=F.lit(""))


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    return add_rules(parsed(spark, sf))


def store(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched table: rules, verdicts and places, without a model."""
    judged = add_verdict(ruled(spark, sf)).withColumn("ingest_seq", F.col("line_no"))
    return tag_batch(geo.add_place(judged), 1)


def on_store(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(store(spark, sf))


def last_second(spark: SparkSession, sf: str) -> F.Column:
    return F.lit(filters.latest_event_time(parsed(spark, sf)))


# --- parsing -----------------------------------------------------------------------------------
def parse_apache(strict: bool) -> Query:
    columns = ["line_no", "ip", "timestamp", "method", "url", "protocol", "status", "size"]
    return lambda spark, sf: parsed(spark, sf, strict=strict).select(*columns, second())


def parse_format(log_type: str) -> Query:
    return lambda spark, sf: parsed(spark, sf, log_type).select(*FORMAT_ROW, second())


def parse_fallback(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["line_no", "log_type", "ip", "method", "url", "status", "is_fallback"]
    # -1 marks a format without sizes.
    size = F.coalesce("size", F.lit(-1)).alias("size")
    return mixed(spark, sf, "fallback").select(*columns, size)


def native_threats(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(spark, sf).select("line_no", "log_type", "native_threat.*")


def url_decode_twice(spark: SparkSession, sf: str) -> DataFrame:
    logs = parsed(spark, sf).select(F.col("line_no").alias("id"), F.lit("log").alias("kind"), "url")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url"
    )
    return with_decoded_url(logs.unionByName(pages))


def parse_event_time(spark: SparkSession, sf: str) -> DataFrame:
    times = samples.requests(spark, sf).select(
        F.col("event_id").alias("line_no"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(form).alias("form"), text.alias("text"))
                    for form, text in {
                        "apache": F.date_format("time", "dd/MMM/yyyy:HH:mm:ss' +0000'"),
                        "blank": F.date_format("time", "yyyy-MM-dd HH:mm:ss"),
                        "iso": F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                        "fraction": F.concat(
                            F.date_format("time", "yyyy-MM-dd HH:mm:ss."),
                            F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
                        ),
                        "junk": F.concat(F.lit("malformed entry "), F.col("event_id")),
                    }.items()
                ]
            )
        ),
    )
    millis = F.unix_millis(event_time(F.col("text")))
    return times.select("line_no", "form", F.coalesce(millis, F.lit(-1)).alias("millis"))


def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return store(spark, sf).select(
        "line_no",
        attack_label(url).alias("label"),
        shorten(url).alias("short_url"),
        http_label(F.col("status")).alias("code"),
        filters.is_failed_request().alias("is_error"),
        score_percent(F.col("anomaly_score")).alias("confidence"),
        clock_label(F.col("event_time")).alias("clock"),
    )


# --- rules -------------------------------------------------------------------------------------
def trailing(column: str) -> Query:
    return lambda spark, sf: add_trailing_counts(parsed(spark, sf)).select("line_no", "ip", column)


def trailing_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Both rates of lines whose numbers do not run with time, so that nearly every row is a cell of its own."""
    rows = parsed(spark, sf).withColumn("line_no", F.col("line_no") * SPREAD % SPREAD_PRIME)
    return add_trailing_counts(rows).select("line_no", "ip", "requests_10s", "failed_logins_60s")


def signature_match(spark: SparkSession, sf: str) -> DataFrame:
    logs = with_decoded_url(parsed(spark, sf)).select(
        F.col("line_no").alias("id"), F.lit("log").alias("kind"), F.col("decoded_url").alias("text")
    )
    documents = use_all_cores(spark.read.parquet(f"{sf}/documents.parquet")).select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text"
    )
    texts = logs.unionByName(documents)
    return texts.select("id", "kind", signature_name(F.col("text")).alias("signature"))


def sensitive_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_decoded_url(parsed(spark, sf))
    return rows.select("line_no", "url", is_sensitive_path(F.col("decoded_url")).alias("sensitive"))


def rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = flat_rule(ruled(spark, sf))
    return rows.groupBy("threat_type", "severity").agg(F.count("*").alias("count"))


# --- places ------------------------------------------------------------------------------------
def geo_profile_join(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["line_no", "ip", "country", "city", "latitude", "longitude"]
    return geo.add_profile_place(parsed(spark, sf)).select(*columns)


def geo_hash_fallback(spark: SparkSession, sf: str) -> DataFrame:
    host = F.concat_ws(".", "user_id", F.col("event_id") % 251, "event_type")
    hosts = spark.read.parquet(f"{sf}/events.parquet").select(host.alias("ip")).distinct()
    return geo.add_place(hosts)


def geo_threats(spark: SparkSession, sf: str) -> DataFrame:
    return threat_map(
        store(spark, sf),
        url="API",
        severity="critical",
        time_range="24h",
        as_of=last_second(spark, sf),
    )


# --- fusion ------------------------------------------------------------------------------------
def fuse_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The merge itself, with a model verdict computed from the line's size."""
    flags = F.col("size") % 7 == 0
    points = (F.col("size") % 10007) / F.lit(10007.0)
    return add_verdict(ruled(spark, sf), flags, points).select(
        "line_no", "prediction", "severity", "display_severity", "threat_type", "details",
        "anomaly_score",
    )


# --- aggregates, filters, pages ----------------------------------------------------------------
def request_trend(spark: SparkSession, sf: str) -> DataFrame:
    trend = metrics.request_trend(store(spark, sf), "hour")
    return trend.select(F.date_format("time", "yyyy-MM-dd HH:mm").alias("time"), "count")


def batch_filter(rows: DataFrame) -> DataFrame:
    kept = filters.filter_batch(
        rows, search_ip="45.33", search_url="API", status_code=500, threat_type="injection"
    )
    return kept.select(*LOG_ROW)


def time_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.filter_batch(store(spark, sf), time_range="6h", as_of=last_second(spark, sf))
    return rows.select(*LOG_ROW)


def add_missing_ip(rows: DataFrame) -> DataFrame:
    def counts(part: DataFrame) -> DataFrame:
        return part.groupBy("ip").agg(F.count("*").alias("count"))

    hot = rows.filter(F.col("threat_type") == "DDoS Attempt / Flooding")
    return sets.add_missing(counts(hot), counts(rows))


def merge_new_old(spark: SparkSession, sf: str) -> DataFrame:
    scale = len(samples.LOG_TYPES)

    def rows(name: str) -> DataFrame:
        offset = samples.LOG_TYPES.index(name)
        shifted = (F.col("line_no") * scale + offset).alias("line_no")
        return parsed(spark, sf, name).select(shifted, *FORMAT_ROW[1:])

    return sets.merge(rows("apache"), rows("kubernetes"))


def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return paging.top_by_count(
        count_terms(samples.log_lines(spark, sf)), "term", 1000, "term_count"
    )


SQL_QUERIES: dict[str, Query] = {
    "parse_apache_strict": parse_apache(True),
    "parse_apache_lenient": parse_apache(False),
    "parse_hdfs": parse_format("hdfs"),
    "parse_kubernetes": parse_format("kubernetes"),
    "parse_cloudtrail": parse_format("cloudtrail"),
    "parse_android": parse_format("android"),
    "parse_fallback": parse_fallback,
    "native_threats": native_threats,
    "rebuild_line": lambda spark, sf: add_rebuilt_line(mixed(spark, sf)).select("line_no", "line"),
    "url_decode_twice": url_decode_twice,
    "parse_event_time": parse_event_time,
    "display_labels": display_labels,
    "flood_trailing": trailing("requests_10s"),
    "brute_force_trailing": trailing("failed_logins_60s"),
    "flood_trailing_spread": trailing_spread,
    "signature_match": signature_match,
    "sensitive_path": sensitive_path,
    "rule_verdicts": lambda spark, sf: flat_rule(ruled(spark, sf), "line_no"),
    "rule_verdicts_in_two_jobs": lambda spark, sf: flat_rule(
        add_rules_in_two_jobs(parsed(spark, sf)), "line_no"
    ),
    "rates_over_limit": lambda spark, sf: counts_over_limit(parsed(spark, sf)),
    "rule_summary": rule_summary,
    "weak_labels": lambda spark, sf: label_lines(samples.log_lines(spark, sf)).select(
        "line_no", "label"
    ),
    "geo_profile_join": geo_profile_join,
    "geo_hash_fallback": geo_hash_fallback,
    "geo_threats": geo_threats,
    "top_countries": on_store(metrics.top_countries),
    "ip_investigation": on_store(lambda rows: metrics.ip_investigation(rows, "185.220.101.5")),
    "attack_vectors": on_store(lambda rows: geo.attack_vectors(metrics.ip_clusters(rows))),
    "ip_clusters": on_store(metrics.ip_clusters),
    "fuse_rules": on_store(
        lambda rows: rows.select(
            "line_no", "prediction", "severity", "display_severity", "threat_type", "details",
            "anomaly_score",
        )
    ),
    "fuse_verdicts": fuse_verdicts,
    "verdict_counts": on_store(metrics.verdict_counts),
    "verdict_split": on_store(metrics.verdict_split),
    "severity_distribution": on_store(metrics.severity_distribution),
    "severity_counts": on_store(metrics.severity_counts),
    "top_attackers": on_store(metrics.top_attackers),
    "status_breakdown": on_store(metrics.status_breakdown),
    "status_labels": on_store(metrics.status_labels),
    "top_endpoints": on_store(metrics.top_endpoints),
    "top_ips": lambda spark, sf: metrics.top_ips(parsed(spark, sf)),
    "request_trend": request_trend,
    "request_trend_text": on_store(lambda rows: metrics.request_trend(rows, None)),
    "line_count": lambda spark, sf: metrics.line_count(parsed(spark, sf)),
    "batch_metadata": on_store(
        lambda rows: metrics.batch_metadata(rows, F.col("status") == 404, "RDD-01")
    ),
    "dashboard_kpis": on_store(metrics.dashboard_kpis),
    "anomaly_summary": on_store(metrics.anomaly_summary),
    "anomaly_rate": on_store(metrics.anomaly_rate),
    "threat_map_kpis": on_store(metrics.threat_map_kpis),
    "audit_report": on_store(metrics.audit_report),
    "audit_report_all": on_store(lambda rows: metrics.audit_report(rows, None)),
    "attack_label_counts": on_store(metrics.attack_label_counts),
    "threat_timeline": on_store(metrics.threat_timeline),
    "top_threat_countries": on_store(metrics.top_threat_countries),
    "actor_profiles": on_store(metrics.actor_profiles),
    "latest_threat_countries": on_store(metrics.latest_threat_countries),
    "country_list": on_store(metrics.country_list),
    "ip_suggest": on_store(lambda rows: metrics.ip_suggestions(rows, "45.")),
    "log_search": on_store(
        lambda rows: filters.filter_logs(rows, search="LOGIN", prediction="anomaly").select(*LOG_ROW)
    ),
    "batch_filter": on_store(batch_filter),
    "time_range_filter": time_range_filter,
    "log_page": on_store(lambda rows: paging.page(rows, 3, 50).select(*LOG_ROW)),
    "log_page_before": on_store(lambda rows: paging.page_before(rows, 500, 50).select(*LOG_ROW)),
    "page_counts": on_store(lambda rows: paging.page_counts(rows, F.col("status") == 404, 25)),
    "latest_threats": on_store(lambda rows: paging.latest_threats(rows, 100).select(*LOG_ROW)),
    "keep_latest": on_store(lambda rows: paging.keep_latest(rows, 10_000).select(*LOG_ROW)),
    "last_n_series": on_store(metrics.last_n_series),
    "export_rows": on_store(tables.export_rows),
    "export_page": on_store(tables.page_rows),
    "export_map": on_store(tables.map_rows),
    "add_missing_ip": on_store(add_missing_ip),
    "merge_new_old": merge_new_old,
    "tfidf_terms": tfidf_terms,
}


# --- files and whole jobs ------------------------------------------------------------------------
LINES_PER_FILE = 200_000
LEAST_FILES = 4
MOST_BATCHES = 16  # of streams whose results do not name batches: each batch has its fixed cost


def log_files(spark: SparkSession, sf: str) -> list[str]:
    """The web log as text files of growing size, oldest lines first; one folder each.

    The lines are read once, dealt to their files, and all files are written at once. A stream takes files in order
    of their times, so these are then set a second apart.
    """
    lines = samples.log_lines(spark, sf)
    n, last = lines.agg(F.count("*"), F.max("line_no")).first()
    files = max(LEAST_FILES, -(-n // LINES_PER_FILE))
    bounds = [round((last + 1) * (i / files) ** 1.5) for i in range(files + 1)]
    folder, dealt = scratch_folder(spark, "log-files"), scratch_folder(spark, "log-parts")
    parts = with_file(lines, bounds).repartition("file").sortWithinPartitions("file", "line_no")
    parts.select("file", "value").write.partitionBy("file").text(dealt)
    paths = [f"{folder}/{i:06d}" for i in range(files)]
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop.Path(folder))
    oldest = (int(time.time()) - files) * 1000
    for i, path in enumerate(paths):
        if not store.exists(hadoop.Path(f"{dealt}/file={i}")):
            spark.createDataFrame([], RAW_LINE).coalesce(1).write.text(path)
        elif not store.rename(hadoop.Path(f"{dealt}/file={i}"), hadoop.Path(path)):
            raise OSError(f"cannot rename to {path}")
        for file in store.globStatus(hadoop.Path(f"{path}/part-*")):
            store.setTimes(file.getPath(), oldest + i * 1000, -1)
    return paths


def with_file(lines: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``file``: the last whose bound is not after ``line_no``; lines beyond both ends are left out."""
    inside = lines.filter((F.col("line_no") >= bounds[0]) & (F.col("line_no") < bounds[-1]))
    begins = sorted(set(bounds))
    splits = [-float("inf"), *map(float, begins), float("inf")]
    number = F.col("line_no").cast("double").alias("_number")
    found = Bucketizer(splits=splits, inputCol="_number", outputCol="_bucket").transform(inside.select("*", number))
    last_of = {bound: i for i, bound in enumerate(bounds)}
    files = F.array(*[F.lit(last_of[begin]) for begin in begins])
    return found.withColumn("file", F.get(files, F.col("_bucket").cast("int") - 1)).drop("_number", "_bucket")


def scan_text_files(spark: SparkSession, sf: str) -> DataFrame:
    return read_lines(spark, log_files(spark, sf))


def latest_rows_files(spark: SparkSession, sf: str) -> DataFrame:
    """The newest rows over all files, in order of files and lines."""
    rows = parse_lines(read_lines(spark, log_files(spark, sf)), "apache")
    newest = paging.keep_latest(rows.withColumn("ingest_seq", F.col("line_no")), 100)
    return newest.select("line_no", "ip", "timestamp", "url", "status")


def log_page_view(rows: DataFrame) -> DataFrame:
    """A page deep in the filtered log, found by the count index."""
    return views.log_page(rows, 21, 7, search="API").rows


def stream_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each batch of a live ingest of text files, and whether its other figures are there."""
    files = log_files(spark, sf)
    folder = scratch_folder(spark, "ingest-metadata")
    lines = stream_lines(spark, f"{files[0].rsplit('/', 1)[0]}/*")
    live.drain(
        live.ingest_stream(
            lines, f"{folder}/store", f"{folder}/state", f"{folder}/checkpoint", strict=True,
            metadata=f"{folder}/metadata",
        )
    )
    measured = (F.col("execution_time_sec") > 0) & (F.col("partitions") > 0) & (F.col("processing_speed_lps") >= 0)
    return live.read_metadata(spark, f"{folder}/metadata").select(
        "batch_id", "records_processed", measured.alias("measured")
    )


def analysis(spark: SparkSession, sf: str, **conditions) -> pipeline.Analysis:
    return pipeline.analyze(samples.log_lines(spark, sf), "apache", mode="drop", **conditions)


def analyze_records(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf, search_url="api").records.select(*GEO_ROW)


def analyze_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The six aggregations of a whole job as ``figure, key, count``."""
    found = analysis(spark, sf).aggregations
    parts = []
    for name, figure in found.items():
        if "count" in figure.columns:
            key = next(c for c in figure.columns if c != "count")
            text = F.date_format(key, "yyyy-MM-dd HH:mm") if key == "time" else F.col(key).cast("string")
            parts.append(figure.select(F.lit(name).alias("figure"), text.alias("key"), "count"))
        else:
            pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("count")) for c in figure.columns]))
            parts.append(figure.select(F.lit(name).alias("figure"), pairs))
    return reduce(DataFrame.unionByName, parts)


def analyze_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read and rows that pass, without the measured seconds."""
    found = analysis(spark, sf, status_code=404).metadata
    return found.select("records_processed", "records_filtered", "batch_id")


def stored(spark: SparkSession, sf: str, again: bool) -> DataFrame:
    """Store from the older half of the blocks, the others ingested; ``again`` builds it anew before."""
    lines = samples.log_lines(spark, sf)
    # Blocks of a thousand lines lie ten minutes apart: no rate reaches over their ends.
    middle = lines.agg(F.floor(F.max("line_no") / 2000) * 1000).first()[0]
    folder = scratch_folder(spark, "store")
    old = lines.filter(F.col("line_no") < middle)
    pipeline.build_store(old, f"{folder}/store")
    if again:
        pipeline.build_store(old, f"{folder}/store")
    new = lines.filter(F.col("line_no") >= middle)
    pipeline.ingest(new, f"{folder}/store", f"{folder}/archive", full_places=True)
    columns = ["timestamp", "ip", "method", "url", "status", "size", "prediction", "severity", "threat_type", "anomaly_score"]
    return pipeline.read_store(spark, f"{folder}/store").select(*columns)


def read_back(kind: str) -> Query:
    """Export the store, then read the files with the exported schema."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = tables.export_rows(store(spark, sf))
        path = scratch_folder(spark, f"export-{kind}")
        if kind == "csv":
            tables.write_csv(rows, path)
            return spark.read.schema(rows.schema).options(header=True, escape='"').csv(path)
        tables.write_json(rows, path)
        return spark.read.schema(rows.schema).json(path)

    return run


def append_raw_back(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches in the raw archive, one of them written twice; how often each line is there."""
    lines = samples.log_lines(spark, sf)
    folder = scratch_folder(spark, "archive")
    for batch in (1, 2, 2):
        tables.append_raw(lines.filter(F.col("line_no") % 2 == batch - 1), folder, batch)
    archived = spark.read.text(folder)
    return archived.groupBy("value").agg(F.count("*").alias("count"))


def parse_statistics(spark: SparkSession, sf: str) -> DataFrame:
    found = pipeline.parse_statistics(samples.log_lines(spark, sf))
    total = found["total_logs"].select(F.lit("total").alias("figure"), F.lit("").alias("key"), F.col("total_logs").alias("count"))
    parts = [
        found[name].select(F.lit(name).alias("figure"), F.col(key).cast("string").alias("key"), "count")
        for name, key in (("status_distribution", "status"), ("top_ips", "ip"))
    ]
    return reduce(DataFrame.unionByName, parts, total)


SQL_QUERIES |= {
    "log_page_view": on_store(log_page_view),
    "scan_text_files": scan_text_files,
    "latest_rows_files": latest_rows_files,
    "analyze_records": analyze_records,
    "analyze_figures": analyze_figures,
    "analyze_metadata": analyze_metadata,
    "ingest_store": lambda spark, sf: stored(spark, sf, False),
    "rebuild_store": lambda spark, sf: stored(spark, sf, True),
    "export_csv_back": read_back("csv"),
    "export_json_back": read_back("json"),
    "append_raw_back": append_raw_back,
    "parse_statistics": parse_statistics,
}


# --- streams, drained ----------------------------------------------------------------------------
def ingested(spark: SparkSession, sf: str) -> str:
    """Run the live ingest over the event files; the store's path."""
    folder = scratch_folder(spark, "ingest")
    query = live.ingest_stream(
        samples.stream_log_lines(spark, sf),
        f"{folder}/store",
        f"{folder}/state",
        f"{folder}/checkpoint",
        profile_places=False,
        strict=True,
    )
    live.drain(query)
    return f"{folder}/store"


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    columns = [c for c in GEO_ROW if c != "ingest_seq"]
    return spark.read.parquet(ingested(spark, sf)).select(*columns)


def running(figure: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        result = figure(live.stream_store(spark, ingested(spark, sf)))
        folder = scratch_folder(spark, "figures")
        live.drain(live.write_result(result, f"{folder}/table", f"{folder}/checkpoint"))
        return spark.read.parquet(f"{folder}/table")

    return run


def files_per_batch(files: list[str]) -> int:
    """Batches get larger where there are many files, not more."""
    return -(-len(files) // MOST_BATCHES)


def stream_files(spark: SparkSession, files: list[str], blocks: bool = True) -> DataFrame:
    return stream_lines(spark, f"{files[0].rsplit('/', 1)[0]}/*", files_per_batch(files), blocks=blocks)


def ingested_text(spark: SparkSession, sf: str) -> str:
    """Live ingest of text files, a batch for some of them each, the last batch written twice; the figures' path."""
    files = log_files(spark, sf)
    folder = scratch_folder(spark, "ingest-text")
    paths = [f"{folder}/store", f"{folder}/state"]
    figures = f"{folder}/figures"
    lines = stream_files(spark, files)
    live.drain(
        live.ingest_stream(
            lines, *paths, f"{folder}/checkpoint", profile_places=False, strict=True, figures=figures
        )
    )
    again = live.ingest_batch(*paths, figures, profile_places=False, strict=True)
    last = (len(files) - 1) // files_per_batch(files)
    again(clean_lines(with_blocks(spark.read.text(files[last * files_per_batch(files) :]))), last)
    return figures


def stream_flood_text(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing counts over text files, a batch for some of them each: how many rows have which counts."""
    files = log_files(spark, sf)
    folder = scratch_folder(spark, "trailing-text")
    lines = stream_files(spark, files)
    live.drain(live.trailing_stream(lines, f"{folder}/rows", f"{folder}/state", f"{folder}/checkpoint"))
    by = ["ip", "timestamp", "requests_10s", "failed_logins_60s"]
    return spark.read.parquet(f"{folder}/rows").groupBy(*by).agg(F.count("*").alias("count"))


def stream_windows_text(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts given out once by the watermark: windows that end two minutes before the newest row or earlier."""
    files = log_files(spark, sf)
    folder = scratch_folder(spark, "panes")
    parsed_lines = parse_lines(stream_files(spark, files, blocks=False))
    parts = []
    for alerts in live.pane_alerts(parsed_lines):
        path = f"{folder}/{len(parts)}"
        live.drain(live.write_result(alerts, path, f"{path}-checkpoint", "append"))
        parts.append(spark.read.parquet(f"{path}/batch=*"))
    return sets.merge(*parts).withColumn("window_start", epoch_seconds(F.col("window_start")))


def stream_flood(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark, "trailing")
    query = live.trailing_stream(
        samples.stream_log_lines(spark, sf),
        f"{folder}/rows",
        f"{folder}/state",
        f"{folder}/checkpoint",
    )
    live.drain(query)
    columns = ["line_no", "ip", "requests_10s", "failed_logins_60s"]
    return spark.read.parquet(f"{folder}/rows").select(*columns)


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark, "windows")
    parts = []
    for alerts in live.window_alerts(parse_lines(samples.stream_log_lines(spark, sf))):
        path = f"{folder}/{len(parts)}"
        live.drain(live.write_result(alerts, path, f"{path}-checkpoint"))
        parts.append(spark.read.parquet(path))
    alerts = sets.merge(*parts)
    return alerts.withColumn("window_start", epoch_seconds(F.col("window_start")))


# --- models ------------------------------------------------------------------------------------
_TRAINING: dict[tuple, TrainingSet] = {}
_FITTED: dict[tuple, object] = {}


def models(spark: SparkSession, sf: str, names: list[str]) -> Models:
    """Classifiers fitted on the whole log of ``sf``, each fitted once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINING:
        lines = samples.log_lines(spark, sf)
        _TRAINING[key] = training_set(lines, label_lines(lines))
    training = _TRAINING[key]
    for name in names:
        if (*key, name) not in _FITTED:
            _FITTED[(*key, name)] = fit_classifier(training, name)
    return Models(training.features, {name: _FITTED[(*key, name)] for name in names})


def score_one(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scored = add_scores(
            models(spark, sf, [name]), samples.log_lines(spark, sf), names=[name]
        )
        return scored.select("line_no", f"scores.{name}.*")

    return run


def score_all(spark: SparkSession, sf: str) -> DataFrame:
    scored = add_scores(models(spark, sf, CLASSIFIERS), samples.log_lines(spark, sf))
    return scored.select(
        "line_no",
        *[F.col(f"scores.{n}.{f}").alias(f"{n}_{f}") for n in CLASSIFIERS for f in ("prediction", "score")],
    )


def score_lines_query(spark: SparkSession, sf: str) -> DataFrame:
    fitted = models(spark, sf, CLASSIFIERS)
    scored = score_lines(samples.log_lines(spark, sf), fitted, "random_forest")
    return scored.drop("all_predictions")


def fuse_full(spark: SparkSession, sf: str) -> DataFrame:
    fitted = models(spark, sf, CLASSIFIERS)
    rows = enrich(samples.log_lines(spark, sf), models=fitted, mode="fallback")
    return rows.select(*GEO_ROW, "details", "batch_id")


def retrain_query(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the whole log, store, load, and count the verdicts of the re-scored log."""
    lines = samples.log_lines(spark, sf)
    fitted = retrain(lines, scratch_folder(spark, "models"))
    return metrics.verdict_counts(enrich(lines, models=fitted))


STREAM_QUERIES: dict[str, Query] = {
    "stream_ingest": stream_ingest,
    "stream_kpis": running(live.running_kpis),
    "stream_counts": running(live.running_counts),
    "stream_kpis_text": lambda spark, sf: live.read_kpis(spark, ingested_text(spark, sf)),
    "stream_counts_text": lambda spark, sf: live.read_counts(spark, ingested_text(spark, sf)),
    "stream_flood": stream_flood,
    "stream_flood_text": stream_flood_text,
    "stream_windows": stream_windows,
    "stream_windows_text": stream_windows_text,
    "stream_metadata": stream_metadata,
}

MODEL_QUERIES: dict[str, Query] = {
    **{f"score_{name}": score_one(name) for name in CLASSIFIERS},
    "score_all": score_all,
    "score_lines": score_lines_query,
    "fuse_full": fuse_full,
    "retrain": retrain_query,
}


def registered() -> dict[str, Query]:
    def in_utc(query: Query) -> Query:
        return lambda spark, sf: query(prepare(spark), sf)

    every = SQL_QUERIES | STREAM_QUERIES | MODEL_QUERIES
    return {name: in_utc(query) for name, query in every.items()}
