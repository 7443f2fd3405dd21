"""Sources, sinks and whole jobs."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from logwarden.operators import filters, metrics, paging
from logwarden.operators.fuse import with_native_verdict
from logwarden.plans import pipeline, views
from logwarden.sinks import tables
from logwarden.sources.samples import log_lines, mixed_lines
from logwarden.sources.text import RAW_LOG_SETTING, partition_count, read_lines

LINE = '1.2.3.4 - - [21/May/2026:10:00:{:02d} +0000] "GET /a"b HTTP/1.1" 200 7'


def csv_rows(path):
    found = []
    for name in sorted(path.glob("part-*.csv")):
        with open(name, newline="") as f:
            found.append(list(csv.reader(f)))
    return found


def test_read_lines_cleans(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  one \xff\xfe1\r\n\n \t \ntwo\xc3\xa9\n")
    (tmp_path / "b.bin").write_bytes(b"skip me\n")
    rows = read_lines(spark, str(tmp_path), names="*.{log,txt,csv}").orderBy("line_no").collect()
    assert [r.value for r in rows] == ["one 1", "twoé"]


def test_requested_partitions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(map(str, range(400))))
    lines = read_lines(spark, str(tmp_path / "a.txt"), partitions=4)
    assert partition_count(lines).first().partitions == 4
    assert lines.select("line_no").distinct().count() == 400


@pytest.fixture(scope="module")
def store(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "table")
    pipeline.build_store(log_lines(spark, sf_dir), path)
    return path


def test_store_then_ingest(spark, store, tmp_path):
    before = pipeline.read_store(spark, store).count()
    (tmp_path / "new.log").write_text("\n".join(LINE.format(i).replace('"b', "b") for i in range(5)))
    lines = read_lines(spark, str(tmp_path / "new.log"))
    archive = str(tmp_path / "archive")
    pipeline.ingest(lines, store, archive, full_places=True, batch_number=2)
    assert pipeline.read_store(spark, store).count() == before + 5
    latest = pipeline.latest_store(spark, store, 5).collect()
    assert {r.ip for r in latest} == {"1.2.3.4"}
    assert {r.batch_id for r in latest} == {"RDD-02"}
    assert spark.read.text(archive).count() == 5
    with pytest.raises(ValueError):
        pipeline.ingest(lines, store, archive, batch_number=2)
    tables.append_raw(lines, archive, 2)
    assert spark.read.text(archive).count() == 5


def test_failed_ingest_can_be_repeated(spark, lines, tmp_path, monkeypatch):
    """A failure between archive and store leaves neither doubled nor lost lines."""
    store, archive = str(tmp_path / "store2"), str(tmp_path / "archive2")
    pipeline.build_store(lines([f'10.0.0.{i} - - [21/May/2026:10:00:0{i} +0000] "GET /p HTTP/1.1" 200 5' for i in range(3)]), store)
    more = lines(['10.0.0.9 - - [21/May/2026:11:00:00 +0000] "GET /q HTTP/1.1" 200 5'] * 2)
    with monkeypatch.context() as broken:
        broken.setattr(pipeline, "write_store", lambda *a, **b: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError, match="full"):
            pipeline.ingest(more, store, archive, batch_number=2)
    pipeline.ingest(more, store, archive, batch_number=2)
    assert spark.read.text(archive).count() == 2
    assert spark.read.parquet(store).count() == 5


def test_time_filter_prunes_dates(spark, store):
    plan = pipeline.read_store(spark, store).filter("event_date = '2026-05-21'").select("ip")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "ReadSchema: struct<ip:string>" in text


def test_analysis(spark, sf_dir):
    result = pipeline.analyze(
        mixed_lines(spark, sf_dir), F.col("log_type"), severity="critical", search_url="api"
    )
    row = result.metadata.first()
    assert row.records_processed == 5 * 1000
    assert row.records_filtered == result.records.count() > 0
    assert row.execution_time_sec > 0 and row.processing_speed_lps > 0
    assert (row.partitions, row.batch_id) == (40, "RDD-01")
    counts = result.aggregations["severity_distribution"].first()
    assert counts.critical == row.records_filtered
    assert result.aggregations["anomaly_counts"].first().normal == 0
    assert result.aggregations["top_attackers"].count() <= 5


def test_analysis_of_nothing(lines):
    result = pipeline.analyze(lines([]))
    assert result.metadata.first().records_processed == 0
    assert tuple(result.aggregations["severity_distribution"].first()) == (0, 0, 0, 0)
    assert result.aggregations["top_attackers"].count() == 0
    kpis = metrics.dashboard_kpis(result.records).first()
    assert (kpis.total_logs, kpis.detection_rate, kpis.system_status) == (0, 0.0, "SECURE")


def test_parse_statistics(lines):
    good = [LINE.format(i).replace('"b', "b") for i in range(50)]
    stats = pipeline.parse_statistics(lines([*good, "bad"]))
    assert stats["total_logs"].first().total_logs == 50
    assert [tuple(r) for r in stats["status_distribution"].collect()] == [(200, 50)]
    assert [tuple(r) for r in stats["top_ips"].collect()] == [("1.2.3.4", 50)]


def test_native_verdict_is_opt_in(spark, sf_dir):
    rows = pipeline.enrich(log_lines(spark, sf_dir, "cloudtrail"), "cloudtrail")
    plain = metrics.verdict_counts(rows).first()
    native = metrics.verdict_counts(with_native_verdict(rows)).first()
    assert native.anomaly > plain.anomaly
    assert native.anomaly + native.normal == plain.anomaly + plain.normal


def test_csv_quotes_and_header(spark, tmp_path):
    rows = spark.createDataFrame([('a "q", b', 1, None)], "URL string, n int, e string")
    tables.write_csv(rows, str(tmp_path / "x"))
    assert csv_rows(tmp_path / "x")[-1] == [["URL", "n", "e"], ['a "q", b', "1", ""]]
    tables.write_csv(rows.limit(0), str(tmp_path / "empty"))
    assert csv_rows(tmp_path / "empty") == [[["URL", "n", "e"]]]


def test_exports(spark, store, tmp_path):
    rows = pipeline.read_store(spark, store)
    tables.write_csv(tables.export_rows(rows), str(tmp_path / "csv"))
    files = csv_rows(tmp_path / "csv")
    assert files[0][0][:4] == ["ip", "timestamp", "method", "url"]
    assert len(files[0][0]) == 13
    tables.write_json(rows.select("ip", "scores"), str(tmp_path / "json"))
    line = next((tmp_path / "json").glob("part-*.json")).read_text().splitlines()[0]
    assert json.loads(line)["scores"]["random_forest"]["score"] == 0.05
    assert json.loads(tables.json_rows(rows.select("scores")).first().record)["scores"]


def test_pages(spark, store):
    rows = pipeline.read_store(spark, store)
    newest = [r.ingest_seq for r in paging.newest_first(rows).limit(60).collect()]
    second = [r.ingest_seq for r in paging.page(rows, 2, 20).collect()]
    assert second == newest[20:40]
    after = [r.ingest_seq for r in paging.page_before(rows, newest[19], 20).collect()]
    assert after == second
    with pytest.raises(ValueError):
        paging.page(rows, 1, 501)
    counts = paging.page_counts(rows, F.lit(False), 25).first()
    assert (counts.filtered_count, counts.pages) == (0, 1)


def test_log_page(spark, store):
    rows = pipeline.read_store(spark, store)
    result = views.log_page(rows, 2, 10, severity="critical", search="/")
    counts = result.counts.first()
    critical = rows.filter("severity = 'Critical'").count()
    assert (counts.total, counts.filtered_count) == (rows.count(), critical)
    assert counts.pages == -(-critical // 10)
    assert [r.severity for r in result.rows.collect()] == ["Critical"] * 10
    assert views.threats(rows, 7).count() == 7


def test_threat_map_places_store_rows(spark, store):
    rows = pipeline.read_store(spark, store)
    assert rows.filter("country = 'Unknown'").count() > 0
    placed = views.threat_map(rows, ip="1.2.3.", time_range="7d").collect()
    assert len(placed) == rows.filter("ip = '1.2.3.4'").count() > 0
    country = placed[0].country
    again = views.threat_map(rows, country=country.upper()).collect()
    assert {r.country for r in again} == {country}
    assert views.threat_map(rows).filter("country = 'Unknown'").count() == 0


def test_default_raw_log(spark, tmp_path):
    with pytest.raises(ValueError):
        read_lines(spark)
    (tmp_path / "raw.log").write_text("a\n")
    spark.conf.set(RAW_LOG_SETTING, str(tmp_path / "raw.log"))
    try:
        assert read_lines(spark).count() == 1
    finally:
        spark.conf.unset(RAW_LOG_SETTING)


def test_unparsed_lines_are_no_flood(lines):
    rows = pipeline.enrich(lines([f"junk {i}" for i in range(50)]), mode="fallback")
    assert {r.threat_type for r in rows.collect()} == {"Normal"}
    assert metrics.request_trend(rows).count() == 0
    assert metrics.request_trend(rows, None).first()["count"] == 50


def test_ip_suggestions(spark, store):
    rows = pipeline.read_store(spark, store)
    assert metrics.ip_suggestions(rows, "").count() == 0
    assert metrics.ip_suggestions(rows, ".").count() == 5


def test_unknown_ip(spark, store):
    row = metrics.ip_investigation(pipeline.read_store(spark, store), "45.33.99.7", "now").first()
    assert (row["count"], row.display_severity, row.timestamp) == (0, "Normal", "now")


def test_time_ranges(spark):
    rows = spark.createDataFrame(
        [(1, "2026-05-21 10:00:00"), (2, "2026-05-21 08:59:59"), (3, None)], "i int, t string"
    ).withColumn("event_time", F.to_timestamp("t"))
    as_of = F.lit("2026-05-21 10:00:00").cast("timestamp")

    def kept(condition):
        return [r.i for r in rows.filter(condition).orderBy("i").collect()]

    assert kept(filters.within(filters.batch_seconds("1h"), as_of)) == [1, 3]
    assert kept(filters.within(filters.batch_seconds("6h"), as_of)) == [1, 2, 3]
    assert filters.batch_seconds("all") is None
    assert kept(filters.within(filters.map_seconds("7d"), as_of)) == [1, 2, 3]
    assert filters.map_seconds("whatever") == 365 * 86400


def test_time_range_prunes_the_store(spark, store):
    rows = filters.filter_batch(pipeline.read_store(spark, store), time_range="1h")
    plan = rows.select("ip")._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(event_time),GreaterThanOrEqual(event_time," in plan
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in partition_filters and ">=" in partition_filters
    newest = rows.agg(F.max("event_time")).first()[0]
    assert 0 < rows.count() < pipeline.read_store(spark, store).count()
    oldest = rows.agg(F.min("event_time")).first()[0]
    assert (newest - oldest).total_seconds() <= 3600


def test_line_numbers_follow_files_and_not_partitions(spark, tmp_path):
    """Files of different size, split into small blocks: numbers go file by file at any number of partitions."""
    sizes, texts = [3, 900, 40], []
    for i, n in enumerate(sizes):
        own = [f"file {i} line {k} " + "x" * (k % 50) for k in range(n)]
        (tmp_path / f"day-{i}.log").write_text("\n".join(own) + "\n")
        texts += own
    found = []
    for most in ("128m", "4k", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            rows = read_lines(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found.append(sorted((r.line_no, r.value) for r in rows))
    assert found[0] == found[1] == found[2] == [(i, t.strip()) for i, t in enumerate(texts)]


def test_blank_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n \nfour\n")
    (tmp_path / "b.log").write_text("five\n")
    rows = read_lines(spark, str(tmp_path)).collect()
    assert sorted((r.line_no, r.value) for r in rows) == [(0, "one"), (3, "four"), (4, "five")]


WEB = '10.0.0.{} - - [21/May/2026:10:{:02d}:00 +0000] "GET /p HTTP/1.1" 200 5'


def test_ledger_saves_scans_and_survives_a_lost_entry(spark, lines, tmp_path):
    store, archive = str(tmp_path / "store"), str(tmp_path / "archive")
    pipeline.build_store(lines([WEB.format(1, i) for i in range(3)]), store)
    pipeline.ingest(lines([WEB.format(2, i) for i in range(2)]), store, archive, batch_number=2)
    entries = {r["batch"]: r for r in pipeline._ledger(spark, store).collect()}
    assert {b: (r["rows"], r["next_seq"], r["done"]) for b, r in entries.items()} == {1: (3, 3, True), 2: (2, 5, True)}
    # As after a failure between the rows and their entry: the rows are found and not added again.
    pipeline._enter(spark, store, "", 2, 0, 3, False)
    with pytest.raises(ValueError, match="already"):
        pipeline.ingest(lines([WEB.format(2, i) for i in range(2)]), store, archive, batch_number=2)
    assert pipeline.read_store(spark, store).count() == 5
    # As after a failure before the rows: the batch is begun but nothing of it is there.
    pipeline._enter(spark, store, "", 3, 0, 5, False)
    pipeline.ingest(lines([WEB.format(3, 1)]), store, archive, batch_number=3)
    seqs = sorted(r.ingest_seq for r in pipeline.read_store(spark, store).select("ingest_seq").collect())
    assert seqs == list(range(6))


def test_a_new_build_is_a_new_version(spark, lines, tmp_path):
    store = str(tmp_path / "store")
    pipeline.build_store(lines([WEB.format(1, i) for i in range(3)]), store)
    before = pipeline.read_store(spark, store)
    pipeline.build_store(lines([WEB.format(2, i) for i in range(4)]), store)
    assert before.count() == 3
    assert pipeline.read_store(spark, store).count() == 4
    assert pipeline.current_version(spark, store) != ""


def test_parsed_rows_are_staged_once(spark, sf_dir):
    """Judging in two jobs reads the written rows, never the lines again."""
    from logwarden.operators.parse import parse_lines
    from logwarden.operators.rules import add_rules_in_two_jobs

    judged = add_rules_in_two_jobs(parse_lines(log_lines(spark, sf_dir), "apache"))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan


@pytest.mark.parametrize("bits", [3, 6, 16])
def test_deep_pages_by_index(spark, bits):
    """Every page of numbers with gaps, past the end too, as a plain sort gives it."""
    numbers = [n for n in range(900) if n % 7 and not 200 < n < 420]
    rows = spark.createDataFrame([(n,) for n in numbers], "ingest_seq bigint").repartition(5)
    index = paging.page_index(rows, bits)
    newest = sorted(numbers, reverse=True)
    for number in (1, 2, 9, 17, 29, 30, 40):
        page = paging.page_by_index(rows, index, number, 20, bits)
        assert [r.ingest_seq for r in page.collect()] == newest[(number - 1) * 20 : number * 20]


def test_deep_page_reads_few_ranges(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(400_000).withColumnRenamed("id", "ingest_seq").repartitionByRange(40, "ingest_seq")
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    page = paging.page_by_index(stored, paging.page_index(stored, 10), 5_000, 50, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ingest_seq" in plan and "LessThan(ingest_seq" in plan
    assert [r.ingest_seq for r in page.limit(1).collect()] == [399_999 - 4_999 * 50]


def test_passing_tables_go_and_kept_ones_stay(spark):
    from logwarden.session import passing_tables, stage

    with passing_tables(spark):
        first = stage(spark.range(5), "first")
        result = stage(first.selectExpr("id * 2 AS id"), "result", keep=True)
    assert [r.id for r in result.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|FAILED_READ_FILE"):
        first.collect()
    with pytest.raises(ValueError):
        with passing_tables(spark):
            left = stage(spark.range(3), "left")
            raise ValueError
    assert left.count() == 3
