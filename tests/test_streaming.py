from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import registry
from logwarden.operators.parse import parse_lines
from logwarden.operators.rates import add_trailing_counts
from logwarden.sources.samples import log_lines
from logwarden.sources.text import stream_lines
from logwarden.streaming import live

FILES = 4


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The sample log as text files that arrive one after the other."""
    path = tmp_path_factory.mktemp("live")
    values = [r.value for r in log_lines(spark, sf_dir).orderBy("line_no").collect()]
    step = len(values) // FILES + 1
    for i in range(FILES):
        name = path / f"part-{i}.log"
        name.write_text("\n".join(values[i * step : (i + 1) * step]) + "\n\n  \n")
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    (path / "notes.md").write_text("not a log")
    return path


def batch_rows(spark, sf_dir):
    rows = add_trailing_counts(parse_lines(log_lines(spark, sf_dir)))
    columns = ["timestamp", "ip", "url", "status", "size", "requests_10s", "failed_logins_60s"]
    return columns, sorted(tuple(r) for r in rows.select(*columns).collect())


def source(spark, folder):
    return stream_lines(spark, str(folder), 1, "*.{log,txt,csv}")


def test_counts_reach_into_earlier_batches(spark, sf_dir, folder, tmp_path):
    out, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "checkpoint"))
    query = live.trailing_stream(source(spark, folder), out, state, checkpoint)
    live.drain(query)
    columns, expected = batch_rows(spark, sf_dir)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == FILES
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == expected


def test_ingest_is_repeatable_and_ordered(spark, sf_dir, folder, tmp_path):
    paths = [str(tmp_path / n) for n in ("store", "state", "checkpoint")]
    for _ in range(2):  # the second run finds nothing new
        live.drain(live.ingest_stream(source(spark, folder), *paths, strict=True))
    store = spark.read.parquet(paths[0])
    assert store.count() == parse_lines(log_lines(spark, sf_dir)).count()
    assert store.select("ingest_seq").distinct().count() == store.count()
    later = store.groupBy("batch").agg(F.min("ingest_seq").alias("a"), F.max("ingest_seq").alias("b"))
    spans = [(r.a, r.b) for r in later.orderBy("batch").collect()]
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))


def test_repeated_batch_writes_the_same(spark, folder, tmp_path, lines):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    texts = [
        f'9.9.9.9 - - [21/May/2026:10:00:{s:02d} +0000] "GET /x HTTP/1.1" 200 1' for s in range(20)
    ]
    seen = []

    def use(parsed, earlier, batch_id):
        counted = add_trailing_counts(parsed, earlier)
        seen.append(sorted(r.requests_10s for r in counted.collect()))

    run = live._with_history(state, lambda batch: parse_lines(batch, "apache"), use)
    for batch_id, part in [(0, texts[:8]), (1, texts[8:]), (1, texts[8:])]:
        run(lines(part).select("value"), batch_id)
    assert seen[1] == seen[2]
    assert max(seen[1]) == 11


def test_history_survives_a_line_from_the_future(spark, tmp_path, lines):
    state = str(tmp_path / "state")
    now = int(time.time())

    def texts(ip, start, n):
        stamps = [time.strftime("%d/%b/%Y:%H:%M:%S", time.gmtime(start + i % 5)) for i in range(n)]
        return [f'{ip} - - [{s} +0000] "GET /x HTTP/1.1" 200 1' for s in stamps]

    flagged = []

    def use(parsed, earlier, batch_id):
        counted = add_trailing_counts(parsed, earlier).filter("requests_10s > 30")
        flagged.append(counted.count())

    run = live._with_history(state, lambda batch: parse_lines(batch, "apache"), use)
    future = texts("8.8.8.8", now + 10**9, 1)
    run(lines([*texts("9.9.9.9", now - 5, 30), *future]).select("value"), 0)
    run(lines(texts("9.9.9.9", now, 5)).select("value"), 1)
    assert flagged == [0, 5]
    assert spark.read.parquet(f"{state}/1").filter("ip = '9.9.9.9'").count() > 0


def test_window_alerts(spark, folder, tmp_path):
    floods, logins = live.window_alerts(parse_lines(source(spark, folder), "apache"))
    for i, alerts in enumerate((floods, logins)):
        path = str(tmp_path / str(i))
        live.drain(live.write_result(alerts, path, str(tmp_path / f"c{i}"), "append"))
        frames = spark.read.parquet(f"{path}/batch=*")
        assert frames.filter("count < 5").count() == 0
    assert floods.isStreaming


def test_another_clock_does_not_cut_history(spark, lines, tmp_path):
    """Two batches of one address, 5 s apart, with a far future line of another address in the first."""
    from logwarden.operators.parse import parse_lines
    from logwarden.operators.rates import add_trailing_counts
    from logwarden.streaming import live

    def web(ip, time):
        return f'{ip} - - [{time} +0000] "GET /p HTTP/1.1" 200 5'

    state = str(tmp_path / "state")
    first = [web("10.0.0.1", "21/May/2020:10:00:00")] * 20 + [web("10.0.0.2", "21/Nov/2020:10:00:00")]
    second = [web("10.0.0.1", "21/May/2020:10:00:05")] * 20
    live.save_cells(parse_lines(lines(first), "apache"), live.earlier_cells(spark, state, 0), state, 0)
    earlier = live.earlier_cells(spark, state, 1).drop("_seen")
    counted = add_trailing_counts(parse_lines(lines(second), "apache"), earlier)
    assert max(r.requests_10s for r in counted.collect()) == 40


def test_repeated_batch_is_counted_once(spark, lines, tmp_path):
    paths = [str(tmp_path / name) for name in ("store", "state", "figures")]
    run = live.ingest_batch(*paths)
    text = '9.9.9.9 - - [21/May/2026:10:00:{:02d} +0000] "GET /{} HTTP/1.1" {} 1'
    parts = [[text.format(s, "wp-login.php" if s % 2 else "a", 404) for s in range(n)] for n in (20, 20, 7)]
    for batch_id, part in [(0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2]), (2, parts[2])]:
        run(lines(part).select("value"), batch_id)
    kpis = live.read_kpis(spark, paths[2]).first()
    assert (kpis.total_logs, kpis.failed_requests) == (47, 47)
    assert 0 < kpis.total_anomalies < 47
    assert sum(r["count"] for r in live.read_counts(spark, paths[2]).collect()) == 47


def test_panes_give_each_window_once_and_drop_their_state(spark, folder, tmp_path):
    floods, _ = live.pane_alerts(parse_lines(source(spark, folder), "apache"))
    path = str(tmp_path / "alerts")
    query = live.write_result(floods, path, str(tmp_path / "checkpoint"), "append")
    live.drain(query)
    rows = spark.read.parquet(f"{path}/batch=*")
    assert rows.count() == rows.select("ip", "window_start").distinct().count()
    plan = floods._jdf.queryExecution().logical().toString()
    assert plan.count("Aggregate") == 2


def test_history_outlives_many_fast_batches(spark, lines, tmp_path):
    """An address keeps its history while others send thousands of batches within its reach."""
    from logwarden.operators.rates import add_trailing_counts

    def web(ip, second, n):
        return [f'{ip} - - [21/May/2026:10:00:{second:02d} +0000] "GET /p HTTP/1.1" 200 5'] * n

    state = str(tmp_path / "state")
    live.save_cells(parse_lines(lines(web("10.0.0.1", 0, 20)), "apache"), live.earlier_cells(spark, state, 0), state, 0)
    late = 20_001  # a batch number far beyond; its earlier history is that of an odd or even one
    live.save_cells(parse_lines(lines(web("10.0.0.2", 3, 1)), "apache"), live.earlier_cells(spark, state, 1), state, late - 2 + 1)
    earlier = live.earlier_cells(spark, state, late).drop("_seen")
    counted = add_trailing_counts(parse_lines(lines(web("10.0.0.1", 5, 15)), "apache"), earlier)
    assert max(r.requests_10s for r in counted.collect()) == 35


def test_batch_of_files_counts_in_order_of_paths(spark, tmp_path):
    line = '45.33.1.7 - - [21/May/2026:10:00:00 +0000] "GET /%d HTTP/1.1" 200 10 "-" "-"'
    folder = tmp_path / "in"
    folder.mkdir()
    # The later file is larger, so that Spark takes it first.
    for name, numbers in (("a.log", range(3)), ("b.log", range(3, 20)), ("c.log", range(20, 25))):
        (folder / name).write_text("\n".join(line % i for i in numbers) + "\n")
    out, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "checkpoint"))
    lines = stream_lines(spark, str(folder), 3, blocks=True)
    live.drain(live.trailing_stream(lines, out, state, checkpoint))
    rows = spark.read.parquet(out).select("url", "requests_10s", "batch").collect()
    assert sorted((r.requests_10s, r.url) for r in rows) == [(i + 1, f"/{i}") for i in range(25)]
    assert {r.batch for r in rows} == {0}


def test_many_files_make_no_more_batches(spark, tmp_path, monkeypatch):
    rows = 'event_id bigint, user_id bigint, event_type string, value double'
    events = [(i, i % 50, "click" if i % 3 else "error", float(i)) for i in range(3_000)]
    spark.createDataFrame(events, rows).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(registry, "LINES_PER_FILE", 375)
    monkeypatch.setattr(registry, "MOST_BATCHES", 3)
    files = registry.log_files(spark, str(tmp_path))
    assert len(files) == 8 and registry.files_per_batch(files) == 3
    written = [r.value for path in files for r in spark.read.text(path).orderBy(F.monotonically_increasing_id()).collect()]
    assert written == [r.value for r in log_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    bounds = [round(3_000 * (i / 8) ** 1.5) for i in range(9)]
    sizes = [spark.read.text(path).count() for path in files]
    assert sizes == [b - a for a, b in zip(bounds, bounds[1:])]
    found = registry.ingested_text(spark, str(tmp_path))
    assert sorted(p.name for p in Path(found).glob("batch=*")) == sorted(f"batch={i}" for i in range(3))
    totals = live.read_kpis(spark, found).first()
    assert totals.total_logs == parse_lines(log_lines(spark, str(tmp_path))).count()


def test_log_files_are_written_at_once(spark, tmp_path, monkeypatch):
    rows = 'event_id bigint, user_id bigint, event_type string, value double'
    # No line lies in the third file's range: it is empty, and the others keep their numbers.
    bounds = [round(4_000 * (i / 24) ** 1.5) for i in range(25)]
    numbers = [i for i in range(4_000) if not bounds[2] <= i < bounds[3]]
    events = spark.createDataFrame([(i, i % 50, "click", float(i)) for i in numbers], rows)
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(registry, "LINES_PER_FILE", -(-len(numbers) // 24))
    spark.sparkContext.setJobGroup("log files", "")
    files = registry.log_files(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("", "")
    assert len(files) == 24
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("log files")) < len(files)
    parts = [list(Path(path).glob("part-*")) for path in files]
    times = [max(p.stat().st_mtime for p in part) for part in parts]
    assert times == sorted(set(times)) and max(times) <= time.time()
    written = [sum(len(p.read_text().splitlines()) for p in part) for part in parts]
    assert written == [0 if i == 2 else b - a for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def test_a_batch_writes_few_files_a_date(spark, lines, tmp_path):
    texts = [
        f'10.0.0.1 - - [{day:02d}/May/2026:10:00:{i:02d} +0000] "GET /a HTTP/1.1" 200 5'
        for day in (21, 22, 23) for i in range(40)
    ]
    paths = [str(tmp_path / name) for name in ("store", "state")]
    batch = lines(texts).select("value").repartition(8)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, False)  # rows of each date in many tasks, as in a large batch
    try:
        live.ingest_batch(*paths)(batch, 0)
    finally:
        spark.conf.unset(setting)
    stored = spark.read.parquet(paths[0])
    assert stored.count() == len(texts)
    dates = stored.select("event_date").distinct().count()
    assert len(list(Path(paths[0]).rglob("*.parquet"))) <= 2 * dates
