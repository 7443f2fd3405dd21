from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from logwarden.operators import rates
from logwarden.operators.rates import add_trailing_counts, counts_over_limit
from logwarden.operators.rules import add_rules, add_url_rules

SCHEMA = "line_no bigint, ip string, second bigint, url string, status int"


def rows_frame(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumn("event_time", F.timestamp_seconds("second"))


def sequential(rows):
    """One pass in time order, with a queue per address."""
    requests, failures, out = defaultdict(deque), defaultdict(deque), {}
    for line_no, ip, second, url, status in sorted(rows, key=lambda r: (r[2], r[0])):
        requests[ip].append(second)
        if ("login" in url or "auth" in url) and status in (401, 403):
            failures[ip].append(second)
        while requests[ip][0] < second - 10:
            requests[ip].popleft()
        while failures[ip] and failures[ip][0] < second - 60:
            failures[ip].popleft()
        out[line_no] = (len(requests[ip]), len(failures[ip]))
    return out


def counted(frame):
    return {
        r.line_no: (r.requests_10s, r.failed_logins_60s)
        for r in add_trailing_counts(frame).collect()
    }


@pytest.mark.parametrize("cell_bits", [2, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_sequential_pass(spark, monkeypatch, cell_bits, seed):
    """One address holds most rows, many in one second, across span borders and small cells."""
    monkeypatch.setattr(rates, "CELL_BITS", cell_bits)
    rng = random.Random(seed)
    rows = []
    for line_no in rng.sample(range(100_000), 3_000):
        ip = "hot" if rng.random() < 0.6 else f"ip{rng.randrange(5)}"
        second = rng.choice([3590 + rng.randrange(80), 7195 + rng.randrange(10), 7200])
        url = rng.choice(["/login", "/API/Auth", "/x"]).lower()
        rows.append((line_no, ip, second, url, rng.choice([200, 401, 403])))
    expected = sequential(rows)
    assert counted(rows_frame(spark, rows)) == expected
    over = {
        r.line_no: (r.requests_10s, r.failed_logins_60s)
        for r in counts_over_limit(rows_frame(spark, rows)).collect()
    }
    assert over == {n: c for n, c in expected.items() if c[0] > 30 or c[1] >= 5}


def test_window_ends_are_inclusive(spark):
    rows = [(0, "a", 0, "/login", 401), (1, "a", 10, "/x", 200), (2, "a", 11, "/x", 200)]
    rows += [(3, "a", 60, "/x", 200), (4, "a", 61, "/x", 200)]
    got = counted(rows_frame(spark, rows))
    assert got == {0: (1, 1), 1: (2, 1), 2: (2, 1), 3: (1, 1), 4: (2, 0)}


def verdicts(spark, rows):
    return {r.line_no: r.rule for r in add_rules(rows_frame(spark, rows)).collect()}


def test_flood_starts_with_the_31st_request(spark):
    rule = verdicts(spark, [(i, "a", 5, "/x", 200) for i in range(32)])
    assert not rule[29].is_threat
    assert rule[30].threat_type == "DDoS Attempt / Flooding"
    assert rule[30].details == "IP requested 31 resources in 10 seconds."
    assert rule[31].score == 0.85


def test_brute_force_starts_with_the_5th_failure_and_hits_other_urls(spark):
    rows = [(i, "a", 10 * i, "/login", 401) for i in range(5)] + [(5, "a", 45, "/x", 200)]
    rule = verdicts(spark, rows)
    assert not rule[3].is_threat
    assert rule[4].threat_type == rule[5].threat_type == "Brute Force Attack"
    assert rule[5].details == "Detected 5 failed login attempts in under 60 seconds."


def test_rows_without_time_are_kept(spark):
    frame = rows_frame(spark, [(1, "a", None, "/.env", 404), (2, "a", 3, "/x", 200)])
    rule = {r.line_no: r.rule for r in add_rules(frame).collect()}
    assert rule[1].threat_type == "Web Scanner / Reconnaissance"
    assert rule[2].threat_type == "Normal"


URL_CASES = [
    ("/api/users?id=1%20UNION%20SELECT%2520username", 500, "SQL Injection", "Critical", True),
    ("/wp-login.php", 404, "Web Scanner / Reconnaissance", "Medium", True),
    ("/admin", 200, "Web Scanner / Reconnaissance", "High", True),
    ("/secret/keys", 200, "Unauthorized Privilege Access", "High", True),
    ("/secret/keys", 403, "Normal", "Low", False),
    ("/missing", 404, "Normal (404 Not Found)", "Low", False),
    ("/x", 500, "Server Application Error", "Medium", True),
    ("/ping?host=1; whoami", 200, "Normal", "Low", False),
    ("/ping?host=1;cat%20/x", 200, "Command Injection", "Critical", True),
    ("/q?%3Cscript%3E", 200, "Cross-Site Scripting (XSS)", "Critical", True),
    ("/a/..%2f..%2fb", 400, "Directory Traversal / LFI", "Critical", True),
    ("/index.html", 200, "Normal", "Low", False),
]


def test_url_rules(spark):
    frame = spark.createDataFrame(
        [(i, c[0], c[1]) for i, c in enumerate(URL_CASES)], "i int, url string, status int"
    )
    rules = [r.rule for r in add_url_rules(frame).orderBy("i").collect()]
    got = [(r.threat_type, r.severity, r.is_threat) for r in rules]
    assert got == [c[2:] for c in URL_CASES]


def test_no_shuffle_by_address_alone(spark, sf_dir):
    """The plan may not hash rows by address only: one hot address would be one task."""
    rows = rows_frame(spark, [(1, "a", 1, "/x", 200)])
    for counts in (add_trailing_counts(rows), counts_over_limit(rows)):
        plan = counts._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
        assert exchanges
        for line in exchanges:
            keys = line.split("hashpartitioning(")[1].split(")")[0]
            assert "_span" in keys or "_block" in keys, line


def test_no_group_of_the_sums_holds_an_address(spark):
    """One address, line numbers spread over a large range: windows run over seconds and over blocks of one second."""
    from logwarden.operators.rates import trailing_before_cell

    rows = [("9.9.9.9", 60 + i // 40, (i * 7919) % 2000, i, 1, i % 2) for i in range(2000)]
    cells = spark.createDataFrame(rows, "ip string, _second bigint, _block bigint, _cell bigint, _requests bigint, _failures bigint")
    got = {r["_cell"]: (r["_requests_before"], r["_failures_before"]) for r in trailing_before_cell(cells).collect()}
    for _, second, block, cell, _, _ in rows[::37]:
        earlier = [r for r in rows if (r[1], r[2]) < (second, block)]
        want = (sum(r[1] >= second - 10 for r in earlier), sum(r[5] for r in earlier if r[1] >= second - 60))
        assert got[cell] == want
    assert len(got) == 2000


def test_seconds_are_never_broadcast(spark):
    """Their size is guessed from the input's files, so a broadcast would grow with the log in every task."""
    rows = rows_frame(spark, [(1, "a", 1, "/x", 200)])
    for columns in (["line_no", "failed_logins_60s"], ["line_no", "url"]):
        plan = add_trailing_counts(rows).select(*columns)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_only_cells_of_seconds_over_a_limit_are_ranked(spark):
    from logwarden.operators.rates import trailing_before_cell

    hot = [("a", 600 + i // 2, i % 2, i, 8, 0) for i in range(8)]
    cold = [("b", 600 + 20 * i, 0, 100 + i, 8, 0) for i in range(8)] + [(None, 600, 0, 200, 31, 0)]
    schema = "ip string, _second bigint, _block bigint, _cell bigint, _requests bigint, _failures bigint"
    cells = spark.createDataFrame(hot + cold, schema)
    whole = {r["_cell"]: r for r in trailing_before_cell(cells).collect()}
    found = {r["_cell"]: r for r in trailing_before_cell(cells, over_limit=True).collect()}
    assert set(found) == {2, 3, 4, 5, 6, 7, 200}
    assert found == {cell: whole[cell] for cell in found}
