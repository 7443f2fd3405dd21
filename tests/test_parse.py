from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from logwarden.functions import fixed_values as V
from logwarden.functions.formats import line_formats
from logwarden.operators.parse import add_rebuilt_line, parse_lines

FULL = '1.2.3.4 - bob [21/May/2026:10:00:01 +0200] "GET /a?b=c HTTP/1.0" 404 - "-" "x"'


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_strict_fields(lines):
    row = one(parse_lines(lines([FULL])))
    assert (row.ip, row.method, row.url, row.protocol) == ("1.2.3.4", "GET", "/a?b=c", "HTTP/1.0")
    assert (row.status, row.size) == (404, 0)
    assert row.event_time == dt.datetime(2026, 5, 21, 8, 0, 1)


@pytest.mark.parametrize(
    "line",
    [
        '1.2.3.4 - - [21/May/2026:10:00:01] "GET / HTTP/1.1" 200 1',
        '1.2.3.4 - - [21/May/2026:10:00:01 +0000] "GET" 200 1',
        '1.2.3.4 - - [21/May/2026:10:00:01 +0000] "GET / HTTP/1.1" 20 1',
        '1.2.3.4 - - [21/May/2026:10:00:01 +0000] "GET / HTTP/1.1" 200 x',
        "malformed entry 7",
    ],
)
def test_strict_rejects(lines, line):
    assert parse_lines(lines([line])).count() == 0


def test_large_size_survives(lines):
    line = '1.2.3.4 - - [21/May/2026:10:00:01 +0000] "GET / HTTP/1.1" 200 99999999999'
    assert one(parse_lines(lines([line]))).size == 99_999_999_999


def test_lenient_defaults(lines):
    row = one(parse_lines(lines(['1.2.3.4 - - [whenever] "GET" 200 -']), strict=False))
    assert (row.method, row.url, row.protocol, row.size) == ("GET", "/", "HTTP/1.1", 0)
    assert row.event_time is None


def test_hdfs_with_and_without_extra_token(lines):
    texts = [
        "2026-05-21 21:00:01 192.168.1.50 INFO dfs.FSNamesystem: Allowed access to /user/a",
        "2026-05-21 21:00:01 192.168.1.50 audit WARN dfs.X: access denied",
        "2026-05-21 21:00:01 192.168.1.50 ERROR dfs.X: disk failure",
    ]
    rows = parse_lines(lines(texts), "hdfs").orderBy("line_no").collect()
    assert [(r.url, r.status, r.native_threat.severity) for r in rows] == [
        ("/user/a", 200, "Normal"),
        ("/hdfs/root", 403, "High Threat"),
        ("/hdfs/root", 500, "Normal"),
    ]


def test_kubernetes(lines):
    texts = [
        "2026-05-21T21:05:00Z WARN pod-auth 10.244.0.12 User service-admin failed login",
        "2026-05-21T21:05:00Z ERROR pod-auth 10.244.0.12 exploit",
        "2026-05-21T21:05:00Z WARN pod-auth 10.244.0.12 slow",
    ]
    rows = parse_lines(lines(texts), "Kubernetes").orderBy("line_no").collect()
    assert [(r.url, r.status, r.native_threat.severity) for r in rows] == [
        ("/pods/pod-auth", 401, "High Threat"),
        ("/pods/pod-auth", 401, "Critical"),
        ("/pods/pod-auth", 400, "Normal"),
    ]


def test_cloudtrail_needs_five_parts(lines):
    texts = [
        "2026-05-21T21:10:00Z 198.51.100.41 DescribeInstances AccessDenied ec2.amazonaws.com",
        "2026-05-21T21:10:00Z 198.51.100.41 DescribeInstances AccessDenied",
    ]
    row = one(parse_lines(lines(texts), "cloudtrail"))
    assert (row.method, row.url, row.status) == ("DescribeInstances", "ec2.amazonaws.com", 403)


def test_android_year(lines):
    text = "05-21 21:12:00.123 D LogcatService( 1200) IP 122.164.48.9 Exploit attempted"
    row = one(parse_lines(lines([text]), "android", year=2025))
    assert row.timestamp == "2025-05-21 21:12:00.123"
    assert (row.method, row.url, row.status) == ("ANDROID_D", "/app/LogcatService", 200)
    assert row.native_threat.prediction == "Anomaly"


def test_fallback_record(lines):
    frame = lines(["x 82.102 y/z", "plain"])
    rows = (
        parse_lines(frame, "CLOUDTRAIL", mode="fallback", fallback_time=F.lit("now"))
        .orderBy("line_no")
        .collect()
    )
    assert [(r.log_type, r.ip, r.url, r.status, r.size) for r in rows] == [
        ("Cloudtrail", "82.102.23.45", "/api/system", 200, 12),
        ("Cloudtrail", "127.0.0.1", "/index.html", 200, 5),
    ]
    assert all(r.is_fallback for r in rows)


def test_unknown_format(lines):
    rows = parse_lines(lines(["a b"]), "nginx", mode="fallback").collect()
    assert rows[0].log_type == "Nginx"
    with pytest.raises(ValueError):
        parse_lines(lines(["a"]), "nginx")


def test_rebuilt_line(lines):
    rebuilt = add_rebuilt_line(parse_lines(lines([FULL])), keep_protocol=True)
    expected = '1.2.3.4 - - [21/May/2026:10:00:01 +0200] "GET /a?b=c HTTP/1.0" 404 0 "-" "-"'
    assert one(rebuilt).line == expected


SAMPLES = {
    ("apache", True): (V.APACHE_STRICT, FULL),
    ("apache", False): (V.APACHE_LENIENT, FULL),
    ("hdfs", True): (V.HDFS_LINE, "2026-05-21 21:00:01 1.2.3.4 audit WARN dfs.X: denied to /a b"),
    ("kubernetes", True): (V.KUBERNETES_LINE, "2026-05-21T21:05:00Z WARN pod-a 10.0.0.1 it is slow"),
    ("android", True): (V.ANDROID_LINE, "05-21 21:12:00.123 D Tag( 12) IP 1.2.3.4 Exploit now"),
}


@pytest.mark.parametrize("name, strict", list(SAMPLES))
def test_damaged_lines_match_like_python(lines, name, strict):
    pattern, sample = SAMPLES[(name, strict)]
    rng = random.Random(7)
    texts = [sample]
    for _ in range(400):
        text = list(sample)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(text))
            piece = rng.choice([" ", "", '"', "-", "[", "]", "(", "\t", "\x1c", "\u00a0", "é", "9"])
            text[at : at + rng.randrange(2)] = [piece]
        texts.append("".join(text))
    form = line_formats(strict)[name]
    pieces = form.pieces(F.col("value"))
    rows = lines(texts).select(
        "line_no", F.when(form.matched(pieces), pieces).alias("groups")
    )
    for row in rows.collect():
        match = re.match(pattern, texts[row.line_no])
        expected = [g or "" for g in match.groups()] if match else None
        assert row.groups == expected, texts[row.line_no]


def test_line_meets_regex_once(lines):
    """A filter on a parsed column must not bring the regex into a second operator."""
    plan = parse_lines(lines([FULL])).filter("status = 404")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("regexp_replace") == 1


def test_value_with_newlines_is_no_line(spark):
    value = "a\nb\nc\nd\ne\n200\n7"
    rows = spark.createDataFrame([(1, value)], "line_no bigint, value string")
    for strict in (True, False):
        assert parse_lines(rows, "apache", strict=strict).count() == 0
