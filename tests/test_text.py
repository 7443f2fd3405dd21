from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote as py_unquote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logwarden.functions import fixed_values as V
from logwarden.functions.text import clean_line, unquote
from logwarden.functions.threats import is_sensitive_path, signature_name
from logwarden.operators.geo import add_place

URLS = [
    "/x%zz%2", "/50%", "/a+b%20c", "/%252e%252e%252f", "/p%C3%A9", "/plain", "",
    "/api/users?id=1%20UNION%20SELECT%2520username", "/a' or '1'='1", "/ping;cat /x",
    "/ping; whoami", "/q?s=<script>alert(1)</script>", "/static/../../etc/passwd", "/WP-Login.PHP",
    "/a?x=union select", "/a?x=SELECT a\rb FROM t", "/a?x=SELECT a\nb FROM t", "/a|| LS ",
    "/a?onLOAD=1", "/.git/config", "/phpMyAdmin/", "/or%201%20=%201", "/unıon select",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")


def python_signature(url):
    for name, pattern in V.ATTACK_SIGNATURES:
        if re.search(pattern, url, re.IGNORECASE):
            return name
    return None


def test_unquote_like_python(spark):
    rows = frame(spark, URLS).select(unquote(unquote(F.col("t"))).alias("u")).collect()
    assert [r.u for r in rows] == [py_unquote(py_unquote(u)) for u in URLS]


def test_signatures_like_python(spark):
    rows = frame(spark, URLS).select(signature_name(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [python_signature(u) for u in URLS]


def test_sensitive_paths_like_python(spark):
    rows = frame(spark, URLS).select(is_sensitive_path(F.col("t")).alias("s")).collect()
    expected = [any(re.search(p, u, re.IGNORECASE) for p in V.SENSITIVE_PATHS) for u in URLS]
    assert [r.s for r in rows] == expected


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.text(alphabet="aZ%2ef5cC3A9+ ;'\"=/.|&\t UNIOSELCTRFMls", max_size=40),
        min_size=1,
        max_size=60,
    )
)
def test_random_urls_like_python(spark, urls):
    decoded = unquote(unquote(F.col("t")))
    rows = frame(spark, urls).select(decoded.alias("u"), signature_name(decoded).alias("s")).collect()
    expected = [py_unquote(py_unquote(u)) for u in urls]
    assert [r.u for r in rows] == expected
    assert [r.s for r in rows] == [python_signature(u) for u in expected]


def test_clean_line_like_strip(spark):
    texts = ["  a b \t", "\x1c x　\r", "", " ", "é�"]
    rows = frame(spark, texts).select(clean_line(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [t.strip() for t in texts]


def test_places_like_python(spark):
    ips = [f"{a}.{b}.0.{a * b % 251}" for a in range(1, 60) for b in range(20)]
    ips += ["82.102.23.45", "2001:db8::1", "ü"]
    rows = add_place(spark.createDataFrame([(ip,) for ip in ips], "ip string")).collect()
    assert len(rows) == len(ips)
    profiles = {p[0]: p for p in V.GEO_PROFILES}
    for row in rows:
        if row.ip in profiles:
            _, country, city, lat, lon, bad = profiles[row.ip]
            isp = V.ISP_MALICIOUS if bad else V.ISP_OTHER
        else:
            h = int(hashlib.md5(row.ip.encode()).hexdigest(), 16)
            country, city, lat, lon, isp = V.GEO_POOL[h % 13]
            lat = round(lat + ((h % 200) - 100) * 0.005, 4)
            lon = round(lon + (((h >> 4) % 200) - 100) * 0.005, 4)
        assert (row.country, row.city, row.isp) == (country, city, isp)
        assert (row.latitude, row.longitude) == (lat, lon)
