"""Every registered query against its SQL, on the sample tables."""

from __future__ import annotations

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.registry import registered

QUERIES = registered()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLE[name]) is None


def test_entry_counts(spark):
    from __spark_entry__ import entry

    counts = {(r["threat_type"], r["severity"]): r["count"] for r in entry(spark).collect()}
    assert counts[("Normal", "Low")] == 269
    assert counts[("Brute Force Attack", "Critical")] == 244
    assert counts[("DDoS Attempt / Flooding", "High")] == 75
    assert counts[("Web Scanner / Reconnaissance", "Medium")] == 49
    assert counts[("Web Scanner / Reconnaissance", "High")] == 38
    assert sum(counts.values()) == 989
