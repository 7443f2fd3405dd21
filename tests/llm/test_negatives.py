"""Hard negatives by the threshold algorithm against a full scan."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from logwarden.llm import hard_negatives as hn
from logwarden.llm.hard_negatives import Best, Lists, mine_hard_negatives, threshold_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256):
    sound = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if any(abs(float(np.float32(x))) * scale > hn.LARGEST - 1 for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id % 7 == 0 else label
        sound.append((vec_id, moved, [math.floor(scale * float(np.float32(x))) for x in vector]))
    out = []
    for a_id, a_label, a in sound:
        if a_id % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v, strict=False)), r_id, label) for r_id, label, v in sound]
        positives = sorted((s, r) for s, r, label in scored if label == a_label and r != a_id)[:5]
        for p_score, p_id in positives:
            fit = sorted((s, r) for s, r, label in scored if label != a_label and 80 * -p_score <= 100 * -s <= 100 * -p_score)
            out += [(a_id, p_id, rank, r, -p_score, -s) for rank, (s, r) in enumerate(fit[:5], 1)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine_hard_negatives(df.sparkSession, df, label, lambda v: v % 100 == 0)
    return sorted(tuple(r) for r in found.collect())


def test_registered_query_equals_sql(spark, sf_dir):
    from logwarden.llm.oracle import ORACLE
    from logwarden.llm.registry import registered

    for folder in (sf_dir, "/root/testdata/sf0.01"):
        name = "op11_threshold_negatives"
        assert compare(spark, connect(folder), folder, registered()[name], ORACLE[name]) is None


@pytest.mark.parametrize("parts", [1, 6])
def test_small_blocks_groups_and_spans(spark, monkeypatch, parts):
    """Many tiles, ties and repeated vectors; the result does not depend on how rows are dealt."""
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "GROUP", 3)
    monkeypatch.setattr(hn, "SPANS", 4)
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 6) / 8], int(draw.integers(4))) for i in range(0, 1500, 5)]
    rows += [(i, [0.25, 0.0, -0.5, 0.0, 0.0, 0.125], 3) for i in range(2000, 2300, 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = mined(df)
    assert got == brute(rows)
    assert len(got) > 100


def test_awkward_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [0.0, 0.0], 1), (200, [], 2), (300, [-1.0, 0.5, 3.0], 2),
        (1, [1.0], 1), (2, [1.0, 2.0], 3), (2, [1.0, 2.0], 3), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, None, 1),
        (6, [1.0, None], 2), (7, [2.0, 1.0], 0), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [1e30, 0.0], 1),
        (10, [-4.0, -4.0], 1), (11, [0.9, 1.9], 2), (12, [0.99, 1.99], 2), (13, [1.0, 2.0], 1), (-100, [0.5, 0.5, 0.5], 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("anchor", "block", "score", "rank", "vector", "wanted"):
        df = df.withColumn(name, F.lit("z"))
    got = mined(df)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {0, 100}


def test_empty_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []  # no anchors
    assert mined(spark.createDataFrame([(100, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []  # no positives


def test_search_stops_early_and_stays_exact():
    """Few large components: the threshold ends the search long before all rows are scored."""
    draw = np.random.default_rng(0)
    n, width = 2000, 8
    matrix = (draw.pareto(1.5, (n, width)) * 20 * draw.choice([-1, 1], (n, width))).astype(np.int32)
    lists = Lists(np.arange(n), np.zeros(n, np.int64), matrix)
    scored = 0
    for anchor in matrix[:50].astype(np.int64):
        best = Best(np.array([[-hn.NO_LIMIT, hn.NO_LIMIT], [0, 1000]]), 5)
        scored += threshold_search(lists, anchor, None, best)
        scores = matrix.astype(np.int64) @ anchor
        for window, (least, largest) in enumerate(best.windows):
            at = [i for i in np.lexsort((np.arange(n), -scores)) if least <= scores[i] <= largest][:5]
            assert best.of(window)[1].tolist() == at
    one = Best(np.array([[-hn.NO_LIMIT, hn.NO_LIMIT]]), 5)
    assert threshold_search(lists, matrix[0].astype(np.int64), None, one) < n / 2
    assert scored <= 50 * n


def test_ties_at_the_threshold_take_the_smaller_id():
    """An unmet row may tie with the k-th score, so the search ends only strictly below it."""
    matrix = np.zeros((400, 2), np.int32)
    matrix[:, 0] = 5
    ids = np.arange(400)[::-1].copy()
    best = Best(np.array([[-hn.NO_LIMIT, hn.NO_LIMIT]]), 3)
    threshold_search(Lists(ids, np.zeros(400, np.int64), matrix), np.array([2, 0]), None, best)
    assert best.of(0)[1].tolist() == [0, 1, 2]
