"""Near duplicates, fingerprints and nearest vectors against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import fingerprints, jaccard, neighbours, registry
from logwarden.llm.common import table, words
from logwarden.llm.corpus import components, squeeze, unsqueeze

from .conftest import AWKWARD


def brute_groups(rows, size, percent):
    sets = []
    for _, text in rows:
        own = words(text or "")
        sets.append({tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[root(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def near_copies(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        own = base[:]
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    return rows + [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(40)]


def found_groups(spark, docs, size, percent):
    got = jaccard.jaccard_groups(spark, docs, size, percent).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 16), (5, 80, 256)])
def test_groups(spark, texts, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(150, 3) + AWKWARD[2:]
    assert found_groups(spark, texts(rows), size, percent) == brute_groups(rows, size, percent)


def test_group_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, registry.jaccard_join(spark, sf_dir).collect()), key=str)
    assert got == brute_groups(rows, 4, 85)


def test_one_of_each(spark, texts):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (7, ""), (7, ""), (8, None), (9, "z z z z z z")]
    kept = jaccard.one_of_each(spark, texts(rows))
    assert sorted(((r.doc_id, r.text, r.label) for r in kept.collect()), key=str) == sorted(
        [(1, "a b c d e f", "x"), (7, "", "x"), (7, "", "x"), (8, None, "x"), (9, "z z z z z z", "x"), (None, "q r s t u v", "x")], key=str
    )
    assert jaccard.one_of_each(spark, texts(rows).limit(0)).count() == 0
    assert jaccard.jaccard_groups(spark, texts(rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_squeezed_numbers():
    for values in (np.arange(1000, dtype=np.uint32), np.empty(0, np.int64), np.linspace(0, 1, 7)):
        assert (unsqueeze(squeeze(values)) == values).all()


def test_fingerprints(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fingerprints, "ID_BLOCK", 64)
    rows = sorted(map(tuple, table(spark, sf_dir, "documents").select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in registry.syncmer_fingerprints(spark, sf_dir).collect()}
    by_text = {}
    for i, (doc_id, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = got[doc_id]
        assert own.n_chars == len(text)
        assert own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= own.near_next <= 1
        assert by_text.setdefault(text, own.fingerprint) == own.fingerprint
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98


def test_fingerprint_cases(spark, texts):
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited_fingerprints(texts(AWKWARD)).collect()}
    assert len(got) == len({(i, len(t or "")) for i, t in AWKWARD})
    assert got[None, 0].fingerprint == "" and got[1, 0].fingerprint == ""
    assert got[1 << 40, 23].near_edited <= 1
    assert fingerprints.edited_fingerprints(texts(AWKWARD).limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(texts([(5, "only one text of some words")])).first()
    assert one.near_next == 1.0


def test_syncmers_depend_on_their_words_alone(spark):
    passage = " ".join(f"w{i * i % 97}" for i in range(60))
    rows = [(1, passage), (2, "some other words before " + passage), (3, passage + " and after it")]
    marked = fingerprints.with_anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "a")
    sets = {r.doc_id: set(r.a) for r in marked.collect()}
    assert sets[1] <= sets[2] and sets[1] <= sets[3]


def test_short_texts_are_compared_alike(spark):
    """Texts on both sides of the least number of anchors share words, so their likeness is not 0."""
    words = [f"v{i * 7 % 31}" for i in range(24)]
    docs = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(1, 25)], "doc_id long, text string")
    marked = {r.doc_id: len(r.a) for r in fingerprints.with_anchors(docs, "text", "a").collect()}
    assert min(marked.values()) < fingerprints.LEAST <= max(marked.values())
    got = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(docs).collect()}
    sides = [n for n in range(2, 25) if (marked[n] < fingerprints.LEAST) != (marked[n - 1] < fingerprints.LEAST)]
    assert sides and all(got[n] == pytest.approx((n - 1) / n) for n in sides)
    assert min(got[n] for n in range(2, 25)) > 0


def test_long_texts_share_a_short_passage(spark):
    """A passage in two long texts leaves common anchors, however many anchors the texts have."""
    passage = " ".join(f"p{i}" for i in range(60))
    long = lambda mark: " ".join(f"{mark}{i}" for i in range(4000))
    rows = [(2, f"{long('a')} {passage} {long('b')}"), (1, f"{long('c')} {passage} {long('d')}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(docs).collect()}
    own = fingerprints.anchor_positions(docs)
    places = {doc_id: [r.anchor for r in own.where(f"doc_id = {doc_id}").orderBy("place").collect()] for doc_id in (1, 2)}
    shared = set(places[1]) & set(places[2])
    assert len(places[1]) > 2000 and 10 < len(shared) < 56
    assert [a for a in places[1] if a in shared] == [a for a in places[2] if a in shared]
    expected = len(shared) / (len(places[1]) + len(places[2]) - len(shared))
    assert near[1] == near[2] == pytest.approx(expected)
    # Every anchor is in the fingerprint, eight digits each.
    sizes = {r.doc_id: len(r.fingerprint) for r in fingerprints.edited_fingerprints(docs).collect()}
    assert sizes == {doc_id: 8 * len(places[doc_id]) for doc_id in (1, 2)}


def parts_of(fingerprint):
    """Anchors and words (None if not held) of a fingerprint as text."""
    anchors, colon, words = fingerprint.partition(":")
    cut = lambda text: {text[i : i + 8] for i in range(0, len(text), 8)}
    return cut(anchors), cut(words) if colon or not fingerprint else None


def likeness_of(a, b):
    (x, v), (y, w) = parts_of(a), parts_of(b)
    if min(len(x), len(y)) < fingerprints.LEAST and v is not None and w is not None:
        x, y = v, w
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_follows_from_the_returned_fingerprints(spark, sf_dir):
    rows = sorted(registry.syncmer_fingerprints(spark, sf_dir).collect(), key=lambda r: -r.doc_id)
    assert any(":" in r.fingerprint for r in rows) and any(":" not in r.fingerprint for r in rows)
    for row, following in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert row.near_edited == pytest.approx(likeness_of(row.fingerprint, row.edited_fingerprint))
        assert row.near_next == pytest.approx(likeness_of(row.fingerprint, following.fingerprint))


def test_anchors_are_the_closed_syncmers_of_the_words(spark):
    """Word hashes and pair hashes by Spark, the rest in plain Python."""
    words = [f"v{i * i % 61}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words).upper())], "doc_id long, text string")
    h = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()
    h = [r.h for r in h]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    pairs = [r.p for r in frame([(i, *h[i : i + 2]) for i in range(79)], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b").alias("p")).collect()]
    closed = [i for i in range(75) if min(pairs[i], pairs[i + 4]) <= min(pairs[i + 1 : i + 4])]
    want = frame([(i, pairs[i], pairs[i + 2], pairs[i + 4]) for i in closed], "i int, a long, b long, c long").orderBy("i")
    want = list(dict.fromkeys(r.p for r in want.select(F.xxhash64("a", "b", "c").alias("p")).collect()))
    assert fingerprints.with_anchors(docs, "text", "a").first().a == want


def brute_nearest(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    return {int(ids[i]): sorted((-float(x[j] @ x[i]), int(ids[j])) for j in range(len(ids)) if j != i)[:k] for i in range(len(ids)) if ids[i] % 20 == 0}


def test_nearest_with_ties_and_unusable(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(100)]
    bad = [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 1.0, 1.0]), (2060, [1.0, float("nan"), 1.0, 1.0]), (2080, [1.0, 2.0]), (2100, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(spark, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert dict(got) == brute_nearest([r for r in rows if any(r[1])])
    assert neighbours.nearest(spark, df.limit(0)).count() == 0


def test_recall_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    expected = brute_nearest(rows)
    got = defaultdict(set)
    for r in registry.nearest_vectors(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    shared = sum(len(got[q] & {i for _, i in best}) for q, best in expected.items())
    assert shared >= 0.9 * sum(map(len, expected.values()))


def test_recall_with_narrow_windows(spark, monkeypatch):
    """4,000 vectors without structure, the production share of the window instead of its least size."""
    monkeypatch.setattr(neighbours, "WINDOW_LEAST", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    x = np.random.default_rng(3).normal(size=(4000, 64))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    expected = brute_nearest(rows)
    got = defaultdict(set)
    for r in neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in best}) for q, best in expected.items()) >= 0.9 * 20 * len(expected)


def test_hilbert_curve_steps_to_neighbours():
    for d, bits in ((2, 4), (3, 3), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
