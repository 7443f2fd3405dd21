"""Weak supervision: counts against plain code, EM against its own definition, verdicts against labels."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import weak_rules
from logwarden.llm.weak_rules import BAD, GOOD, fit_label_model, quality_votes, repeated_words, rules, text_counts, votes_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    own = WORD.findall(text)
    windows = {}
    for i in range(len(own) - 2):
        windows.setdefault(tuple(own[i : i + 3]), []).append(i)
    held = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return [len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), again, len(held)]


def plain_em(votes, texts):
    """The same EM text by text, in plain Python."""
    import math

    k = len(votes[0]) if len(votes) else 0
    good, bad, share = [weak_rules.PRIOR_GOOD] * k, [weak_rules.PRIOR_BAD] * k, weak_rules.PRIOR_SHARE

    def chance(row):
        g, b = share, 1 - share
        for j, v in enumerate(row):
            if v == GOOD:
                g, b = g * good[j], b * (1 - bad[j])
            elif v == BAD:
                g, b = g * (1 - good[j]), b * bad[j]
        return g / (g + b), math.log(g + b)

    before, total = -math.inf, max(1.0, sum(texts))
    for _ in range(weak_rules.ROUNDS):
        each = [chance(row) for row in votes]
        now = sum(n * e[1] for n, e in zip(texts, each, strict=True)) / total
        if abs(now - before) < weak_rules.CLOSE:
            break
        before, m = now, weak_rules.PRIOR_VOTES
        p = [n * e[0] for n, e in zip(texts, each, strict=True)]
        q = [n - x for n, x in zip(texts, p, strict=True)]
        new_good, new_bad = [], []
        for j in range(k):
            says = lambda w, v, j=j: sum(x for x, row in zip(w, votes, strict=True) if row[j] == v)
            new_good.append((says(p, GOOD) + m * weak_rules.PRIOR_GOOD) / (says(p, GOOD) + says(p, BAD) + m))
            new_bad.append((says(q, BAD) + m * weak_rules.PRIOR_BAD) / (says(q, BAD) + says(q, GOOD) + m))
        good, bad = new_good, new_bad
        t = weak_rules.PRIOR_TEXTS
        share = (sum(p) + t * weak_rules.PRIOR_SHARE) / (sum(texts) + t)
    return [chance(row)[0] for row in votes]


@pytest.fixture(scope="module")
def judged(spark, sf_dir):
    rows, model = quality_votes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.collect(), model


def test_counts_of_whole_table(spark, sf_dir, judged):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, _ = judged
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def test_posteriors_of_whole_table_are_those_of_plain_em(judged):
    rows, _ = judged
    found = {r["votes"]: r["p_good"] for r in rows}
    patterns = sorted(found)
    votes = votes_of(np.array(patterns), len(rules())).tolist()
    want = plain_em(votes, [float(sum(r["votes"] == p for r in rows)) for p in patterns])
    assert [found[p] for p in patterns] == pytest.approx(want, abs=1e-6)


def test_agrees_with_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.1"
    rows, model = quality_votes(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    counts = {
        (r["quality"], r["kept"]): r["n"]
        for r in rows.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert good >= 0.99 * (good + counts.get((1, False), 0))
    assert bad >= 0.95 * (bad + counts.get((0, True), 0))
    assert 0.5 < model.share < 1


def test_em_finds_planted_accuracies():
    draw = np.random.default_rng(1)
    n, right_good, right_bad = 200_000, np.array([0.98, 0.95, 0.9, 0.97]), np.array([0.8, 0.7, 0.9, 0.6])
    good = draw.random(n) < 0.7
    says_good = np.where(good[:, None], draw.random((n, 4)) < right_good, draw.random((n, 4)) >= right_bad)
    votes = np.where(draw.random((n, 4)) < 0.1, 1, np.where(says_good, GOOD, BAD))
    patterns, texts = np.unique(votes, axis=0, return_counts=True)
    model = fit_label_model(patterns, texts.astype(float))
    assert model.share == pytest.approx(0.7, abs=0.02)
    assert model.good_right == pytest.approx(right_good, abs=0.02)
    assert model.bad_right == pytest.approx(right_bad, abs=0.03)


def test_repeated_words_against_plain_code():
    draw = random.Random(2)
    for _ in range(300):
        own = [draw.choice("abc").encode() for _ in range(draw.randrange(12))]
        assert repeated_words(own) == plain_counts(" ".join(w.decode() for w in own))[4]


def test_awkward_texts_and_clashing_columns(spark, awkward):
    df = awkward.withColumn("votes", F.lit("x")).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("x"))
    rows, _ = quality_votes(df)
    got = sorted(((r["doc_id"], *[r[c] for c in weak_rules.COUNTS[:5]]) for r in rows.collect()), key=str)
    want = sorted(((r["doc_id"], *plain_counts(r["text"] or "")) for r in awkward.collect()), key=str)
    assert got == want
    assert text_counts("") == [0] * len(weak_rules.COUNTS)


def test_empty_table(spark):
    rows, model = quality_votes(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.collect() == []
    assert model.share == pytest.approx(weak_rules.PRIOR_SHARE)
