from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from logwarden.functions.fixed_values import BOOTSTRAP_LINES
from logwarden.operators import iforest
from logwarden.operators import models as model_jobs
from logwarden.operators.features import add_features, fit_features
from logwarden.operators.models import (
    add_scores,
    bootstrap_lines,
    classifier_name,
    has_models,
    load_models,
)
from logwarden.plans.pipeline import retrain_store, score_lines
from logwarden.plans.training import label_lines, load_or_bootstrap, retrain, train
from logwarden.schemas import CLASSIFIERS
from logwarden.session import scratch_folder
from logwarden.sources.samples import log_lines

NORMAL = '127.0.0.1 - - [21/May/2026:10:00:00 +0000] "GET /index.html HTTP/1.1" 200 1024 "-" "Mozilla"'
EXPLOIT = '185.220.101.5 - - [21/May/2026:10:00:00 +0000] "GET /etc/passwd HTTP/1.1" 400 128 "-" "Mozilla"'


@pytest.fixture(scope="module")
def model_path(spark):
    return scratch_folder(spark, "models")


@pytest.fixture(scope="module")
def models(spark, model_path):
    assert not has_models(spark, model_path)
    return load_or_bootstrap(spark, model_path)


def python_terms(text):
    words = re.findall(r"(?u)\b\w+\b", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_tfidf_like_definition(lines):
    texts = ["Ab ab é_1 x", "ab, x-y", "", "Zz x"]
    model = fit_features(lines(texts), size=6)
    counts, docs = Counter(), Counter()
    for text in texts:
        counts.update(python_terms(text))
        docs.update(set(python_terms(text)))
    vocabulary = [t for t, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))][:6]
    assert model.stages[3].vocabulary == vocabulary
    rows = add_features(model, lines(texts)).orderBy("line_no").collect()
    for text, row in zip(texts, rows):
        tf = Counter(python_terms(text))
        weights = np.array(
            [tf[t] * (math.log((1 + len(texts)) / (1 + docs[t])) + 1) for t in vocabulary]
        )
        norm = np.linalg.norm(weights)
        expected = weights / norm if norm else weights
        assert np.allclose(row.features.toArray(), expected)


def test_labels_of_bootstrap_lines(spark):
    labels = label_lines(bootstrap_lines(spark)).orderBy("line_no").collect()
    assert len(labels) == len(BOOTSTRAP_LINES)
    assert [r.label for r in labels] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_exploit_scores_above_normal(models, lines):
    normal, exploit = (
        r.scores for r in add_scores(models, lines([NORMAL, EXPLOIT])).orderBy("line_no").collect()
    )
    for name in CLASSIFIERS:
        assert 0.0 <= normal[name].score <= 1.0
        assert exploit[name].score > normal[name].score


def test_saved_models_score_the_same(spark, models, model_path, lines):
    again = load_models(spark, model_path)
    frame = lines(BOOTSTRAP_LINES)
    first = add_scores(models, frame).orderBy("line_no").collect()
    assert first == add_scores(again, frame).orderBy("line_no").collect()


def test_no_models_means_default(lines):
    scores = add_scores(None, lines([NORMAL])).first().scores
    assert all(scores[n].prediction == "Normal" and scores[n].score == 0.05 for n in CLASSIFIERS)


def test_broken_model_path_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load_models(spark, str(tmp_path / "none"))


def test_forest_flags_a_tenth_and_ignores_partitioning(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    features = fit_features(lines, size=100)
    rows = add_features(features, lines).select("line_no", "features").persist()
    forest = iforest.fit_forest(rows, 100)
    other = iforest.fit_forest(rows.repartition(3), 100)
    for name, values in forest.nodes.items():
        assert np.array_equal(values, other.nodes[name])
    scored = iforest.score_samples(forest, rows, "raw")
    share = scored.agg(F.avg((F.col("raw") < forest.offset).cast("int"))).first()[0]
    assert 0.08 <= share <= 0.1
    rows.unpersist()


def test_forest_separates_outliers():
    rng = np.random.default_rng(0)
    data = rng.normal(0, 1, size=(256, 4))
    data[0] = 12.0
    trees = [iforest.grow_tree(data, 8, np.random.default_rng(i)) for i in range(50)]
    size = max(node[0] for tree in trees for node in tree) + 1
    names = ["feature", "threshold", "left", "right", "depth"]
    arrays = {n: np.zeros((50, size), dtype=float if n in ("threshold", "depth") else int) for n in names}
    for t, tree in enumerate(trees):
        for node, *values in tree:
            for name, value in zip(names, values):
                arrays[name][t, node] = value
    depth = iforest.walk(arrays, data)
    assert depth.argmin() == 0
    # One tree, followed by hand.
    tree = {n[0]: n for n in trees[0]}
    for i in range(20):
        node = tree[0]
        while node[1] >= 0:
            node = tree[node[3] if data[i, node[1]] <= node[2] else node[4]]
        one = {n: a[:1] for n, a in arrays.items()}
        assert iforest.walk(one, data[i : i + 1])[0] == node[5]


def test_classifier_names():
    assert classifier_name("Random Forest") == "random_forest"
    assert classifier_name("other") == "isolation_forest"


def test_score_lines_keeps_unparsed(models, lines):
    rows = score_lines(lines([EXPLOIT, "junk"]), models, "random_forest").orderBy("line_no").collect()
    assert rows[0].is_parsed and rows[0].prediction == "Anomaly"
    assert rows[0].threat_type == "Web Scanner / Reconnaissance"
    assert not rows[1].is_parsed and rows[1].prediction is None


def test_retrain_judges_the_store_again(spark, lines, tmp_path):
    paths = str(tmp_path / "models"), str(tmp_path / "store")
    fitted = retrain_store(lines(BOOTSTRAP_LINES), *paths)
    assert set(fitted.fitted) == set(CLASSIFIERS)
    rows = spark.read.parquet(paths[1]).orderBy("ingest_seq").collect()
    assert len(rows) == len(BOOTSTRAP_LINES)
    for row in rows:
        assert row.anomaly_score == pytest.approx(row.scores.isolation_forest.score, abs=1e-4)
    assert {r.prediction for r in rows[6:]} == {"Anomaly"}


def test_retrain_needs_ten_lines(spark, lines, tmp_path):
    with pytest.raises(ValueError):
        retrain(lines(BOOTSTRAP_LINES[:9]), str(tmp_path))


def test_fitted_regression_scores_after_an_observation(spark, lines):
    seen = Observation("rows")
    frame = lines(BOOTSTRAP_LINES)
    frame.observe(seen, F.count("*").alias("rows")).collect()
    assert seen.get == {"rows": len(BOOTSTRAP_LINES)}
    names = ["logistic_regression"]
    scored = add_scores(train(frame, names), frame, names=names)
    assert scored.count() == len(scored.collect()) == len(BOOTSTRAP_LINES)


def test_fits_deal_rows_to_small_partitions(lines, monkeypatch):
    monkeypatch.setattr(model_jobs, "ROWS_PER_TASK", 3)
    seen = []

    class Fit:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(model_jobs, "_supervised", lambda name, n: Fit())
    rows = lines(BOOTSTRAP_LINES).coalesce(1)
    model_jobs.fit_classifier(model_jobs.TrainingSet(None, rows), "random_forest")
    model_jobs.fit_classifier(model_jobs.TrainingSet(None, rows.limit(3)), "random_forest")
    assert seen == [(4, len(BOOTSTRAP_LINES)), (1, 3)]
