"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its words and their beginnings of 4 to 8 bytes, hashed. A feature's value grows with how
often the text has it and with its share of the words, up to 1.

Grades: 0 not toxic, then 1 to 3 by how much of a labelled toxic text is toxic wording. The labels say only
toxic or not; the wording is learned from them: features far more frequent in toxic texts (smoothed log odds
beyond chance and a threshold). The sum of their values, in thirds of the toxic texts, is the grade.

The model has one weight for each feature and ascending thresholds t_k that share the weights:
P(grade <= k) = logistic(t_k - score). The expected severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import Cache, id_and_text
from logwarden.llm.learning import FEATURED, collected, featured, labelled_texts, logistic, minimised
from logwarden.session import passing_tables, stage

#: Hashed features; a weight each, 8 MB.
WIDTH = 1 << 20
#: Bytes of the word beginnings that are features, besides the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A feature's value is 1 from this many times and this share of the words on.
FULL_TIMES, FULL_SHARE = 3, 0.01
#: Words of a window: a toxic passage is graded beside so many words, however long its text is. There are many
#: windows in a long text, so one counts only with this much more evidence (log odds; 0.8 instead of 0.5).
WINDOW, WINDOW_MARGIN = 100, 1.4
#: Bytes of one generation of the words whose features are known.
TELLING_BYTES = 16 << 20
#: Labelled documents that the fit uses at most.
SAMPLE = 8_000
#: A feature gets a weight if its log odds are so many standard errors from none.
LEAST_ERRORS = 2.0
#: Log odds from which such a feature counts as toxic wording when texts are graded.
TOXIC_ODDS = 2.5
GRADES = 4
#: Strength of the pull of weights to 0.
PULL = 2e-4

GRADED = "doc_id bigint, score double, p_toxic double, p_severe double, expected_severity double, grade int, toxic boolean"

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, A-Z in lower case; every non-ASCII byte counts as a letter."""
    return _LETTERS.findall(text.encode().translate(_LOWER))


def hashed(word: bytes) -> set[int]:
    """Numbers of a word's features."""
    return {zlib.crc32(word) % WIDTH, *(zlib.crc32(b"^" + word[:n]) % WIDTH for n in BEGINNINGS if len(word) >= n)}


def strength(times: np.ndarray, n_words: np.ndarray | int) -> np.ndarray:
    """Value of features met so many times among so many words."""
    return np.minimum(times / FULL_TIMES, 1) * np.minimum(times / (FULL_SHARE * np.maximum(n_words, 1)), 1)


def text_features(text: str) -> np.ndarray:
    """Number and value of each feature of a text, a row each, ascending."""
    own = words_of(text)
    times: Counter = Counter()
    for word, n in Counter(own).items():
        for feature in hashed(word):
            times[feature] += n
    number = np.fromiter(times.keys(), np.float32, len(times))
    value = strength(np.fromiter(times.values(), np.float64, len(times)), len(own)).astype(np.float32)
    order = np.argsort(number)
    return np.stack([number[order], value[order]])


@dataclass
class OrdinalModel:
    """Shared weights, ascending thresholds, and the chance from which a text is toxic."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def scorer(self):
        place = {f: i for i, f in enumerate(self.features.tolist())}
        #: Places of the weighted features of a word.
        telling = Cache(lambda word: tuple(place[f] for f in hashed(word) if f in place), TELLING_BYTES)

        def score(text: str) -> float:
            own = words_of(text)
            found = [(at, f) for at, features in enumerate(map(telling.__getitem__, own)) if features for f in features]
            if not found:
                return 0.0
            at, feature = np.array(found).T
            return self._largest(at, feature, len(own))

        return score

    def _largest(self, at: np.ndarray, feature: np.ndarray, n_words: int) -> float:
        """The largest score of the whole text and of its windows, given the words at which features were met.

        Every ``WINDOW`` words in a row lie for the most part in one of the windows, which overlap by half.
        """
        which, times = np.unique(feature, return_counts=True)
        best = float(self.weights[which] @ strength(times, n_words))
        if n_words <= WINDOW:
            return best
        step, last = WINDOW // 2, (n_words - 1) // (WINDOW // 2)
        # A word lies in the window that begins with its step and in the one before.
        window = np.concatenate([at // step, at // step - 1])
        feature = np.concatenate([feature, feature])
        inside = window >= 0
        key, times = np.unique(window[inside] * len(self.weights) + feature[inside], return_counts=True)
        value = self.weights[key % len(self.weights)] * strength(times, WINDOW)
        return max(best, float(np.bincount(key // len(self.weights), value, last + 1).max()) - WINDOW_MARGIN)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2, a row per text."""
        return logistic(np.asarray(scores, float)[:, None] - self.thresholds[None, :])


def log_odds(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By feature: smoothed log odds of toxic against other texts, summed values as counts; the same in standard errors."""
    toxic = toxic > 0
    sums = []
    for side in (True, False):
        total = np.zeros(WIDTH)
        for row, t in zip(rows, toxic, strict=True):
            if t == side:
                total[row[0].astype(np.int64)] += row[1]
        sums.append(total)
    odds = np.log((sums[0] + 0.5) / (toxic.sum() + 1)) - np.log((sums[1] + 0.5) / ((~toxic).sum() + 1))
    return odds, odds / np.sqrt(1 / (sums[0] + 0.5) + 1 / (sums[1] + 0.5))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, pull: float = PULL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their weights and thresholds, by full-batch descent on the cumulative-link likelihood.

    ``rows`` hold feature numbers and values; only features that tell toxic texts from others beyond chance
    get a weight. Without texts or with one grade there are none and the thresholds say how frequent the grades
    are, smoothed by two texts, mostly clean.
    """
    n = len(rows)
    share = [(float(np.sum(grades > k)) + 0.5) / (n + 2) for k in range(GRADES - 1)]
    start = np.maximum.accumulate(np.array([-np.log(p / (1 - p)) for p in share]) + np.arange(GRADES - 1) * 1e-3)
    none = np.empty(0, np.int64), np.zeros(0), start
    if not n or len(set(grades.tolist())) < 2:
        return none
    telling = np.flatnonzero(np.abs(log_odds(rows, grades)[1]) >= LEAST_ERRORS)
    if not len(telling):
        return none
    # Row by row, so that only the telling features of all texts are in memory twice.
    tells = np.zeros(WIDTH, bool)
    tells[telling] = True
    rows = [r[:, tells[r[0].astype(np.int64)]] for r in rows]
    column = np.searchsorted(telling, np.concatenate([r[0] for r in rows]).astype(np.int64))
    row = np.repeat(np.arange(n), [r.shape[1] for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(float)
    size = len(telling)

    def gradient(x: np.ndarray) -> np.ndarray:
        w, first, gaps = x[:size], x[size], np.exp(x[size + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[column] * value, n)
        at_most = logistic(cuts[None, :] - score[:, None])
        upper = np.where(grades < GRADES - 1, at_most[np.arange(n), np.minimum(grades, GRADES - 2)], 1.0)
        lower = np.where(grades > 0, at_most[np.arange(n), np.maximum(grades - 1, 0)], 0.0)
        chance = np.maximum(upper - lower, 1e-12)
        slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
        by_score = (slope_up - slope_low) / chance / n
        by_cut = np.zeros(GRADES - 1)
        np.add.at(by_cut, np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, -slope_up / chance / n, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, slope_low / chance / n, 0))
        after = np.cumsum(by_cut[::-1])[::-1]
        return np.concatenate([np.bincount(column, by_score[row] * value, size) + pull * w, [after[0]], after[1:] * gaps])

    gaps = np.log(np.maximum(np.diff(start), 0.05))
    found = minimised(gradient, np.concatenate([np.zeros(size), start[:1], gaps]))
    return telling, found[:size], found[size] + np.concatenate([[0.0], np.cumsum(np.exp(found[size + 1 :]))])


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of labelled texts: thirds of the toxic ones by their toxic wording."""
    grades = np.zeros(len(rows), np.int64)
    if not (toxic > 0).any():
        return grades
    odds, errors = log_odds(rows, toxic)
    wording = (odds > TOXIC_ODDS) & (errors >= LEAST_ERRORS)
    share = np.array([r[1] @ wording[r[0].astype(np.int64)] for r in rows])
    cuts = np.quantile(share[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, share, "left"), 0)


def telling_features(rows: DataFrame) -> np.ndarray:
    """Features that tell toxic texts from others, of ``FEATURED`` rows, summed where the rows are.

    A shade more than ``fit_ordinal`` keeps, which sums again in a fixed order.
    """
    sides = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WIDTH))
        for batch in batches:
            for label, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, value = np.frombuffer(cell.as_buffer(), "f4").reshape(2, -1)
                total[int(label > 0)][number.astype(np.int64)] += value
        met = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[0][met]), pa.array(total[1][met])], ["feature", "other", "toxic"])

    sums = rows.select("label", "features").mapInArrow(run, "feature bigint, other double, toxic double")
    other, toxic = F.sum("other") + 0.5, F.sum("toxic") + 0.5
    odds = F.log(toxic / (sides.get(True, 0) + 1)) - F.log(other / (sides.get(False, 0) + 1))
    errors = (odds / F.sqrt(1 / toxic + 1 / other)).alias("errors")
    found = sums.groupBy("feature").agg(errors).where(F.abs("errors") >= LEAST_ERRORS - 1e-6).select("feature")
    return np.sort(found.toArrow()["feature"].to_numpy())


def _only(rows: DataFrame, features: np.ndarray) -> DataFrame:
    """``FEATURED`` rows with these features only."""
    shared = rows.sparkSession.sparkContext.broadcast(features.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(cell.as_buffer(), "f4").reshape(2, -1) for cell in batch.column(2)]
            cells = [cell[:, np.isin(cell[0], shared.value)].tobytes() for cell in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], batch.schema.names)

    return rows.select("doc_id", "label", "features").mapInArrow(run, FEATURED)


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``limit`` labelled documents (``labels``: ``doc_id, toxic``).

    Their features are written once. The driver gets only those that tell toxic texts from others.
    """
    with passing_tables(docs.sparkSession):
        sample = stage(featured(labelled_texts(docs, labels, "toxic", limit), text_features, "f4"), "labelled")
        rows, toxic = collected(_only(sample, telling_features(sample)), "f4")
    rows = [r.reshape(2, -1) for r in rows]
    model = OrdinalModel(*fit_ordinal(rows, severity_grades(rows, toxic)))
    # The driver gives back the memory of the features, which only the fit needs.
    del rows
    pa.default_memory_pool().release_unused()
    return model


def grade_texts(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """A row per input row: score, chances, expected severity (0 to 3), likeliest grade and whether toxic.

    A text's score is the largest of the whole text and of its windows. A null or empty text has score 0.
    Chances that tie give the lower grade. Repeated rows are graded alike, a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        score_of = model.scorer()
        for batch in batches:
            score = np.array([score_of(text.as_py()) for text in batch.column(1)], float)
            above = model.above(score)
            chance = -np.diff(np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(above[:, 0]), pa.array(above[:, -1]), pa.array(above.sum(axis=1)),
                 pa.array(chance.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= model.cut)],
                ["doc_id", "score", "p_toxic", "p_severe", "expected_severity", "grade", "toxic"],
            )

    return id_and_text(docs).mapInArrow(run, GRADED)


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        score_of = model.scorer()
        for batch in batches:
            score = np.array([score_of(text.as_py() or "") for text in batch.column(at)], float)
            yield batch.filter(pa.array(model.above(score)[:, 0] < model.cut))

    return docs.mapInArrow(run, docs.schema)
