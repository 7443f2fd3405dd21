"""Quality by weak supervision: rules vote, EM weighs them, a posterior decides.

Each rule looks at counts of a whole text and votes good, bad or abstains. A text's true quality is hidden; a
rule that does not abstain is right with one chance on good texts and another on bad ones. Expectation and
maximisation over the vote patterns of all texts estimates these accuracies and the share of good texts. A text
is kept by its posterior chance of being good, so one failed rule need not reject it and several weak ones may.

Votes of ``n`` rules have at most 3^n patterns. Spark counts texts by pattern; only those counts, at most 59,049
rows for ten rules, reach the driver, and the posteriors go back as a table of as many rows.

Every kind of bad text should meet two rules or more: a rule that fails alone looks like a rule that errs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import id_and_text
from logwarden.session import stage

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_ends", "n_marks", "n_odd_ends", "n_no_letter",
]
COUNTED = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

#: Base rules: fewer words, or more repeated ones in a hundred, fail whatever the votes.
LEAST_WORDS, MOST_REPEATED = 50, 50

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Rounds of EM at most, and the change of the log-likelihood for each text at which it ends.
ROUNDS, CLOSE = 500, 1e-10
#: Votes that the prior of an accuracy is worth, and its mean on good and on bad texts.
PRIOR_VOTES, PRIOR_GOOD, PRIOR_BAD = 4.0, 0.95, 0.5
#: Texts that the prior of the share of good texts is worth, and its mean.
PRIOR_TEXTS, PRIOR_SHARE = 4.0, 0.8

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_NOT_ASCII = bytes(range(128, 256))
#: Word ends that prose has not: a sign other than a bracket, quote or single stop.
_ODD_END = re.compile(rb"(?:[^\w \t-\r.,;:!?)\]\"'\x80-\xff]|[.,;:!?]{2})(?![^ \t-\r])")
#: Words without any letter.
_NO_LETTER = re.compile(rb"(?<![^ \t-\r])[^A-Za-z\x80-\xff \t-\r]+(?![^ \t-\r])")
#: Ends of sentences.
_END = re.compile(rb"[.!?](?![^ \t-\r])")
_WORD_SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"


def repeated_words(own: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    n = len(own) - size + 1
    if n < 2:
        return 0
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    window = ids[:n]
    for k in range(1, size):
        # Pairs of (window so far, next word) are numbered anew, so that numbers stay below n * words.
        _, window = np.unique(window * len(number) + ids[k : n + k], return_inverse=True)
    held = np.zeros(len(own), bool)
    again = np.bincount(window)[window] > 1
    for k in range(size):
        held[k : n + k] |= again
    return int(held.sum())


def text_counts(text: str) -> list[int]:
    """The numbers of ``COUNTS`` for one whole text."""
    raw = text.encode()
    own = raw.split()
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    ascii_chars = len(raw.translate(None, _NOT_ASCII))
    letters = upper + len(raw) - len(raw.translate(None, _LOWER)) + len(text) - ascii_chars
    return [
        len(own), len(text) - sum(map(text.count, _WHITE)), sum(map(text.count, _WORD_SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(own), len(lines), upper, letters,
        len(_END.findall(raw)), text.count("!"), len(_ODD_END.findall(raw)), len(_NO_LETTER.findall(raw)),
    ]


def count_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` of each whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_counts(text.as_py()) for text in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["doc_id", *COUNTS])

    return id_and_text(docs).mapInArrow(run, COUNTED)


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where its condition holds, else abstains."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, BAD).when(self.good, GOOD).otherwise(ABSTAIN)


def rules() -> list[Rule]:
    """Whole-text rules after public corpus filters; shares are in hundredths, so votes are exact."""
    words, lines, letters = F.col("n_words"), F.col("n_lines"), F.col("n_letters")

    def share(name: str, part: str, whole: Column, at_most: int, over: int, least: int) -> Rule:
        """Good up to ``at_most`` hundredths, bad over ``over``; abstains if the whole is too small to tell."""
        enough, found = whole >= least, F.col(part) * 100
        return Rule(name, enough & (found <= whole * at_most), enough & (found > whole * over))

    enough = words >= 10
    many, chars = words >= 20, F.col("word_chars")
    return [
        Rule("word_length", enough & chars.between(words * 3, words * 10), enough & ~chars.between(words * 2, words * 15)),
        Rule("letters", enough & (letters * 100 >= chars * 85), enough & (letters * 100 < chars * 75)),
        share("symbols", "n_symbols", words, 1, 10, 10),
        share("word_ends", "n_odd_ends", words, 5, 20, 10),
        share("worded", "n_no_letter", words, 10, 20, 10),
        share("repeated_lines", "n_dup_lines", lines, 10, 30, 3),
        share("repeated_words", "n_repeat_words", words, 15, 40, 10),
        share("upper_case", "n_upper", letters, 10, 30, 40),
        Rule("sentence_ends", many & (F.col("n_ends") * 100).between(words * 2, words * 30), many & (F.col("n_ends") * 200 < words)),
        share("exclamations", "n_marks", words, 1, 10, 10),
    ]


def pattern(own: list[Rule]) -> Column:
    """All votes as one number, the first rule's the lowest digit of base 3."""
    return sum((rule.vote().cast("int") * 3**k for k, rule in enumerate(own)), F.lit(0)).cast("int")


@dataclass
class LabelModel:
    """Chance of each vote, given that there is one, on good and on bad texts; and the share of good texts."""

    good_right: np.ndarray
    bad_right: np.ndarray
    share: float

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        says_good, says_bad = votes == GOOD, votes == BAD
        for_good = says_good * np.log(self.good_right) + says_bad * np.log1p(-self.good_right)
        for_bad = says_good * np.log1p(-self.bad_right) + says_bad * np.log(self.bad_right)
        return np.log(self.share) - np.log1p(-self.share) + for_good.sum(axis=1) - for_bad.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -700, 700)))

    def log_likelihood(self, votes: np.ndarray, texts: np.ndarray) -> float:
        says_good, says_bad = votes == GOOD, votes == BAD
        good = np.log(self.share) + (says_good * np.log(self.good_right) + says_bad * np.log1p(-self.good_right)).sum(axis=1)
        bad = np.log1p(-self.share) + (says_good * np.log1p(-self.bad_right) + says_bad * np.log(self.bad_right)).sum(axis=1)
        return float(texts @ np.logaddexp(good, bad))


def fit_label_model(votes: np.ndarray, texts: np.ndarray) -> LabelModel:
    """EM over vote patterns (a row each) and the number of texts of each.

    Accuracies start from and are smoothed by weak beta priors: a rule is nearly always right on good texts and
    right on half of the bad ones, so of the two mirrored solutions EM takes the one in which good votes mean good.
    Without texts the priors are the model.
    """
    k = votes.shape[1]
    model = LabelModel(np.full(k, PRIOR_GOOD), np.full(k, PRIOR_BAD), PRIOR_SHARE)
    says_good, says_bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    total, before = max(1.0, float(texts.sum())), -np.inf
    for _ in range(ROUNDS):
        now = model.log_likelihood(votes, texts) / total
        if abs(now - before) < CLOSE:
            break
        before = now
        good = model.posterior(votes) * texts
        bad = texts - good

        def right(agree: np.ndarray, against: np.ndarray, mean: float) -> np.ndarray:
            return (agree + PRIOR_VOTES * mean) / (agree + against + PRIOR_VOTES)

        model = LabelModel(
            right(good @ says_good, good @ says_bad, PRIOR_GOOD),
            right(bad @ says_bad, bad @ says_good, PRIOR_BAD),
            (float(good.sum()) + PRIOR_TEXTS * PRIOR_SHARE) / (float(texts.sum()) + PRIOR_TEXTS),
        )
    return model


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    """The votes that pattern numbers stand for, a row each."""
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3


def quality_votes(docs: DataFrame, own: list[Rule] | None = None) -> tuple[DataFrame, LabelModel]:
    """Counts, votes and posterior of each text, and the fitted model.

    Every row of ``docs`` gives one row: ``doc_id``, ``COUNTS``, ``votes``, ``p_good``, ``base_failed``, ``kept``.
    A null or empty text has no words: all counts are 0 and the base rules fail it. Repeated rows count and
    are returned as often as they come; texts of equal votes have equal posteriors. No documents give no rows.
    """
    own = rules() if own is None else own
    counted = stage(count_texts(docs).withColumn("votes", pattern(own)), "rule-votes")
    rows = sorted(counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = np.array([r["votes"] for r in rows], np.int64)
    texts = np.array([r["n"] for r in rows], float)
    votes = votes_of(patterns, len(own))
    model = fit_label_model(votes, texts)
    spark = docs.sparkSession
    posterior = spark.createDataFrame(
        list(zip(patterns.tolist(), model.posterior(votes).tolist(), strict=True)), "votes int, p_good double"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    judged = counted.join(F.broadcast(posterior), "votes").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("p_good") >= 0.5)
    return judged.withColumn("kept", kept).select("doc_id", *COUNTS, "votes", "p_good", "base_failed", "kept"), model
