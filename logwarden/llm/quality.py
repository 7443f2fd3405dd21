"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's.

A logistic classifier on shape statistics of the whole text gives each document a chance p of being good. The
chances of a path's documents (host and path) and of a host's are beta-binomial evidence: a host's posterior
mean shrinks toward the corpus mean, a path's toward its host's, the more the fewer documents there are. How
strongly is estimated from the spread between sites (method of moments). A document's odds are its own times
its path's odds relative to the corpus; its own chance is taken out of its site's evidence first.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.learning import SAMPLE, collected, featured, labelled_texts, logistic, minimised, with_column
from logwarden.session import stage

#: Bins of a statistic, by quantiles of the sample.
BINS = 12
#: Pull of the weights to 0.
PULL = 1e-3
#: Documents whose chance is less are rejected.
CUT = 0.5
#: The strength of a prior, in documents, is kept within these.
STRENGTH = (1.0, 1e6)
#: One document's chance says at most so much.
CLIP = 1e-3


def shape(text: str) -> np.ndarray:
    """Shares that describe a whole text: letter case, symbols, digits, lines, words and how they repeat."""
    raw = text.encode()
    n = max(1, len(raw))
    own = raw.split()
    many = max(1, len(own))
    counts = Counter(own)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    held = lambda chars: n - len(raw.translate(None, chars)) if raw else 0
    upper, lower = held(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), held(b"abcdefghijklmnopqrstuvwxyz")
    return np.array([
        upper / max(1, upper + lower),
        held(b"#$%&*") / n, held(b"|") / n, held(b"!?") / n, held(b"0123456789") / n, held(b".,;:") / n,
        held(b"@/\\_=<>[]{}()\"'`~^+-") / n,
        len(counts) / many, max(counts.values(), default=0) / many,
        sum(map(len, own)) / many,
        np.log1p(len(own)),
        len(lines) / many,
        len(set(lines)) / max(1, len(lines)),
        sum(1 for a, b in zip(own, own[1:], strict=False) if a == b) / many,
    ])


@dataclass
class ShapeModel:
    """Weights of binned statistics; columns are statistics, rows bins."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def chances(self, shapes: np.ndarray) -> np.ndarray:
        score = np.full(len(shapes), self.bias)
        for k in range(self.edges.shape[1]):
            score += self.weights[np.searchsorted(self.edges[:, k], shapes[:, k], "right"), k]
        return logistic(score)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        return self.chances(np.array([shape(t) for t in texts])) if texts else np.empty(0)


def fit_shapes(shapes: np.ndarray, good: np.ndarray) -> ShapeModel:
    """Logistic regression on the bins; without both labels every text gets the labels' smoothed share."""
    n, k = shapes.shape
    bias = float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1)))
    if not n or good.min() == good.max():
        return ShapeModel(np.zeros((BINS - 1, k)), np.zeros((BINS, k)), bias)
    edges = np.quantile(shapes, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    bins = np.stack([np.searchsorted(edges[:, j], shapes[:, j], "right") + j * BINS for j in range(k)], axis=1)

    def gradient(x: np.ndarray) -> np.ndarray:
        error = (logistic(x[0] + x[1:][bins].sum(axis=1)) - good) / n
        back = np.bincount(bins.ravel(), np.repeat(error, k), BINS * k)
        return np.concatenate([[error.sum()], back + PULL * x[1:]])

    found = minimised(gradient, np.concatenate([[bias], np.zeros(BINS * k)]))
    return ShapeModel(edges, found[1:].reshape(k, BINS).T, float(found[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ShapeModel:
    """Fit on at most ``limit`` labelled documents (``labels``: ``doc_id, quality``)."""
    rows, good = collected(featured(labelled_texts(docs, labels, "quality", limit), shape, "f8"), "f8")
    return fit_shapes(np.array(rows).reshape(-1, len(shape(""))), good.astype(float))


def _strength(sites: DataFrame, expected: str) -> float:
    """Documents that a prior is worth: method of moments over sites with ``n``, ``s`` and an expected mean.

    The spread of site means beyond what chance makes is the variance of the prior; less spread, a stronger prior.
    """
    gap = F.col("s") / F.col("n") - F.col(expected)
    within = F.col(expected) * (1 - F.col(expected))
    row = sites.where("n > 0").agg(
        F.sum(F.col("n") * gap * gap).alias("spread"), F.sum(within).alias("chance"),
        F.sum(F.col("n") * within).alias("all"), F.sum("n").alias("n"),
    ).first()
    if not row["n"]:
        return STRENGTH[1]
    beyond = max((row["spread"] - row["chance"]) / row["n"], 0.0)
    inside = row["all"] / row["n"]
    return float(np.clip(inside / beyond - 1 if beyond > 0 else STRENGTH[1], *STRENGTH))


@dataclass
class Sites:
    """Site evidence: a row per (host, path) with sums of its own and its host's, and the priors' strengths."""

    table: DataFrame
    mean: float
    of_host: float
    of_path: float


def site_evidence(scored: DataFrame) -> Sites:
    """Sums by path and host of ``site_host, site_path, site_p``, partly summed before they are shuffled."""
    paths = stage(
        scored.groupBy("site_host", "site_path").agg(F.count(F.lit(1)).alias("n"), F.sum("site_p").alias("s")), "paths"
    )
    hosts = paths.groupBy("site_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = float(np.clip(0.5 if total is None else total, CLIP, 1 - CLIP))
    of_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.lit(mean).alias("m")), "m")
    host_mean = (F.col("host_s") + of_host * mean) / (F.col("host_n") + of_host)
    table = stage(paths.join(hosts, "site_host").withColumn("host_mean", host_mean), "sites")
    return Sites(table, mean, of_host, _strength(table, "host_mean"))


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.log(bounded / (1 - bounded))


def with_posteriors(scored: DataFrame, sites: Sites) -> DataFrame:
    """Add ``site_host_mean``, ``site_path_mean`` (without the document itself) and ``site_quality``.

    The table of sites is joined by host and path; Spark sends it to all tasks only where its written size
    allows, and splits the rows of a hot site otherwise.
    """
    own = F.col("site_p")
    joined = scored.join(sites.table, ["site_host", "site_path"])
    host = (F.col("host_s") - own + sites.of_host * sites.mean) / (F.col("host_n") - 1 + sites.of_host)
    path = (F.col("s") - own + sites.of_path * F.col("site_host_mean")) / (F.col("n") - 1 + sites.of_path)
    odds = _logit(own) + _logit(F.col("site_path_mean")) - _logit(F.lit(sites.mean))
    return joined.withColumn("site_host_mean", host).withColumn("site_path_mean", path).withColumn(
        "site_quality", 1 / (1 + F.exp(-odds))
    )


def _scored(docs: DataFrame, model: ShapeModel, host: Column, path: Column) -> DataFrame:
    """All columns, and the site columns under names of this module (they replace columns named so)."""
    named = docs.withColumn("site_host", F.coalesce(host.cast("string"), F.lit(""))).withColumn(
        "site_path", F.coalesce(path.cast("string"), F.lit(""))
    )
    return with_column(named.drop("site_p"), "text", "site_p", model.of_texts)


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, limit: int = SAMPLE) -> DataFrame:
    """``doc_id, host, path, p_document, host_posterior, path_posterior, p_quality, keep``: a row per input row.

    ``host`` and ``path`` say where a document is from; null is a site of its own name, "".  Null and empty texts
    get the chance of their shape. No documents give no rows.
    """
    model = fit_quality(docs, labels, limit)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.alias("h"), path.alias("p"))
    scored = stage(_scored(slim, model, F.col("h"), F.col("p")).drop("text", "h", "p"), "scored")
    out = with_posteriors(scored, site_evidence(scored))
    return out.select(
        "doc_id", F.col("site_host").alias("host"), F.col("site_path").alias("path"), F.col("site_p").alias("p_document"),
        F.col("site_host_mean").alias("host_posterior"), F.col("site_path_mean").alias("path_posterior"),
        F.col("site_quality").alias("p_quality"), (F.col("site_quality") >= CUT).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, limit: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected.

    Texts are scored once for the sites and once for the verdict, so they are not shuffled.
    """
    model = fit_quality(docs, labels, limit)
    slim = docs.select("text", host.alias("h"), path.alias("p"))
    evidence = site_evidence(_scored(slim, model, F.col("h"), F.col("p")).select("site_host", "site_path", "site_p"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("text"), host.alias("h"), path.alias("p"))
    judged = with_posteriors(_scored(keyed, model, F.col("h"), F.col("p")), evidence)
    return judged.where(F.col("site_quality") >= CUT).select("kept.*")
