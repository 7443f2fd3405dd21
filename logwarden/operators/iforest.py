"""Isolation forest (Liu, Ting, Zhou 2008) on sparse feature vectors.

Trees are built in parallel, each from at most 256 rows that a hash of the row number picks, so the
forest does not depend on how the data is partitioned. Scoring broadcasts the node arrays (at most
100 trees of 511 nodes) and walks all trees of an Arrow batch at once.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.1
SEED = 42
SPARE = 4  # candidates per wanted row, so that the hash cut never leaves too few
HASH_RANGE = 2**31
SCORE_ROWS = 512
QUANTILE_ACCURACY = 100_000
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, depth double"
)

# Workers get these functions by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def average_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def to_dense(indices: list, values: list, width: int) -> np.ndarray:
    dense = np.zeros((len(indices), width))
    rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    if len(rows):
        dense[rows, np.concatenate(indices)] = np.concatenate(values)
    return dense


def grow_tree(data: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(node, feature, threshold, left, right, depth)``; leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(data)), 0)]
    made = 1
    while todo:
        node, rows, depth = todo.pop()
        part = data[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_depth(len(rows))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        left, right = made, made + 1
        made += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        todo.append((left, rows[goes_left], depth + 1))
        todo.append((right, rows[~goes_left], depth + 1))
    return nodes


@dataclass
class IsolationForest:
    """``nodes`` holds one array per node field, shaped (trees, nodes)."""

    nodes: dict[str, np.ndarray]
    width: int
    sample_rows: int
    offset: float = -0.5

    def table(self, spark: SparkSession) -> DataFrame:
        return node_table(self.nodes, spark)


def node_table(nodes: dict[str, np.ndarray], spark: SparkSession) -> DataFrame:
    trees, size = nodes["feature"].shape
    frame = pd.DataFrame({k: v.ravel() for k, v in nodes.items()})
    frame.insert(0, "tree", np.repeat(np.arange(trees), size))
    frame.insert(1, "node", np.tile(np.arange(size), trees))
    return spark.createDataFrame(frame, NODE_SCHEMA)


def from_table(nodes: pd.DataFrame, width: int, sample_rows: int, offset: float) -> IsolationForest:
    trees, size = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    arrays = {}
    for name, empty, kind in (
        ("feature", -1, np.int32), ("threshold", 0.0, np.float64), ("left", -1, np.int32),
        ("right", -1, np.int32), ("depth", 0.0, np.float64),
    ):
        arrays[name] = np.full((trees, size), empty, dtype=kind)
        arrays[name][at] = nodes[name].to_numpy()
    return IsolationForest(arrays, width, sample_rows, offset)


def linked(nodes: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The nodes of all trees one after the other, for ``mean_value``: features, thresholds, children, values, steps.

    Leaves lead to themselves, so that every walk can take as many steps as the deepest one.
    """
    trees, size = nodes["feature"].shape
    first = np.arange(trees, dtype=np.int32)[:, None] * np.int32(size)
    own = first + np.arange(size, dtype=np.int32)
    leaf = nodes["feature"] < 0
    left, right = (np.where(leaf, own, first + nodes[side]).astype(np.int32) for side in ("left", "right"))
    children = np.stack([left, right], axis=-1).ravel()
    reached, steps = np.unique(first.ravel()), 0
    while True:
        inner = reached[~leaf.ravel()[reached]]
        if len(inner) == 0:
            break
        reached, steps = np.concatenate([children[2 * inner], children[2 * inner + 1]]), steps + 1
    feature = np.where(leaf, 0, nodes["feature"]).astype(np.int32).ravel()
    return feature, nodes["threshold"].ravel(), children, nodes["depth"].ravel(), steps, first.ravel()


def mean_value(links: tuple[np.ndarray, ...], dense: np.ndarray) -> np.ndarray:
    """Mean over all trees of the value of the leaf that each row comes to."""
    feature, threshold, children, value, steps, first = links
    flat = np.ascontiguousarray(dense).ravel()
    row = (np.arange(len(dense), dtype=np.int32) * np.int32(dense.shape[1]))[:, None]
    at = np.broadcast_to(first, (len(dense), len(first))).copy()
    for _ in range(steps):
        below = flat.take(row + feature.take(at)) <= threshold.take(at)
        at = children.take(2 * at + ~below)
    return value.take(at).mean(axis=1)


def walk(nodes: dict[str, np.ndarray], dense: np.ndarray) -> np.ndarray:
    """Mean depth of each row over all trees."""
    return mean_value(linked(nodes), dense)


def _hash(*parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(p) for p in parts]), F.lit(HASH_RANGE))


def _tree_samples(features: DataFrame, n: int, trees: int, rows: int, seed: int) -> DataFrame:
    """``tree, indices, values``: ``rows`` rows per tree, chosen by hash.

    One hash per row keeps a pool of about ``SPARE * trees * rows`` rows; only the pool is hashed
    again for every tree.
    """
    line = F.col("line_no")
    pool_cut = min(1.0, SPARE * trees * rows / n)
    pool = features.filter(_hash(line, seed) < int(pool_cut * HASH_RANGE))
    tree_cut = int(min(1.0, SPARE * rows / (n * pool_cut)) * HASH_RANGE)
    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _hash(line, t, seed + 1) < tree_cut
    )
    vector = F.unwrap_udt("features")
    spread = pool.select(
        F.explode(chosen).alias("tree"),
        "line_no",
        vector["indices"].alias("indices"),
        vector["values"].alias("values"),
    )
    order = Window.partitionBy("tree").orderBy(_hash(line, F.col("tree"), seed + 2), "line_no")
    ranked = spread.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= rows).drop("_rank")


def fit_forest(
    features: DataFrame,
    width: int,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> IsolationForest:
    """Fit on ``line_no, features`` (sparse vectors of ``width``)."""
    n = features.count()
    if n == 0:
        raise ValueError("cannot fit a forest on no rows")
    rows = min(sample_rows, n)
    limit = max(1, math.ceil(math.log2(max(rows, 2))))

    def build(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        ordered = sample.sort_values("line_no")
        dense = to_dense(list(ordered["indices"]), list(ordered["values"]), width)
        grown = grow_tree(dense, limit, np.random.default_rng([seed, tree]))
        names = ["node", "feature", "threshold", "left", "right", "depth"]
        made = pd.DataFrame(grown, columns=names)
        made.insert(0, "tree", tree)
        return made

    samples = _tree_samples(features, n, trees, rows, seed)
    nodes = samples.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    forest = from_table(nodes, width, rows, 0.0)
    cut = score_samples(forest, features, "raw").agg(
        F.percentile_approx("raw", contamination, QUANTILE_ACCURACY).alias("cut")
    )
    forest.offset = float(cut.first()["cut"])
    return forest


def score_samples(forest: IsolationForest, rows: DataFrame, output: str) -> DataFrame:
    """Add -2^(-depth/c): the lower, the easier a row is to isolate."""
    scale = average_depth(forest.sample_rows) or 1.0
    scored = add_mean(forest.nodes, forest.width, rows, output)
    return scored.withColumn(output, -F.pow(F.lit(2.0), -F.col(output) / scale))


def add_mean(nodes: dict[str, np.ndarray], width: int, rows: DataFrame, output: str) -> DataFrame:
    """Add the mean over all trees of the leaf values that ``features`` come to."""
    shared = rows.sparkSession.sparkContext.broadcast(linked(nodes))

    @F.arrow_udf("double")
    def mean(indices: pa.Array, values: pa.Array) -> pa.Array:
        means = np.empty(len(indices))
        for start in range(0, len(indices), SCORE_ROWS):
            ids = indices.slice(start, SCORE_ROWS)
            points = values.slice(start, SCORE_ROWS)
            lengths = np.diff(ids.offsets.to_numpy())
            dense = np.zeros((len(ids), width))
            dense[np.repeat(np.arange(len(ids)), lengths), ids.flatten().to_numpy()] = (
                points.flatten().to_numpy()
            )
            means[start : start + len(ids)] = mean_value(shared.value, dense)
        return pa.array(means)

    vector = F.unwrap_udt("features")
    return rows.withColumn(output, mean(vector["indices"], vector["values"]))
