"""Random forest and gradient-boosted trees on sparse rows, fitted by Spark over histograms.

Rows are binned once, as Spark's own learners do (32 bins a feature, thresholds from a sample of about 10,000 rows), but
only the terms that a line has are kept: some dozens of numbers a line instead of one for each term of the vocabulary.
A level of trees takes one pass: each task counts its rows by (node, term, bin), with what is left of a node's rows in bin
0; Spark sums the counts, each task picks the best split of each node among its terms, and only these reach the driver. Targets are integers
(residuals in units of 2^-32), so sums and trees do not depend on the order of rows or tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import iforest
from .iforest import SEED

BINS = 32
SPLIT_SAMPLE_ROWS = 10_000
BLOCK_ROWS = 8_192
COUNT_BIT = 49  # of a sum that holds a count above it and a sum of targets (at most 2**34 each) below
MOST_ROWS = 2 ** (63 - COUNT_BIT) - 1  # in a block of which such sums are made
PART_ROWS = 1_000_000
BATCH_BYTES = 1_000_000
PIECE = 8_192  # entries counted at once: larger arrays are fresh memory each time, which costs more than the counting
NODES_PER_PASS = 4_096  # bounds the histogram of a task: 64 MB where a node looks at 32 terms
UNIT = 2.0**32
MARGIN_ROUNDS = 10  # rounds of boosting between two stored margins
LEAST_GAIN = 1e-12  # of a node's own sum of squares: less is rounding

BLOCK_SCHEMA = "seed array<bigint>, labels binary, counts binary, rows binary, bins binary, margins binary"
COUNT_SCHEMA = "slot int, feature int, bin int, n bigint, s bigint"
BEST_SCHEMA = "slot int, n bigint, s bigint, feature int, bin int, gain double, n_left bigint, s_left bigint"
BEST_TYPES = pa.schema([
    ("slot", pa.int32()), ("n", pa.int64()), ("s", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()),
    ("gain", pa.float64()), ("n_left", pa.int64()), ("s_left", pa.int64()),
])

# Workers get these functions by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Tree:
    """Nodes while a tree grows: rows with bins up to ``bin`` of ``feature`` go left; leaves point to themselves."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [BINS])
    left: list[int] = field(default_factory=lambda: [0])
    n: list[int] = field(default_factory=lambda: [0])
    s: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin: int) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin, left
        for child in (left, left + 1):
            for column, value in ((self.feature, 0), (self.bin, BINS), (self.left, child), (self.n, 0), (self.s, 0)):
                column.append(value)
        return left, left + 1

    def is_leaf(self, node: int) -> bool:
        return self.left[node] == node

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, bins, and the children of each node one after the other."""
        left = np.array(self.left, dtype=np.intp)
        right = np.where(left == np.arange(len(left)), left, left + 1)
        bins = np.array(self.bin, dtype=np.uint8)
        return np.array(self.feature, dtype=np.int32), bins, np.stack([left, right], 1).ravel()


# --- binned rows ---------------------------------------------------------------------------------
def find_splits(values: np.ndarray, counts: np.ndarray, rows: int) -> list[float]:
    """At most 31 thresholds between the values of a term, at strides of equal counts, zeros of other rows included."""
    zeros = rows - int(counts.sum())
    if zeros > 0:
        values, counts = np.append(values, 0.0), np.append(counts, zeros)
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) < BINS:
        return middles.tolist()
    found, stride = [], rows / BINS
    reached, target = int(counts[0]), stride
    for i in range(1, len(values)):
        before = reached
        reached += int(counts[i])
        if abs(before - target) < abs(reached - target):
            found.append(float(middles[i - 1]))
            target += stride
    return found[: BINS - 1]


def split_table(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Thresholds of each term, filled up with infinity; one row of 31 a term."""
    sample = rows if n <= SPLIT_SAMPLE_ROWS else rows.sample(SPLIT_SAMPLE_ROWS / n, SEED)
    vector = F.unwrap_udt("features")
    sample = sample.select(vector["indices"].alias("ids"), vector["values"].alias("weights")).persist()
    m = sample.count()
    values = (
        sample.select(F.inline(F.arrays_zip("ids", "weights"))).groupBy("ids", "weights").agg(F.count("*").alias("n"))
    )

    def splits(part: pd.DataFrame) -> pd.DataFrame:
        found = find_splits(part["weights"].to_numpy(), part["n"].to_numpy(), m)
        return pd.DataFrame({"id": [int(part["ids"].iloc[0])], "splits": [found]})

    table = np.full((width, BINS - 1), np.inf)
    for row in values.groupBy("ids").applyInPandas(splits, "id int, splits array<double>").collect():
        table[row["id"], : len(row["splits"])] = row["splits"]
    sample.unpersist()
    return table


def bin_of(table: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The number of a term's thresholds below each value."""
    bins = np.zeros(len(ids), dtype=np.int64)
    for step in (16, 8, 4, 2, 1):
        bins += step * (table[ids, bins + step - 1] < values)
    return bins.astype(np.uint8)


def binned_blocks(rows: DataFrame, table: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``label, features`` as blocks of rows; values in bin 0 are left out like zeros."""
    width = len(table)
    keys = np.min_scalar_type(width * BINS)  # short keys are sorted by radix
    vector = F.unwrap_udt("features")
    plain = rows.select(
        F.col("label").cast("double").alias("label"), vector["indices"].alias("ids"), vector["values"].alias("weights")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                labels, ids, weights = batch.slice(start, block_rows).columns
                lengths = np.diff(ids.offsets.to_numpy())
                flat = ids.flatten().to_numpy()
                bins = bin_of(table, flat, weights.flatten().to_numpy())
                # In order of terms and bins, so that their rows are found without a look at the others.
                kept = np.flatnonzero(bins)
                kept = kept[np.argsort((flat[kept] * BINS + bins[kept]).astype(keys), kind="stable")]
                row = np.repeat(np.arange(len(lengths)), lengths)
                packed = [
                    labels.to_numpy().astype(np.int8), np.bincount(flat[kept], minlength=width).astype(np.int32),
                    row[kept].astype(np.min_scalar_type(len(lengths))), bins[kept], np.zeros(len(lengths)),
                ]
                columns = [pa.array([[part, made]], pa.list_(pa.int64()))]
                columns += [pa.array([p.tobytes()], pa.binary()) for p in packed]
                names = ["seed", "labels", "counts", "rows", "bins", "margins"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                made += 1

    return plain.mapInArrow(pack, BLOCK_SCHEMA)


class Block:
    def __init__(self, row: dict):
        self.seed = row["seed"]
        self.labels = np.frombuffer(row["labels"], np.int8)
        self.margins = np.frombuffer(row["margins"], np.float64)
        self.bins = np.frombuffer(row["bins"], np.uint8)
        self.rows = np.frombuffer(row["rows"], f"u{len(row['rows']) // max(len(self.bins), 1) or 1}")
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def dense(self, terms: np.ndarray) -> np.ndarray:
        """Bins of some terms, a row of the block each."""
        made = np.zeros((len(self.labels), len(terms)), np.uint8)
        place = np.zeros(len(self.counts), np.intp)
        place[terms] = np.arange(len(terms))
        flat = made.ravel()
        for row, ids, bins in self.pieces(None if len(terms) == len(self.counts) else terms):
            flat[row.astype(np.intp) * len(terms) + place.take(ids)] = bins
        return made

    def columns(self, terms: np.ndarray) -> np.ndarray:
        """Bins of some terms, a row each: a term's bins lie together."""
        made = np.zeros((len(terms), len(self.labels)), np.uint8)
        for column, term in zip(made, terms):
            part = slice(self.starts[term], self.starts[term + 1])
            column[self.rows[part]] = self.bins[part]
        return made

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of each term and bin begin, and ``term * BINS + bin`` of each."""
        new = np.ones(len(self.bins), dtype=bool)
        np.not_equal(self.bins[1:], self.bins[:-1], out=new[1:])
        new[self.starts[:-1][self.counts > 0]] = True
        begin = np.flatnonzero(new)
        term = np.repeat(np.arange(len(self.counts)), np.diff(np.searchsorted(begin, self.starts)))
        return begin, term * BINS + self.bins.take(begin)

    def pieces(self, terms: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, terms and bins of the entries (of some terms): about ``PIECE`` entries at a time, or one term's."""
        chosen = np.arange(len(self.counts), dtype=np.int32) if terms is None else terms
        counts = self.counts[chosen]
        starts = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.unique([*np.searchsorted(starts, np.arange(0, starts[-1], PIECE)), len(chosen)])
        for first, end in zip(cuts[:-1], cuts[1:]):
            ids = np.repeat(chosen[first:end], counts[first:end])
            if terms is None:
                parts = [slice(self.starts[first], self.starts[end])]
            else:
                parts = [slice(self.starts[term], self.starts[term + 1]) for term in chosen[first:end]]
            yield np.concatenate([self.rows[p] for p in parts]), ids, np.concatenate([self.bins[p] for p in parts])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for i in range(batch.num_rows):
            yield Block({
                name: column[i].as_py() if name == "seed" else column[i].as_buffer() for name, column in columns.items()
            })


def used_terms(trees: list[tuple], width: int) -> tuple[np.ndarray, list[tuple]]:
    """The terms that trees ask for, and the trees with the places of their terms among these."""
    terms = np.unique(np.concatenate([tree[0] for tree in trees]))
    place = np.zeros(width, dtype=np.intp)
    place[terms] = np.arange(len(terms))
    return terms, [(place[tree[0]], *tree[1:]) for tree in trees]


def descend(tree: tuple, columns: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` steps."""
    column, bins, children, *_ = tree
    n = columns.shape[1]
    inner = np.flatnonzero(children[::2] != np.arange(len(bins)))
    if len(inner) <= 4 * depth:
        # Few nodes: each moves its rows, whole columns at a time; children come after their parents.
        at = np.zeros(n, dtype=np.uint8)
        for node in inner:
            step = (columns[column[node]] > bins[node]).view(np.uint8) + np.uint8(children[2 * node] - node)
            at += step * (at == node).view(np.uint8)
        return at.astype(np.intp)
    flat, row, first = columns.ravel(), np.arange(n), column * n
    at = np.zeros(n, dtype=np.intp)
    for _ in range(depth):
        at = children.take(2 * at + (flat.take(first.take(at) + row) > bins.take(at)))
    return at


def poisson_table() -> np.ndarray:
    """How often a row is drawn (Poisson, mean 1), by 16 random bits."""
    chances = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(9)])
    return np.searchsorted(chances, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def as_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def common_bits(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the bits that both rows of words have."""
    both = (left & right).ravel()
    word = np.flatnonzero(both != 0)
    bit = np.flatnonzero(np.unpackbits(both.take(word).view(np.uint8), bitorder="little").view(bool))
    word = word.take(bit >> 6)
    words = left.shape[1]
    return word // words, word % words * 64 + (bit & 63)


# --- growth ----------------------------------------------------------------------------------------
def histograms(
    blocks: DataFrame,
    trees: list[Tree],
    slots: list[tuple[int, int]],
    subsets: np.ndarray | None,
    width: int,
    depth: int,
    weigh: Callable[[Block, int], tuple[np.ndarray | None, np.ndarray]],
) -> DataFrame:
    """Rows ``n`` and targets ``s`` of each slot (tree, node), by term and bin, a row for each task that has some.

    ``subsets`` holds the terms that each slot looks at (all, if None; then rows have no weights). ``weigh`` gives a
    block's weights and weighted targets in a tree (no weights: 1).
    """
    numbers = list(dict.fromkeys(t for t, _ in slots))
    used, shapes = used_terms([trees[t].arrays() for t in numbers], width)
    slot_of = [np.full(len(trees[t].feature), -1, dtype=np.intp) for t in numbers]
    for slot, (t, node) in enumerate(slots):
        slot_of[numbers.index(t)][node] = slot
    terms = width if subsets is None else subsets.shape[1]

    def add_all(block: Block, slot: np.ndarray, targets: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
        """Each slot's entries of all terms; its rows and their targets are added up together, in one sum."""
        begin, keys = block.groups()
        if len(begin) == 0:
            return
        rows = block.rows.astype(np.intp)
        values = targets + (1 << COUNT_BIT)
        for own in np.unique(slot[slot >= 0]):
            sums = np.add.reduceat(np.where(slot == own, values, 0).take(rows), begin)
            counts = (sums + (1 << (COUNT_BIT - 1))) >> COUNT_BIT
            at = keys + own * (width * BINS)
            n[at] += counts
            s[at] += sums - (counts << COUNT_BIT)

    def add_picked(
        whole: tuple, looks: tuple, slot: np.ndarray, inside: np.ndarray, ones: np.ndarray, targets: np.ndarray,
        n: np.ndarray, s: np.ndarray,
    ) -> None:
        """Entries of the terms that a row's slot looks at."""
        (bits, dense), (first, wanted, place) = whole, looks
        own = slot.take(inside) - first
        found, term = common_bits(bits.take(inside, axis=0), wanted.take(own, axis=0))
        row, own = inside.take(found), own.take(found)
        at = (own + first) * terms + place.take(own * width + term)
        key = at * BINS + dense.take(row * width + term)
        np.add.at(n, key, ones.take(row))
        np.add.at(s, key, targets.take(row))

    def looks_of(own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Of a tree's slots, numbered one after the other: the first, their terms as bits, each term's place in each."""
        first, last = own[own >= 0].min(), own.max()
        mine = subsets[first : last + 1]
        place = np.zeros((len(mine), width), dtype=np.int16)
        np.put_along_axis(place, mine, np.arange(terms, dtype=np.int16)[None, :], axis=1)
        flags = np.zeros((len(mine), width), dtype=bool)
        np.put_along_axis(flags, mine, True, axis=1)
        return first, as_bits(flags), place.ravel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = [] if subsets is None else [looks_of(own) for own in slot_of]
        n = np.zeros(len(slots) * terms * BINS, np.int64)
        s = np.zeros_like(n)
        totals = np.zeros((2, len(slots)), np.int64)
        for block in blocks_of(batches):
            columns, whole = block.columns(used), None
            for i, (t, shape, own) in enumerate(zip(numbers, shapes, slot_of)):
                weights, targets = weigh(block, t)
                slot = own.take(descend(shape, columns, depth))
                inside = np.flatnonzero(slot >= 0 if weights is None else (slot >= 0) & (weights > 0))
                if len(inside) == 0:
                    continue
                ones = np.ones(len(slot), np.int64) if weights is None else weights.astype(np.int64)
                np.add.at(totals[0], slot[inside], ones[inside])
                np.add.at(totals[1], slot[inside], targets[inside])
                if subsets is None:
                    add_all(block, slot, targets, n, s)
                    continue
                if whole is None:
                    dense = block.dense(np.arange(width))
                    whole = as_bits(dense > 0), dense.ravel()
                add_picked(whole, looks[i], slot, inside, ones, targets, n, s)
        n, s = n.reshape(len(slots), terms, BINS), s.reshape(len(slots), terms, BINS)
        n[:, :, 0] = totals[0][:, None] - n.sum(axis=2)
        s[:, :, 0] = totals[1][:, None] - s.sum(axis=2)
        slot, where, bins = np.nonzero(n)
        feature = where if subsets is None else subsets[slot, where]
        made = [slot.astype(np.int32), np.asarray(feature, np.int32), bins.astype(np.int32)]
        made += [n[slot, where, bins], s[slot, where, bins]]
        names = ["slot", "feature", "bin", "n", "s"]
        for start in range(0, len(slot), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(m[start : start + 100_000]) for m in made], names=names)

    return blocks.mapInArrow(count, COUNT_SCHEMA)


def best_splits(counts: DataFrame) -> DataFrame:
    """A row for each slot and partition: its rows and targets, and its best split there; ``gain`` is 0 or less where
    none helps.

    The gain is that of variance, and of Gini impurity for targets 0 and 1; ties go to the smaller term and bin.
    """
    # Tasks have counted already, so the counts are dealt once, and the sums stay in place. The number of partitions is
    # given: Spark would merge them into one or two, as a pass has few bytes, and one task would do all the sums.
    cores = counts.sparkSession.sparkContext.defaultParallelism
    dealt = counts.repartition(cores, "slot", "feature")
    summed = dealt.groupBy("slot", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return summed.mapInArrow(best_in_part, BEST_SCHEMA)


def best_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best split of each slot among the terms of a partition, which holds all bins of its terms."""
    parts = list(batches)
    if not parts:
        return
    slot, feature, bins, n, s = (c.to_numpy() for c in pa.Table.from_batches(parts).columns)
    order = np.lexsort((bins, feature, slot))
    slot, feature, bins, n, s = (c[order] for c in (slot, feature, bins, n, s))
    new = np.flatnonzero((np.diff(slot, prepend=-1) != 0) | (np.diff(feature, prepend=-1) != 0))
    sizes = np.diff(np.append(new, len(slot)))

    def sides(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a term has up to each bin, and in all."""
        so_far = np.cumsum(column)
        left = so_far - np.repeat(so_far[new] - column[new], sizes)
        return left, np.repeat(left[new + sizes - 1], sizes)

    def square(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        return s.astype(np.float64) * s.astype(np.float64) / n

    (n_left, n), (s_left, s) = sides(n), sides(s)
    split = n > n_left
    gain = np.full(len(slot), -1.0)
    here = n[split], s[split], n_left[split], s_left[split]
    parts_sum = square(here[3], here[2]) + square(here[1] - here[3], here[0] - here[2])
    found = parts_sum - square(here[1], here[0])
    gain[split] = np.where(found <= parts_sum * LEAST_GAIN, 0.0, found)
    order = np.lexsort((bins, feature, -gain, slot))
    best = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
    columns = [c[best] for c in (slot, n, s, feature, bins, gain, n_left, s_left)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=BEST_TYPES)


def best_of(rows: list) -> list:
    """Of each slot the best row, in order of slots."""
    best: dict[int, tuple] = {}
    for row in rows:
        order = (-row["gain"], row["feature"], row["bin"])
        if row["slot"] not in best or order < best[row["slot"]][0]:
            best[row["slot"]] = (order, row)
    return [best[slot][1] for slot in sorted(best)]


def grow(
    blocks: DataFrame,
    count: int,
    width: int,
    max_depth: int,
    weigh: Callable,
    is_pure: Callable[[int, int], bool],
    terms: int | None = None,
) -> list[Tree]:
    """``count`` trees at once, a level a pass; a node looks at ``terms`` terms picked at random (all, if None)."""
    trees = [Tree() for _ in range(count)]
    open_nodes = [(t, 0) for t in range(count)]
    for depth in range(max_depth):
        following = []
        for start in range(0, len(open_nodes), NODES_PER_PASS):
            slots = open_nodes[start : start + NODES_PER_PASS]
            subsets = None
            if terms is not None:
                subsets = np.array([
                    np.random.default_rng([SEED, t, node]).choice(width, terms, replace=False) for t, node in slots
                ])
            counts = histograms(blocks, trees, slots, subsets, width, depth, weigh)
            for row in best_of(best_splits(counts).collect()):
                t, node = slots[row["slot"]]
                tree = trees[t]
                tree.n[node], tree.s[node] = row["n"], row["s"]
                if row["gain"] <= 0 or (depth == 0 and is_pure(row["n"], row["s"])):
                    continue
                left, right = tree.split(node, row["feature"], row["bin"])
                tree.n[left], tree.s[left] = row["n_left"], row["s_left"]
                tree.n[right], tree.s[right] = row["n"] - row["n_left"], row["s"] - row["s_left"]
                following += [(t, c) for c in (left, right) if not is_pure(tree.n[c], tree.s[c])]
        open_nodes = following
        if not open_nodes:
            break
    return trees


# --- fitted models -----------------------------------------------------------------------------------
@dataclass
class TreeModel:
    """``nodes`` as in an isolation forest, with a leaf's value as its depth. The chance of an anomaly is the mean of
    the values, or what ``scale`` times the mean is on the log-odds scale."""

    nodes: dict[str, np.ndarray]
    width: int
    scale: float | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        return iforest.node_table(self.nodes, spark)

    def chance(self, rows: DataFrame, output: str) -> DataFrame:
        """Add the chance of an anomaly from ``features``."""
        scored = iforest.add_mean(self.nodes, self.width, rows, output)
        if self.scale is None:
            return scored
        return scored.withColumn(output, 1.0 / (1.0 + F.exp(F.col(output) * -self.scale)))


def to_nodes(trees: list[Tree], table: np.ndarray, values: list[list[float]]) -> dict[str, np.ndarray]:
    parts = []
    for t, (tree, value) in enumerate(zip(trees, values)):
        nodes = np.arange(len(tree.feature))
        left = np.array(tree.left)
        leaf = left == nodes
        feature = np.where(leaf, -1, tree.feature)
        threshold = np.where(leaf, 0.0, table[tree.feature, np.minimum(tree.bin, BINS - 2)])
        parts.append(pd.DataFrame({
            "tree": t, "node": nodes, "feature": feature, "threshold": threshold, "left": np.where(leaf, -1, left),
            "right": np.where(leaf, -1, left + 1), "depth": np.where(leaf, value, 0.0),
        }))
    return iforest.from_table(pd.concat(parts), len(table), 0, 0.0).nodes


def _prepared(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Binned blocks kept by Spark, and the thresholds."""
    width = rows.select(F.unwrap_udt("features")["size"].alias("size")).first()["size"]
    n = rows.count()
    table = split_table(rows, n, width)
    # A task of each pass has a fixed cost, so there are no more of them than cores, or than rows make necessary.
    most = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    blocks = binned_blocks(rows.coalesce(most), table, block_rows).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.count()
    return blocks, table


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Blocks reach tasks one or two at a time: a batch of many megabytes is copied again and again as it grows.

    Only for blocks that are made already: how many rows a block has depends on the batches it is made of.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class SparseForest:
    """Random forest of two classes: bootstrap by Poisson weights, the square root of all terms at each node."""

    trees: int = 100
    max_depth: int = 10
    seed: int = SEED

    def fit(self, rows: DataFrame) -> TreeModel:
        blocks, table = _prepared(rows)
        drawn, seed = poisson_table(), self.seed

        def weigh(block: Block, t: int) -> tuple[np.ndarray, np.ndarray]:
            rng = np.random.default_rng([seed, t, *block.seed])
            weights = drawn[rng.integers(0, 65_536, len(block.labels), dtype=np.uint16)]
            return weights, (weights * block.labels).astype(np.int64)

        def is_pure(n: int, s: int) -> bool:
            return s == 0 or s == n

        terms = math.ceil(math.sqrt(len(table)))
        with small_batches(rows.sparkSession):
            grown = grow(blocks, self.trees, len(table), self.max_depth, weigh, is_pure, terms)
        blocks.unpersist()
        for tree in grown:
            merge_alike(tree)
        shares = [[s / n if n else 0.0 for n, s in zip(tree.n, tree.s)] for tree in grown]
        return TreeModel(to_nodes(grown, table, shares), len(table))


def merge_alike(tree: Tree) -> None:
    """Make a leaf of each node whose children are leaves of the same class, from the bottom up, as Spark's forest does."""
    for node in reversed(range(len(tree.left))):
        if tree.is_leaf(node):
            continue
        left, right = tree.left[node], tree.left[node] + 1
        if tree.is_leaf(left) and tree.is_leaf(right):
            if (2 * tree.s[left] > tree.n[left]) == (2 * tree.s[right] > tree.n[right]):
                tree.feature[node], tree.bin[node], tree.left[node] = 0, BINS, node


@dataclass
class SparseBoosting:
    """Gradient boosting of log loss: the first tree fits labels -1 and 1, others what is left of them, at ``step``."""

    rounds: int = 100
    max_depth: int = 3
    step: float = 0.1

    def fit(self, rows: DataFrame) -> TreeModel:
        blocks, table = _prepared(rows, MOST_ROWS)
        with small_batches(rows.sparkSession):
            return self._fit(blocks, table)

    def _fit(self, blocks: DataFrame, table: np.ndarray) -> TreeModel:
        width, grown, values = len(table), [], []
        recent: list[tuple] = []
        for done in range(self.rounds):
            (tree,) = grow(blocks, 1, width, self.max_depth, residuals(recent, width, self.max_depth, done == 0), never)
            rate = 1.0 if done == 0 else self.step
            value = [rate * s / (n * UNIT) if n else 0.0 for n, s in zip(tree.n, tree.s)]
            grown.append(tree)
            values.append(value)
            recent.append((*tree.arrays(), np.array(value)))
            if len(recent) == MARGIN_ROUNDS and done + 1 < self.rounds:
                moved = add_margins(blocks, recent, width, self.max_depth).persist(StorageLevel.MEMORY_AND_DISK)
                moved.count()
                blocks.unpersist()
                blocks, recent = moved, []
        blocks.unpersist()
        return TreeModel(to_nodes(grown, table, values), width, 2.0 * self.rounds)


def never(n: int, s: int) -> bool:
    return False


def margins(block: Block, used: np.ndarray, recent: list[tuple], max_depth: int) -> np.ndarray:
    """A block's sums over all trees: the stored ones and those of the ``recent`` trees."""
    columns, made = block.columns(used), block.margins
    for tree in recent:
        made = made + tree[3].take(descend(tree, columns, max_depth))
    return made


def residuals(recent: list[tuple], width: int, max_depth: int, first: bool) -> Callable:
    used, placed = used_terms(recent, width) if recent else (np.empty(0, np.int64), [])

    def weigh(block: Block, _: int) -> tuple[None, np.ndarray]:
        sign = 2.0 * block.labels - 1.0
        if first:
            return None, np.rint(sign * UNIT).astype(np.int64)
        left = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margins(block, used, placed, max_depth)))
        return None, np.rint(left * UNIT).astype(np.int64)

    return weigh


def add_margins(blocks: DataFrame, recent: list[tuple], width: int, max_depth: int) -> DataFrame:
    used, placed = used_terms(recent, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [margins(block, used, placed, max_depth).tobytes() for block in blocks_of(iter([batch]))]
            place = batch.schema.get_field_index("margins")
            yield batch.set_column(place, "margins", pa.array(sums, pa.binary()))

    return blocks.mapInArrow(add, BLOCK_SCHEMA)
