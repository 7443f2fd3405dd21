"""The tree learners on sparse rows against Spark's own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from logwarden.operators import trees
from logwarden.operators.models import Models, load_models, save_models, training_set
from logwarden.functions.fixed_values import BOOTSTRAP_LINES
from logwarden.plans.training import label_lines

WIDTH = 40
SCHEMA = StructType([
    StructField("line_no", LongType()), StructField("label", DoubleType()), StructField("features", VectorUDT()),
])


@pytest.fixture(scope="module")
def spark(spark):
    """A session of its own: tasks cannot take along one that has observed a table, and the models of Spark's forest
    hold their session."""
    return spark.newSession()


def chances(model, rows):
    if isinstance(model, trees.TreeModel):
        found = model.chance(rows, "chance")
    else:
        found = model.transform(rows).withColumn("chance", vector_to_array("probability")[1])
    return np.array([r["chance"] for r in found.orderBy("line_no").select("chance").collect()])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = []
    for i in range(400):
        ids = np.sort(rng.choice(WIDTH, rng.integers(0, 9), replace=False))
        vector = SparseVector(WIDTH, ids.tolist(), rng.uniform(0.05, 1, len(ids)).tolist())
        score = 3 * vector[1] + 2 * vector[2] * vector[5] - vector[7] + rng.normal(0, 0.1)
        made.append((i, float(score > 0.2), vector))
    return spark.createDataFrame(made, SCHEMA).repartition(3).persist()


def test_boosting_equals_sparks(rows):
    own = trees.SparseBoosting(rounds=12).fit(rows)
    sparks = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
    assert np.abs(chances(own, rows) - chances(sparks, rows)).max() < 1e-6


def test_boosting_ignores_partitioning(rows):
    one, five = (trees.SparseBoosting(rounds=4).fit(rows.repartition(k)) for k in (1, 5))
    for name, values in one.nodes.items():
        assert np.array_equal(values, five.nodes[name])


def test_forest_is_like_sparks(rows):
    own = chances(trees.SparseForest(trees=60).fit(rows), rows)
    sparks = chances(RandomForestClassifier(numTrees=60, maxDepth=10, seed=42).fit(rows), rows)
    assert np.abs(own - sparks).mean() < 0.05
    assert ((own >= 0.5) == (sparks >= 0.5)).mean() > 0.95


def test_rows_take_space_for_the_terms_they_have(spark):
    width = 5_000
    made = [(i, float(i % 2), SparseVector(width, [i % 7, 100 + i % 3], [0.5, 0.25])) for i in range(3_000)]
    rows = spark.createDataFrame(made, SCHEMA).coalesce(1)
    table = trees.split_table(rows, len(made), width)
    blocks = trees.binned_blocks(rows, table).collect()
    size = sum(len(b[c]) for b in blocks for c in ("labels", "counts", "rows", "bins", "margins"))
    assert sum(np.frombuffer(b["labels"], np.int8).sum() for b in blocks) == 1_500
    assert size < 40 * len(made)


def test_bins_are_sparks_thresholds():
    values, counts = np.arange(1.0, 101.0), np.ones(100, int)
    table = np.full((1, 31), np.inf)
    found = trees.find_splits(values, counts, 150)
    table[0, : len(found)] = found
    assert found[0] == 0.5 and found == sorted(found) and len(found) <= 31
    inside = np.concatenate([[0.0], found, values])
    assert trees.bin_of(table, np.zeros(len(inside), int), inside).tolist() == np.searchsorted(found, inside).tolist()
    assert trees.find_splits(np.array([2.0]), np.array([5]), 5) == []


def test_models_that_spark_fitted_still_load(spark, lines, tmp_path):
    frame, path = lines(BOOTSTRAP_LINES), str(tmp_path / "models")
    training = training_set(frame, label_lines(frame))
    sparks = RandomForestClassifier(numTrees=3, seed=1).fit(training.rows)
    save_models(Models(training.features, {"random_forest": sparks}), spark, path)
    pointer = spark.read.parquet(f"{path}/current").drop("trees", "scale").localCheckpoint()
    pointer.write.mode("overwrite").parquet(f"{path}/current")
    assert load_models(spark, path).fitted["random_forest"].getNumTrees == 3


def test_few_counts_are_summed_by_all_cores(rows, spark):
    blocks, table = trees._prepared(rows)
    weigh = trees.residuals([], len(table), 3, True)
    counts = trees.histograms(blocks, [trees.Tree()], [(0, 0)], None, len(table), 0, weigh)
    assert trees.best_splits(counts).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_blocks_are_read_by_few_tasks_and_one_by_one(rows, spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    blocks, _ = trees._prepared(rows.repartition(40))
    assert blocks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    wide = blocks.withColumn("labels", F.repeat(F.lit("x"), 2 * trees.BATCH_BYTES).cast("binary")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield trees.pa.RecordBatch.from_arrays([trees.pa.array([batch.num_rows])], names=["n"])

    with trees.small_batches(spark):
        assert {r["n"] for r in wide.mapInArrow(sizes, "n bigint").collect()} == {1}
    assert spark.conf.get(name) == before
    blocks.unpersist()


def test_common_bits_are_those_of_both():
    rng = np.random.default_rng(7)
    left, right = rng.random((50, 130)) < 0.3, rng.random((50, 130)) < 0.1
    found = trees.common_bits(trees.as_bits(left), trees.as_bits(right))
    assert [list(f) for f in found] == [list(f) for f in np.nonzero(left & right)]


def test_few_and_many_nodes_lead_rows_alike():
    rng = np.random.default_rng(8)
    columns = rng.integers(0, 4, (9, 500), dtype=np.uint8)
    tree, leaves = trees.Tree(), [0]
    for depth in range(1, 6):
        leaves = [c for leaf in leaves for c in tree.split(leaf, int(rng.integers(9)), int(rng.integers(3)))]
        at = np.zeros(500, int)
        for _ in range(depth):
            at = np.array([
                node if tree.is_leaf(node) else tree.left[node] + int(columns[tree.feature[node], i] > tree.bin[node])
                for i, node in enumerate(at)
            ])
        assert np.array_equal(trees.descend(tree.arrays(), columns, depth), at)


def test_packed_sums_are_exact(rows):
    blocks, table = trees._prepared(rows, trees.MOST_ROWS)
    width = len(table)
    largest = np.array([4, -4, 3, -1]) * int(trees.UNIT)

    def weigh(block, t):
        return None, np.resize(largest, len(block.labels))

    tree = trees.Tree()
    tree.split(0, 1, 3)
    wanted = {}
    for b in map(lambda b: trees.Block(b.asDict()), blocks.collect()):
        dense, targets = b.dense(np.arange(width)).astype(int), weigh(b, 0)[1]
        for row in range(len(dense)):
            slot = int(dense[row, 1] > 3)
            for term in range(width):
                n, s = wanted.get((slot, term, dense[row, term]), (0, 0))
                wanted[(slot, term, dense[row, term])] = n + 1, s + int(targets[row])
    found = trees.histograms(blocks, [tree], [(0, 1), (0, 2)], None, width, 1, weigh)
    summed = found.groupBy("slot", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    assert {(r["slot"], r["feature"], r["bin"]): (r["n"], r["s"]) for r in summed} == wanted
    blocks.unpersist()


def test_best_split_of_each_node(spark):
    rng = np.random.default_rng(5)
    counts = [
        (slot, term, bin, int(rng.integers(1, 9)), int(rng.integers(-20, 20)) << 32)
        for slot in range(3) for term in range(7) for bin in range(4) if bin == 0 or rng.random() < 0.7
    ]
    counts += [(3, 0, 0, 5, 5)]  # one bin: no split
    twice = spark.createDataFrame(counts + counts, trees.COUNT_SCHEMA)
    found = trees.best_of(trees.best_splits(twice).collect())
    assert [row["slot"] for row in found] == [0, 1, 2, 3]
    for row in found:
        options = []
        for term in range(7):
            held = [c for c in counts if c[0] == row["slot"] and c[1] == term]
            n, s = sum(2 * c[3] for c in held), sum(2 * c[4] for c in held)
            for bin in [c[2] for c in held]:
                left = [c for c in held if c[2] <= bin]
                n_left, s_left = sum(2 * c[3] for c in left), sum(2 * c[4] for c in left)
                gain = -1.0 if n == n_left else s_left**2 / n_left + (s - s_left) ** 2 / (n - n_left) - s**2 / n
                options.append((-gain, term, bin, n, s, n_left, s_left))
        gain, *best = min(options)
        assert [row[c] for c in ("feature", "bin", "n", "s", "n_left", "s_left")] == best
        assert row["gain"] == pytest.approx(-gain)


def test_pieces_hold_every_entry_once():
    rng = np.random.default_rng(6)
    ids = np.sort(rng.integers(3, 60, 20_000))
    row = {
        "seed": [0, 0], "labels": np.zeros(900, np.int8).tobytes(), "margins": np.zeros(900).tobytes(),
        "rows": rng.integers(0, 900, len(ids), dtype=np.int32).tobytes(),
        "bins": rng.integers(1, 32, len(ids), dtype=np.uint8).tobytes(),
        "counts": np.bincount(ids, minlength=64).astype(np.int32).tobytes(),
    }
    block = trees.Block(row)
    pieces = list(block.pieces())
    assert len(pieces) > 2
    for column, whole in zip(zip(*pieces), (block.rows, ids, block.bins)):
        assert np.array_equal(np.concatenate(column), whole)
    empty = trees.Block(row | {"rows": b"", "bins": b"", "counts": np.zeros(64, np.int32).tobytes()})
    assert list(empty.pieces()) == []


def test_forest_counts_the_terms_that_a_node_asks_for(rows):
    width = WIDTH
    table = trees.split_table(rows, 400, width)
    blocks = trees.binned_blocks(rows, table).persist()
    held = [trees.Block(b.asDict()) for b in blocks.collect()]
    dense = np.concatenate([b.dense(np.arange(width)) for b in held])
    labels = np.concatenate([b.labels for b in held]).astype(int)

    def weigh(block, t):
        return np.ones(len(block.labels), np.uint8), block.labels.astype(np.int64)

    grown = [trees.Tree(), trees.Tree()]
    for t, term in enumerate((3, 1)):
        grown[t].split(0, term, 5)
    rng = np.random.default_rng(2)
    # All nodes of two trees, and (found by another way, as few rows are in it) one node alone.
    for slots in ([(0, 1), (0, 2), (1, 1), (1, 2)], [(1, 2)]):
        for terms in (1, 7):
            subsets = np.array([rng.choice(width, terms, replace=False) for _ in slots])
            found = trees.histograms(blocks, grown, slots, subsets, width, 1, weigh)
            summed = found.groupBy("slot", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
            wanted = {}
            for i, (t, node) in enumerate(slots):
                inside = np.flatnonzero((dense[:, grown[t].feature[0]] > 5) == (node == 2))
                for term in subsets[i]:
                    for row in inside:
                        n, s = wanted.get((i, int(term), int(dense[row, term])), (0, 0))
                        wanted[(i, int(term), int(dense[row, term]))] = n + 1, s + labels[row]
            assert {(r["slot"], r["feature"], r["bin"]): (r["n"], r["s"]) for r in summed} == wanted
    blocks.unpersist()
