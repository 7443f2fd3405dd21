"""Hard negatives by Fagin's threshold algorithm on integer inner products.

Rows are cut into blocks; each block keeps a list of its rows for every dimension, sorted by that component.
An anchor reads these lists side by side, each from the end its own component's sign asks for, a few places at
a time. A row met first is scored at once (random access). The threshold is the inner product of the anchor with
the components at the places reached: no row not yet met can score more. An anchor leaves a block as soon as
the threshold is strictly below the k-th score of each of its windows, or below a window's least score.

Two passes use the same search. The first finds an anchor's positives among rows of its label. Each positive's score
opens a window below it, and the second fills the windows with rows of other labels.

Anchors are a fixed share of all rows, so both passes are anchors against rows: tiles of a group of anchors and a
span of blocks. A task streams a tile: the group's anchors first, then block by block, so that it holds one
group and one block and each block is met with the k-th scores of the blocks before. Spans are at most ``SPANS``, whatever
the number of rows, so an anchor gets at most ``SPANS`` partial answers, which Spark ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.session import stage

#: Rows of a block, anchors of a group, spans of blocks at most.
BLOCK, GROUP, SPANS = 2048, 4096, 64
#: Places that an anchor reads of every list at first; each further round goes four times as deep.
FIRST_DEPTH = 8
#: Scaled components beyond this take no part: sums of 4,096 products of such would leave the long range.
LARGEST = 1 << 25
#: Scores below this are exact in double precision.
EXACT = 1 << 53
NO_LIMIT = 1 << 62

KEPT_DDL = "label bigint, vec_id bigint, vector array<int>"
BLOCKS_DDL = "block bigint, ids binary, labels binary, matrix binary, width int"
MATCHES_DDL = "anchor bigint, wanted int, match_id bigint, score bigint"


def scaled_rows(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``label, vec_id, vector``: components as ``floor(scale * x)``; rows that cannot be scored are left out.

    Left out: a null id, label or vector, any null or non-finite component, and a component whose scaled
    value is beyond ``LARGEST``. An empty vector scores 0 with every other. Shorter vectors count as if
    they ended in zeros.
    """
    own = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale <= LARGEST - 1),
    )
    rows = vectors.select(
        label.cast("bigint").alias("label"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding")
    )
    kept = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.select("label", "vec_id", own.cast("array<int>").alias("vector"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of integers as rows, the shorter ones filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), np.int32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def row_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most ``BLOCK`` rows, written once. Rows of a label lie together as far as a partition reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                matrix = _matrix(own.column(2))
                ids, labels = (own.column(i).to_numpy(zero_copy_only=False) for i in (1, 0))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([0], pa.int64()), "ids": [ids.astype("<i8").tobytes()], "labels": [labels.astype("<i8").tobytes()],
                    "matrix": [matrix.astype("<i4").tobytes()], "width": pa.array([matrix.shape[1]], pa.int32()),
                })

    blocks = rows.sortWithinPartitions("label").mapInArrow(run, BLOCKS_DDL)
    return stage(blocks.withColumn("block", F.monotonically_increasing_id()), "row-blocks")


class Lists:
    """Rows of a block with a list for each dimension, sorted by the component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels = ids, labels
        self.matrix = matrix.astype(float) if _all_exact(matrix) else matrix.astype(np.int64)
        self.order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.matrix, self.order, axis=0)

    def __len__(self) -> int:
        return len(self.ids)


def _all_exact(matrix: np.ndarray) -> bool:
    """Whether products with any anchor of this size stay exact as doubles."""
    largest = int(np.abs(matrix.astype(np.int64)).max(initial=0))
    return matrix.shape[1] * largest * LARGEST < EXACT


class Best:
    """The first ``k`` rows of each window: highest scores first, ties to the smaller id."""

    def __init__(self, windows: np.ndarray, k: int):
        #: Least and largest score of each window.
        self.windows, self.k = windows, k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor, self.ceiling = int(windows[:, 0].min()), int(windows[:, 1].max())

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.floor) & (scores <= self.ceiling)
        if not inside.any():
            return
        scores, ids = np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        needed = np.zeros(len(ids), bool)
        for least, largest in self.windows:
            first, end = np.searchsorted(-scores, [-largest, -least + 1])
            needed[first : min(first + self.k, end)] = True
        self.scores, self.ids = scores[needed], ids[needed]

    def of(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        least, largest = self.windows[window]
        first, end = np.searchsorted(-self.scores, [-largest, -least + 1])
        end = min(first + self.k, end)
        return self.scores[first:end], self.ids[first:end]

    def enough(self) -> int:
        """Once the threshold is below this, no window can change."""
        limit = NO_LIMIT
        for i, (least, _) in enumerate(self.windows):
            scores, _ = self.of(i)
            limit = min(limit, int(scores[-1]) if len(scores) == self.k else int(least))
        return limit


def threshold_search(lists: Lists, anchor: np.ndarray, wanted: np.ndarray | None, best: Best) -> int:
    """Fagin's algorithm for one anchor on one block; the number of rows that were scored.

    ``wanted`` marks the rows that may answer (all, if None).
    """
    n = len(lists)
    width = min(len(anchor), lists.matrix.shape[1])
    up = np.flatnonzero(anchor[:width] > 0)
    down = np.flatnonzero(anchor[:width] < 0)
    weights = anchor[:width].astype(lists.matrix.dtype)
    met = np.zeros(n, bool)
    reached, depth, scored = 0, FIRST_DEPTH, 0
    while True:
        # The threshold of the places read so far; before the first it is that of the lists' ends.
        place = max(reached - 1, 0)
        threshold = weights[up] @ lists.values[n - 1 - place, up] + weights[down] @ lists.values[place, down]
        if threshold < best.enough():
            return scored
        if reached == n or (not len(up) and not len(down)):
            break
        end = min(depth, n)
        fresh = np.zeros(n, bool)
        fresh[lists.order[n - end : n - reached, up]] = True
        fresh[lists.order[reached:end, down]] = True
        fresh &= ~met
        met |= fresh
        reached, depth = end, depth * 4
        scored += _score(lists, weights, fresh if wanted is None else fresh & wanted, best)
        if met.all():
            return scored
    # An anchor without any component of its own scores 0 with all rows, which no list leads to.
    rest = ~met if wanted is None else ~met & wanted
    return scored + _score(lists, weights, rest, best)


def _score(lists: Lists, weights: np.ndarray, rows: np.ndarray, best: Best) -> int:
    at = np.flatnonzero(rows)
    if len(at):
        best.add((lists.matrix[at, : len(weights)] @ weights).astype(np.int64), lists.ids[at])
    return len(at)


class Group:
    """Anchors of a tile, each with its windows and what was found so far."""

    def __init__(self, k: int, same_label: bool):
        self.k, self.same_label = k, same_label
        self.anchors: list[tuple[int, int, int, np.ndarray, np.ndarray, Best]] = []

    def add(self, key: int, vec_id: int, label: int, vector: np.ndarray, windows: np.ndarray) -> None:
        if len(windows):
            self.anchors.append((key, vec_id, label, vector, windows, Best(windows, self.k)))

    def meet(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        if self.same_label:
            # Only rows of an anchor's label are listed for it; a block holds them side by side.
            by_label: dict[int, Lists | None] = {}
            for _, vec_id, label, vector, _, best in self.anchors:
                if label not in by_label:
                    own = np.flatnonzero(labels == label)
                    by_label[label] = Lists(ids[own], labels[own], matrix[own]) if len(own) else None
                if lists := by_label[label]:
                    others = lists.ids != vec_id
                    threshold_search(lists, vector, None if others.all() else others, best)
        elif len(ids):
            lists = Lists(ids, labels, matrix)
            for _, _, label, vector, _, best in self.anchors:
                others = labels != label
                if others.any():
                    threshold_search(lists, vector, None if others.all() else others, best)

    def matches(self) -> Iterator[pa.RecordBatch]:
        keys, wanted, found_ids, found_scores = [], [], [], []
        for key, _, _, _, windows, best in self.anchors:
            for i in range(len(windows)):
                scores, ids = best.of(i)
                keys += [key] * len(ids)
                wanted += [i] * len(ids)
                found_ids.append(ids)
                found_scores.append(scores)
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(wanted, pa.int32()), pa.array(np.concatenate(found_ids)), pa.array(np.concatenate(found_scores))],
                ["anchor", "wanted", "match_id", "score"],
            )


def search_tiles(anchors: DataFrame, blocks: DataFrame, n_anchors: int, n_blocks: int, k: int, same_label: bool) -> DataFrame:
    """``anchor, wanted, match_id, score``: the first ``k`` matches of each window in each span of blocks.

    ``anchors``: ``anchor, vec_id, label, vector, windows`` (least and largest score of each).
    """
    groups, spans = max(1, -(-n_anchors // GROUP)), max(1, min(SPANS, n_blocks))
    nothing = {"ids": "binary", "labels": "binary", "matrix": "binary", "width": "int"}
    left = anchors.select(
        F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("bigint").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("s"), F.lit(0).alias("kind"),
        "anchor", "vec_id", "label", "vector", "windows", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()],
    )
    own = {"anchor": "bigint", "vec_id": "bigint", "label": "bigint", "vector": "array<int>", "windows": "array<array<bigint>>"}
    right = blocks.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"),
        F.pmod(F.xxhash64("block"), F.lit(spans)).cast("int").alias("s"), F.lit(1).alias("kind"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in own.items()], *nothing,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, group = None, Group(k, same_label)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                here = row["g"][0], row["s"][0]
                if here != tile:
                    yield from group.matches()
                    tile, group = here, Group(k, same_label)
                if row["kind"][0] == 0:
                    vector = np.array(row["vector"][0], np.int64)
                    group.add(row["anchor"][0], row["vec_id"][0], row["label"][0], vector, np.array(row["windows"][0], np.int64).reshape(-1, 2))
                else:
                    ids, labels = (np.frombuffer(row[name][0], "<i8") for name in ("ids", "labels"))
                    group.meet(ids, labels, np.frombuffer(row["matrix"][0], "<i4").reshape(len(ids), row["width"][0]))
        yield from group.matches()

    # Several partitions a tile, so that a task seldom gets two.
    dealt = left.unionByName(right).repartition(min(4 * groups * spans, 100_000), "g", "s")
    return dealt.sortWithinPartitions("g", "s", "kind").mapInArrow(run, MATCHES_DDL)


def first_matches(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` matches of each window over all spans, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "match_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    label: Column,
    is_anchor: Callable[[Column], Column],
    positives: int = 5,
    negatives: int = 5,
    scale: int = 256,
    least_percent: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vec_id, embedding`` rows.

    An anchor's positives are the first ``positives`` rows of its label with another id; the negatives of each
    are the first ``negatives`` rows of other labels whose score is ``least_percent`` to 100 % of the
    positive's. First: highest score, ties by smaller id. A positive with a score below 0 has no such
    window and no negatives; one of score 0 takes rows of score 0. ``scaled_rows`` says which rows take no part. Rows that
    repeat, or share an id, are rows of their own and come back as often as they come. Columns other than
    ``vec_id``, ``embedding`` and those of ``label`` play no part. Without anchors, positives or negatives there are no rows.
    """
    rows = stage(scaled_rows(vectors, label, scale), "scaled-vectors")
    blocks = row_blocks(rows)
    anchors = stage(rows.where(is_anchor(F.col("vec_id"))).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_anchors, n_blocks = anchors.count(), blocks.count()
    everything = F.array(F.array(F.lit(-NO_LIMIT).cast("bigint"), F.lit(NO_LIMIT).cast("bigint")))
    found = search_tiles(anchors.withColumn("windows", everything), blocks, n_anchors, n_blocks, positives, True)
    chosen = first_matches(found, positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("match_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives")
    )
    opened = stage(anchors.join(chosen, "anchor"), "positives")
    # An impossible window keeps a positive's place where its score is below 0.
    window = F.expr(f"""transform(positives, p -> if(p.positive_score < 0, array({NO_LIMIT}L, {NO_LIMIT}L),
        array((p.positive_score * {least_percent} + 99) div 100, p.positive_score)))""")
    asked = opened.withColumn("windows", window)
    mined = first_matches(search_tiles(asked, blocks, n_anchors, n_blocks, negatives, False), negatives)
    pairs = opened.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("wanted", "positive"))
    return mined.join(pairs, ["anchor", "wanted"]).select(
        "anchor_id", F.col("positive.positive_id").alias("positive_id"), "rank", F.col("match_id").alias("negative_id"),
        F.col("positive.positive_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
