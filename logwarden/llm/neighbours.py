"""Nearest neighbours by inner product along shifted Hilbert curves.

Each curve has its own random projection to a few dimensions and its own shift of the grid; Spark sorts all
vectors along it by range partitioning. What lies near a query on some curve is a candidate: all blocks of the
curve that reach into a window on either side of the query's block. Candidates are scored on the original
vectors, block against block, and the best of all curves are merged.

For inner products a vector x is placed at (x, sqrt(M^2 - |x|^2)) / M, M being the largest length, and a query q
at (q, 0) / |q|: there the nearest point has the largest inner product.

The window is a share of all vectors. Vectors without structure need a wide one for a high recall, so the work
grows with queries times vectors as a scan's does; where vectors cluster, a small share does.

Equal vectors are searched once, by their least id; the least ids of each, no more than a query can ask for,
come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.session import stage

#: Orderings, dimensions of a projection and bits of a coordinate.
CURVES, DIMENSIONS, BITS = 12, 6, 8
#: Vectors of a block.
BLOCK = 1024
#: Window on each side: this share of the vectors, and no fewer than so many.
WINDOW_SHARE, WINDOW_LEAST = 0.05, 512

BLOCKS_DDL = "curve int, part int, seq int, n bigint, ids binary, vectors binary, asking binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transposed form)."""
    x = cells.astype(np.uint32).copy()
    n, d = x.shape
    bit = 1 << (bits - 1)
    while bit > 1:
        below = np.uint32(bit - 1)
        for i in range(d):
            high = (x[:, i] & np.uint32(bit)) > 0
            swap = np.where(high, np.uint32(0), (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            if i:
                x[:, i] ^= swap
        bit >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[:, d - 1] & np.uint32(bit)) > 0, np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


@dataclass(frozen=True)
class Curves:
    """Projections, grid scales and shifts of all curves for vectors of one size."""

    size: int
    longest: float
    seed: int
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        d = min(DIMENSIONS, self.size + 1)
        turned = [np.linalg.qr(rng.normal(size=(self.size + 1, d)))[0] for _ in range(CURVES)]
        return np.concatenate(turned, axis=1), rng.uniform(size=CURVES * d)

    def placed(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        if queries:
            return np.concatenate([vectors / lengths[:, None], np.zeros((len(vectors), 1))], axis=1)
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - (lengths / self.longest) ** 2))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def keys(self, projected: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Curve keys, a column per curve: standard scores from -4 to 4 and a shift of up to 1 on a grid."""
        z = (projected - self.centre) / self.spread
        cells = np.clip((z + 4 + shifts) / 9 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        cells = cells.reshape(len(z), CURVES, -1)
        return np.stack([hilbert_keys(cells[:, c], BITS) for c in range(CURVES)], axis=1)


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part, ids once.

    Left out: null ids and vectors; empty or zero ones; null, infinite or NaN components; sizes other than the
    largest. Of rows with equal ids the least vector counts.
    """
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    good = slim.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & some)
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _curves(spark: SparkSession, vectors: DataFrame, seed: int) -> Curves:
    """The curves for these vectors; scales from sums over all of them, one row a task."""
    row = vectors.agg(F.max(F.size("vector")).alias("size"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    curves = Curves(row["size"], row["longest"], seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, _ = curves.projections()
        n, sums, squares = 0, np.zeros(turned.shape[1]), np.zeros(turned.shape[1])
        for batch in batches:
            z = curves.placed(_matrix(batch.column(0), curves.size), False) @ turned
            n, sums, squares = n + len(z), sums + z.sum(axis=0), squares + (z * z).sum(axis=0)
        axis = np.arange(len(sums), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(axis), pa.array(np.full(len(sums), n)), pa.array(sums), pa.array(squares)], ["axis", "n", "total", "squares"]
        )

    parts = vectors.select("vector").mapInArrow(run, "axis int, n bigint, total double, squares double")
    rows = parts.groupBy("axis").agg(F.sum("n"), F.sum("total"), F.sum("squares")).orderBy("axis").collect()
    n, total, squares = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    centre = total / n
    spread = np.sqrt(np.maximum(squares / n - centre**2, 0))
    return Curves(curves.size, curves.longest, seed, centre, np.where(spread > 1e-9, spread, 1.0))


def _blocks(vectors: DataFrame, curves: Curves) -> DataFrame:
    """Blocks along each curve: ids and vectors of data, and the vectors of queries that lie among them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned, shifts = curves.projections()
        for batch in batches:
            x = _matrix(batch.column(1), curves.size)
            ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for queries, chosen in ((False, np.ones(len(ids), bool)), (True, asks)):
                if not chosen.any():
                    continue
                own = x[chosen]
                keys = curves.keys(curves.placed(own, queries) @ turned, shifts)
                packed = pa.array([v.tobytes() for v in own], pa.binary())
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), c, np.int32)), pa.array(keys[:, c]), pa.array(ids[chosen]), pa.array(np.full(len(own), queries)), packed],
                        ["curve", "key", "id", "asks", "vector"],
                    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            data = sorted((r for r in held if not r[2]), key=lambda r: r[1])
            asking = [r for r in held if r[2]]
            row = {
                "curve": held[0][0], "part": part, "seq": seq, "n": len(data),
                "ids": np.array([r[1] for r in data], np.int64).tobytes(), "vectors": b"".join(r[3] for r in data),
                "asking": np.array([r[1] for r in asking], np.int64).tobytes() + b"".join(r[3] for r in asking),
            }
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("curve", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()),
                ("ids", pa.binary()), ("vectors", pa.binary()), ("asking", pa.binary()),
            ]))

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("curve", "id", "asks", "vector")]
            for row in zip(*columns, strict=True):
                if held and (len(held) >= BLOCK or held[0][0] != row[0]):
                    yield block()
                    seq, held = seq + 1, []
                held.append(row)
        if held:
            yield block()

    order = ["curve", "key", "id"]
    keyed = vectors.select("id", "vector", "asks").mapInArrow(spread, "curve int, key bigint, id bigint, asks boolean, vector binary")
    return stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order, "asks").mapInArrow(pack, BLOCKS_DDL), "blocks")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller id (columns ascend by id)."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, axis=1), ids[order] if ids.ndim == 1 else np.take_along_axis(ids, order, axis=1)


def _candidates(blocks: DataFrame, size: int, window: int, k: int) -> DataFrame:
    """``query, id, score``: the best of each query on each curve."""
    along = Window.partitionBy("curve").orderBy("part", "seq")
    # One row per block: its ranks on the curve.
    ranks = blocks.select("curve", "part", "seq", "n", (F.length("asking") > 0).alias("asks")).withColumn("end", F.sum("n").over(along)).withColumn("begin", F.col("end") - F.col("n"))
    asking = ranks.where("asks").select("curve", F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), F.col("begin").alias("q_begin"), F.col("end").alias("q_end"))
    tiles = ranks.where("n > 0").join(asking, "curve").where(
        (F.col("end") > F.col("q_begin") - window) & (F.col("begin") < F.col("q_end") + window)
    ).select("curve", "part", "seq", "q_part", "q_seq")
    queries = blocks.select("curve", F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), "asking")
    pairs = tiles.join(queries, ["curve", "q_part", "q_seq"]).join(blocks.select("curve", "part", "seq", "ids", "vectors"), ["curve", "part", "seq"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("curve", "q_part", "q_seq", "asking", "ids", "vectors")}
                n = len(row["asking"]) // (8 + 8 * size)
                q = np.frombuffer(row["asking"], np.float64, offset=8 * n).reshape(n, size)
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, size)
                best, ids = _best(q @ x.T, np.frombuffer(row["ids"], np.int64), k)
                out = {c: row[c] for c in ("curve", "q_part", "q_seq")} | {"asked": row["asking"][: 8 * n], "scores": best.tobytes(), "found": ids.tobytes()}
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([
                    ("curve", pa.int32()), ("q_part", pa.int32()), ("q_seq", pa.int32()), ("asked", pa.binary()), ("scores", pa.binary()), ("found", pa.binary()),
                ]))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        asked = np.frombuffer(rows[0]["asked"], np.int64)
        scores = np.concatenate([np.frombuffer(r["scores"], np.float64).reshape(len(asked), -1) for r in rows], axis=1)
        ids = np.concatenate([np.frombuffer(r["found"], np.int64).reshape(len(asked), -1) for r in rows], axis=1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        best, found = _best(np.take_along_axis(scores, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1), k)
        return pa.table({"query": np.repeat(asked, best.shape[1]), "id": found.ravel(), "score": best.ravel()})

    scored = pairs.mapInArrow(score, "curve int, q_part int, q_seq int, asked binary, scores binary, found binary")
    return scored.groupBy("curve", "q_part", "q_seq").applyInArrow(merge, "query bigint, id bigint, score double")


def nearest(
    spark: SparkSession, rows: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20,
    window_share: float = WINDOW_SHARE, seed: int = 1,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found among all other vectors.

    ``is_query`` is a condition on ``vec_id``. Fewer candidates give fewer rows; no usable vectors none.
    """
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = usable(rows).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.hash("embedding"))
    good = stage(good, "vectors")
    size = good.agg(F.max(F.size("embedding"))).first()[0]
    if size is None:
        return empty
    good = good.where(F.size("embedding") == size)
    order = Window.partitionBy("h", "g").orderBy("vec_id")
    placed = good.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    members = stage(placed.select("h", "g", "vec_id", F.col("nth"), "embedding"), "members")
    firsts = members.where("nth = 1").select("h", "g", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = good.where(is_query).select(F.col("vec_id").alias("query_id"), "h", "g")
    asked = queries.select("h", "g").distinct().withColumn("asks", F.lit(True))
    vectors = stage(firsts.join(asked, ["h", "g"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "distinct")
    n = vectors.count()
    window = max(WINDOW_LEAST, -int(-window_share * n // 1))
    found = _candidates(_blocks(vectors, _curves(spark, vectors, seed)), size, window, k + 1)
    merged = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    best = merged.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
    # From distinct vectors back to ids, on both sides.
    keys = vectors.select("id", "h", "g")
    heard = best.join(keys, "id").join(members.select("h", "g", "vec_id"), ["h", "g"]).select("query", "vec_id", "score")
    answers = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    heard = heard.withColumn("nth", F.row_number().over(answers)).where(F.col("nth") <= k + 1).drop("nth")
    named = queries.join(keys, ["h", "g"]).select("query_id", F.col("id").alias("query"))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        named.join(heard, "query").where("vec_id != query_id").withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
