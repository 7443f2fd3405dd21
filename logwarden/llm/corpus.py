"""Tokenised chunks of a corpus, packed number arrays, and connected components.

Word counts and shingles need every document's words more than once. A chunk holds some documents' words as
numbers of a dictionary of its own, a few bytes a word, so that texts are read and split once.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.llm.common import drop_coder, words
from logwarden.session import stage

#: A chunk ends when it has so many bytes of text or documents. One text is never split.
CHUNK_BYTES = 16 << 20
CHUNK_DOCS = 100_000
#: Chunks that one partition may have, as a power of two.
PART_SHIFT = 32

CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())),
    ("lengths", pa.binary()), ("n_words", pa.int64()), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())),
])
CHUNK_DDL = "chunk bigint, doc_ids array<bigint>, marks array<bigint>, lengths binary, n_words bigint, tokens binary, words array<binary>"


def squeeze(values: np.ndarray) -> bytes:
    """A number array as byte planes, compressed: equal upper bytes cost next to nothing."""
    values = np.ascontiguousarray(values)
    head = values.dtype.str.encode().ljust(4)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T if len(values) else values
    return head + zlib.compress(planes.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].decode().strip())
    planes = np.frombuffer(zlib.decompress(data[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that one chunk at a time is in Python's memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def token_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write chunks, numbered from 0 without gaps, of ``doc_id, text, mark`` (a long that callers may use) and read them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_coder()
        base, n = TaskContext.get().partitionId() << PART_SHIFT, 0
        ids, marks, lengths, parts, size = [], [], [], [], 0
        local: defaultdict[bytes, int] = defaultdict()
        local.default_factory = local.__len__

        def chunk() -> pa.RecordBatch:
            tokens = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            row = {
                "chunk": base + n, "doc_ids": ids, "marks": marks, "lengths": squeeze(np.array(lengths, np.uint32)),
                "n_words": len(tokens), "tokens": squeeze(tokens), "words": list(local),
            }
            return pa.RecordBatch.from_pylist([row], schema=CHUNK)

        for batch in batches:
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = words(text.as_py())
                ids.append(doc_id)
                marks.append(mark)
                lengths.append(len(own))
                parts.append(np.fromiter(map(local.__getitem__, own), np.uint32, len(own)))
                size += len(text.as_buffer())
                if size >= chunk_bytes or len(ids) >= CHUNK_DOCS:
                    yield chunk()
                    n += 1
                    ids, marks, lengths, parts, size = [], [], [], [], 0
                    local.clear()
        if ids:
            yield chunk()

    written = stage(docs.select("doc_id", "text", "mark").mapInArrow(run, CHUNK_DDL), "chunks")
    # Numbers from 0 without gaps, so that they stay small however many partitions there are. The table of where
    # a partition's numbers begin has 16 bytes for each input partition.
    part = F.shiftright("chunk", PART_SHIFT)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    numbered = written.withColumn("part", part).join(F.broadcast(starts), "part")
    return numbered.withColumn("chunk", F.col("begin") + F.col("chunk") % (1 << PART_SHIFT)).drop("part", "begin")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node reachable from each node of ``a, b``; nodes without edges are left out.

    Large-star and small-star steps in turn until nothing changes. Each step is written, so lineage stays
    short and a lost executor costs one step.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(
            least.select("a", F.col("m").alias("b"))
        )
        now = stage(small.distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    ).distinct()
