"""Token ids in files of patched frame-of-reference blocks.

A block holds 128 ids: its minimum, the differences to it packed at a width that a percentile of them
fits, and a list of exceptions (place and upper bits) for the rest. A file is a run of documents in
ascending id order:

    magic "PFOR0001" | blocks | block starts (u8) | document ids (i8) | document ends in ids (u8)
    | n blocks, n documents, n ids, place of the block starts (four u8)

    block: minimum u4 | width u1 | exceptions u1 | 16 * width bytes | places u1 | upper bits u4

Every task writes a file of its own name through pyarrow's file systems (local paths, hdfs, s3) and
reports it as a row; files of failed attempts are in no manifest and are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.llm.common import id_and_text, text_encoder
from logwarden.session import scratch_folder

BLOCK = 128
HEAD = 6
MAGIC = b"PFOR0001"
#: Share of a block's differences that its width must hold; the rest become exceptions.
PERCENTILE = 0.9
#: Ids that are packed or unpacked at once.
SPAN = 1 << 18
#: Bytes of a generation of the encoder's caches: its tasks hold little else.
CACHE_BYTES = 96 << 20

MANIFEST = "part int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
STORED = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the blocks and the size of each; the last block is filled up with its last id."""
    rows = -(-len(ids) // BLOCK)
    full = np.empty(rows * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(rows, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = _bit_lengths(rest)
    widths = np.partition(bits, int(percentile * BLOCK) - 1, axis=1)[:, int(percentile * BLOCK) - 1]
    outside = bits > widths[:, None]
    many = outside.sum(axis=1)
    sizes = HEAD + widths.astype(np.int64) * (BLOCK // 8) + many * 5
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if rows else np.empty(0, np.int64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(rows, 4)
    out[starts + 4] = widths
    out[starts + 5] = many
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        planes = (rest[at][:, :, None] >> np.arange(width, dtype=np.uint32)) & 1
        packed = np.packbits(planes.astype(np.uint8).reshape(len(at), -1), axis=1, bitorder="little")
        out[starts[at, None] + HEAD + np.arange(width * BLOCK // 8)] = packed
    block, place = np.nonzero(outside)
    if len(block):
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        rank = np.arange(len(block)) - first[block]
        lists = starts[block] + HEAD + widths[block].astype(np.int64) * (BLOCK // 8)
        out[lists + rank] = place
        upper = (rest[block, place] >> widths[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(lists + many[block] + rank * 4)[:, None] + np.arange(4)] = upper
    return out, sizes


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``, with what fills the last one."""
    rows = len(starts)
    starts = starts.astype(np.int64)
    least = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").ravel()
    widths, many = data[starts + 4], data[starts + 5].astype(np.int64)
    rest = np.zeros((rows, BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        packed = data[starts[at, None] + HEAD + np.arange(width * BLOCK // 8)]
        planes = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, width)
        rest[at] = planes @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    total = int(many.sum())
    if total:
        block = np.repeat(np.arange(rows), many)
        rank = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        lists = starts[block] + HEAD + widths[block].astype(np.int64) * (BLOCK // 8)
        upper = np.ascontiguousarray(data[(lists + many[block] + rank * 4)[:, None] + np.arange(4)]).view("<u4").ravel()
        rest[block, data[lists + rank]] |= upper << widths[block].astype(np.uint32)
    return rest + least[:, None]


class BlockWriter:
    """Packs ids as they come and writes one file; keeps only a span of ids and the index."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self._out, self._percentile = out, percentile
        self._pending: list[np.ndarray] = []
        self._held = 0
        self._sizes: list[np.ndarray] = []
        self._doc_ids: list[int] = []
        self._ends: list[int] = []
        self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self._pending.append(ids)
        self._held += len(ids)
        self.n_ids += len(ids)
        self._doc_ids.append(doc_id)
        self._ends.append(self.n_ids)
        if self._held >= SPAN:
            self._flush(self._held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        joined = np.concatenate(self._pending) if self._pending else np.empty(0, np.uint32)
        for a in range(0, n, SPAN):
            data, sizes = pack_blocks(joined[a : min(a + SPAN, n)], self._percentile)
            self._out.write(data.tobytes())
            self._sizes.append(sizes)
        self._pending, self._held = [joined[n:]], len(joined) - n

    def close(self) -> int:
        """Write the rest and the index; the file's size."""
        self._flush(self._held)
        sizes = np.concatenate([np.empty(0, np.int64), *self._sizes])
        place = len(MAGIC) + int(sizes.sum())
        starts = len(MAGIC) + np.cumsum(sizes) - sizes
        foot = np.array([len(sizes), len(self._doc_ids), self.n_ids, place], "<u8")
        tail = [starts.astype("<u8"), np.array(self._doc_ids, "<i8"), np.array(self._ends, "<u8"), foot]
        for part in tail:
            self._out.write(part.tobytes())
        return place + sum(part.nbytes for part in tail)


class BlockFile:
    """A file in memory: its index, and any range of ids without the blocks before it."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8)
        if raw[: len(MAGIC)].tobytes() != MAGIC:
            raise ValueError("not a file of token blocks")
        n_blocks, n_docs, self.n_ids, place = np.frombuffer(raw[-32:].tobytes(), "<u8").tolist()
        index = raw[place : place + 8 * (n_blocks + 2 * n_docs)].tobytes()
        self._raw = raw
        self.starts = np.frombuffer(index, "<u8", n_blocks)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, 8 * n_blocks)
        self.ends = np.frombuffer(index, "<u8", n_docs, 8 * (n_blocks + n_docs)).astype(np.int64)

    def ids(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.empty(0, np.uint32)
        a = first // BLOCK
        got = unpack_blocks(self._raw, self.starts[a : -(-end // BLOCK)]).ravel()
        return got[first - a * BLOCK : end - a * BLOCK]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each document's ids, unpacking a span of blocks at a time."""
        begin, i = 0, 0
        while i < len(self.ends):
            j = max(i + 1, int(np.searchsorted(self.ends, begin + SPAN, "right")))
            got, base = self.ids(begin, int(self.ends[j - 1])), begin
            for k in range(i, j):
                yield int(self.doc_ids[k]), got[begin - base : int(self.ends[k]) - base]
                begin = int(self.ends[k])
            i = j


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, percentile: float = PERCENTILE) -> DataFrame:
    """Encode whole texts, end each with ``end_id`` and write them in ascending ``doc_id`` order.

    Documents are split into ranges of ids, one file each; equal ids are ordered by their text, null ids
    come first and are stored as the least long, a null text is empty (its end id only). Returns the
    manifest, itself a table in ``folder``: one row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, CACHE_BYTES)
        system, place = _file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"{place}/ids-{part:06d}-{uuid.uuid4().hex}.pfor"
        out = writer = None
        end = int(end_id).to_bytes(4, "little")
        n = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    system.create_dir(place, recursive=True)
                    out = system.open_output_stream(name)
                    writer = BlockWriter(out, percentile)
                writer.add(NO_ID if doc_id is None else doc_id, np.frombuffer(encoder.encode(text.as_py()) + end, "<u4"))
                n += 1
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": name, "n_docs": n, "n_ids": writer.n_ids, "n_bytes": size}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

    rows = id_and_text(docs)
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    spark = docs.sparkSession
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


#: Stands for a null document id in the files.
NO_ID = -(1 << 63)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files of a manifest back: a row per document with its place among all ids.

    The running start of the files is a window over one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    n_files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as source:
                    stored = BlockFile(source.read_buffer())
                lengths, sums = [], []
                for _, ids in stored.documents():
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                doc_ids = [None if i == NO_ID else i for i in stored.doc_ids.tolist()]
                starts = start + stored.ends - np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.repartition(n_files, "path").mapInArrow(run, STORED)


def token_round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the token files into a new shared folder and read them back."""
    folder = scratch_folder(spark, "token-blocks")
    return read_token_files(write_token_files(docs, path, end_id, folder), folder)
