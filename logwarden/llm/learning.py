"""Bounded labelled samples and the fitting that both text classifiers use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.llm.common import drop_coder, id_and_text

#: Labelled documents that a fit uses at most: those whose ids have the least hashes.
SAMPLE = 12_000

FEATURED = "doc_id bigint, label int, features binary"


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """``doc_id, text, label`` of at most ``limit`` labelled ids; equal ids count once, null labels not at all.

    The ids are at most ``limit`` rows, so they are sent to every task and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")


def featured(sample: DataFrame, features: Callable[[str], np.ndarray], dtype: str) -> DataFrame:
    """``doc_id, label, features``: the feature array of each text of a sample, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_coder()
        for batch in batches:
            rows = [features(text.as_py()).astype(dtype).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "features"]
            )

    return sample.select("doc_id", "text", "label").mapInArrow(run, FEATURED)


def collected(rows: DataFrame, dtype: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature arrays and labels of a bounded sample (``FEATURED``), in ``doc_id`` order."""
    rows = rows.toArrow()
    # Views of the collected table in order of ids, not copies of it.
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("features", "ascending")]).to_pylist()
    cells = rows["features"]
    return [np.frombuffer(cells[i].as_buffer(), dtype) for i in order], rows["label"].to_numpy()[order]


def minimised(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rate: float = 0.1, steps: int = 300) -> np.ndarray:
    """Full-batch Adam with a falling rate, from public papers; deterministic."""
    x, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        g = gradient(x)
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        pace = rate * (1 - step / (steps + 1))
        x -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return x


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def with_column(df: DataFrame, text: str, name: str, value: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """All columns as they are and a double computed from whole texts, null texts as empty."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_coder()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value(texts), pa.float64())], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
