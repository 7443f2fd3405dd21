"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Time text is UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="logwarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def use_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage: boosting checkpoints every ten rounds."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_folder(spark, "checkpoints"))


def observed(seen: Observation, **nothing: object) -> dict:
    """The figures of a written table; ``nothing`` if Spark found it empty before it ran, and observed none."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return dict(nothing)


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write once, read back: later passes read columns instead of parsing again.

    ``keep``: the table outlives the ``passing_tables`` it is written in.
    """
    path = scratch_folder(df.sparkSession, name)
    made = _passing.get()
    if made is not None and not keep:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside, but for tables that were staged with ``keep``.

    For a job whose result is itself staged: nothing reads the tables on the way any more, and the shared
    folder does not fill up with them. After an error they stay.
    """
    made: list[str] = []
    token = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(token)
    conf = spark._jsc.hadoopConfiguration()
    for path in made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
