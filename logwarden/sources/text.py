"""Raw log lines from files, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line
from ..schemas import RAW_LINE

UPLOAD_NAMES = "*.{log,txt,csv}"
RAW_LOG_SETTING = "spark.logwarden.rawLog"

# A broadcast of where each block of the files begins: at most so many rows of a path and three numbers.
BROADCAST_BLOCKS = 200_000
BLOCK = ["_file", "_from"]


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than cores; a larger input is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean_lines(raw: DataFrame) -> DataFrame:
    """Trim ``value``, drop undecodable bytes and blank lines."""
    return raw.withColumn("value", clean_line(F.col("value"))).filter(F.length("value") > 0)


def read_lines(
    spark: SparkSession,
    path: str | list[str] | None = None,
    partitions: int | None = None,
    names: str | None = None,
) -> DataFrame:
    """``line_no, value`` of text files; lines are numbered from 0 along the files, in order of their paths.

    Blank lines have numbers but no rows. The numbers depend on the files alone, not on how they are split.
    Without a path it reads the raw log that ``RAW_LOG_SETTING`` names. ``names`` is a file-name
    pattern (``UPLOAD_NAMES`` for uploaded files). ``partitions`` asks for at least that many input
    partitions.
    """
    if path is None:
        path = spark.conf.get(RAW_LOG_SETTING, None)
        if path is None:
            raise ValueError(f"give a path or set {RAW_LOG_SETTING}")
    reader = spark.read.schema(RAW_LINE)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    raw = reader.text(path)
    numbered = clean_lines(numbered_lines(raw))
    if partitions is not None and raw.rdd.getNumPartitions() < partitions:
        return numbered.repartition(partitions)
    return numbered


def with_blocks(raw: DataFrame) -> DataFrame:
    """``value`` of a text scan with the file and the block of it that each row is from."""
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_from"),
    )


def numbered_lines(raw: DataFrame) -> DataFrame:
    """``line_no, value`` of a text scan, numbered by path and place in the file.

    Spark packs blocks of files into partitions by size, so neither partitions nor row ids follow the files. A
    row's number is its place in its block plus the lines of all blocks before: a sum over one row a
    block, from a scan that counts lines and keeps no text.
    """
    rows = with_blocks(raw).withColumn("_row", F.monotonically_increasing_id())
    blocks = rows.groupBy(*BLOCK).agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
    earlier = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_lines").over(earlier), F.lit(0))
    starts = blocks.select(*BLOCK, (before - F.col("_first")).alias("_shift"))
    # Every file and every partition begins a block; the number of both is known without a job.
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    return rows.join(starts, BLOCK).select((F.col("_row") + F.col("_shift")).alias("line_no"), "value")


def partition_count(df: DataFrame) -> DataFrame:
    """One row: how many partitions hold rows."""
    return df.select(F.spark_partition_id().alias("p")).agg(
        F.count_distinct("p").alias("partitions")
    )


def stream_lines(
    spark: SparkSession,
    folder: str,
    files_per_batch: int | None = 1,
    names: str | None = None,
    blocks: bool = False,
) -> DataFrame:
    """``value`` of lines in files as they arrive in ``folder``.

    ``blocks`` adds where they are from, so that batches of several files are numbered in order of their paths.
    """
    reader = spark.readStream.schema(RAW_LINE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    raw = reader.text(folder)
    return clean_lines(with_blocks(raw) if blocks else raw)
