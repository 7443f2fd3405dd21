"""Raw lines to parsed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.formats import fallback_record, line_formats, rebuilt_line
from ..functions.times import event_time

MODES = ("drop", "fallback", "keep")


def parse_lines(
    lines: DataFrame,
    log_type: str | Column = "apache",
    strict: bool = True,
    mode: str = "drop",
    year: int = V.ANDROID_DEFAULT_YEAR,
    fallback_time: Column | None = None,
) -> DataFrame:
    """Parse ``value`` by ``log_type`` (one name, or a column naming the format of each line).

    Lines that do not match are dropped; with ``mode='fallback'`` they become rows flagged
    ``is_fallback``, with ``mode='keep'`` rows of NULLs. All other input columns are kept.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode!r}")
    formats = line_formats(strict, year)
    kept = [c for c in lines.columns if c not in ("value", "log_type")]
    value, kind = F.col("value"), F.col("_kind")
    if isinstance(log_type, Column):
        named = lines.withColumn("_kind", F.lower(log_type))
        pieces = F.when(F.lit(False), F.array(F.lit("")))
        parsed = None
        for name, line_format in formats.items():
            pieces = pieces.when(kind == name, line_format.pieces(value))
        for name, line_format in formats.items():
            found = F.when(kind == name, line_format.record(F.col("_pieces")))
            parsed = found if parsed is None else F.coalesce(parsed, found)
    else:
        name = log_type.lower()
        named = lines.withColumn("_kind", F.lit(name))
        if name in formats:
            pieces = formats[name].pieces(value)
            parsed = formats[name].record(F.col("_pieces"))
        else:
            pieces, parsed = F.array(F.lit("")), None
    if mode == "fallback":
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        stand_in = fallback_record(value, kind, now if fallback_time is None else fallback_time)
        parsed = stand_in if parsed is None else F.coalesce(parsed, stand_in)
    elif parsed is None:
        raise ValueError(f"unknown log type: {log_type!r}")
    # ``inline`` drops unmatched lines without a filter that would run the regex a second time.
    record = F.when(parsed.isNotNull(), F.array(parsed))
    rows = F.inline_outer(record) if mode == "keep" else F.inline(record)
    # A stand-in row's timestamp is the batch's, not the line's: it must not count in trailing rates.
    line_time = F.when(~F.col("is_fallback"), event_time(F.col("timestamp")))
    return (
        named.withColumn("_pieces", pieces)
        .select(*kept, rows)
        .withColumn("event_time", line_time)
    )


def add_rebuilt_line(parsed: DataFrame, keep_protocol: bool = False) -> DataFrame:
    """Add ``line``, the canonical text the models see."""
    protocol = F.col("protocol") if keep_protocol else V.DEFAULT_PROTOCOL
    return parsed.withColumn("line", rebuilt_line(protocol))


def tag_batch(rows: DataFrame, number: int) -> DataFrame:
    """Add the batch tag of run ``number``."""
    return rows.withColumn("batch_id", F.lit(f"RDD-0{number}"))
