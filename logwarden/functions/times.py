"""Timestamp text to time, and time to labels. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import APACHE_TIME_FORMAT


def apache_time(text: Column) -> Column:
    zoned = F.when(F.length(text) > 20, text).otherwise(F.concat(text, F.lit(" +0000")))
    return F.try_to_timestamp(zoned, F.lit(APACHE_TIME_FORMAT))


def iso_time(text: Column) -> Column:
    """``yyyy-MM-dd`` followed by a blank or ``T`` and a time, with optional fraction and zone."""
    return F.when(F.length(text) >= 19, text.try_cast("timestamp"))


def event_time(text: Column) -> Column:
    """Time of any supported text form, NULL when the text is none of them."""
    return F.when(F.substring(text, 3, 1) == "/", apache_time(text)).otherwise(iso_time(text))


def epoch_seconds(time: Column) -> Column:
    return F.unix_seconds(time)


def clock_label(time: Column, pattern: str = "HH:mm:ss") -> Column:
    return F.date_format(time, pattern)


def trend_key(timestamp: Column) -> Column:
    """Text before the first blank, then before the first colon (else the first 13 characters)."""
    head = F.substring_index(F.substring_index(timestamp, " ", 1), ":", 1)
    return F.when(F.contains(timestamp, F.lit(":")), head).otherwise(
        F.substring(timestamp, 1, 13)
    )


def timeline_key(timestamp: Column) -> Column:
    """``HH:mm`` of an ISO time, ``HH:00`` of a colon-separated one, else ``00:00``."""
    iso = F.substring(F.get(F.split(timestamp, "T"), F.lit(1)), 1, 5)
    hour = F.concat(F.get(F.split(timestamp, ":"), F.lit(1)), F.lit(":00"))
    return (
        F.when(F.contains(timestamp, F.lit("T")), iso)
        .when(F.contains(timestamp, F.lit(":")), hour)
        .otherwise("00:00")
    )
