"""Text columns: cleaning, percent-decoding and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import PYTHON_WHITESPACE


def clean_line(value: Column) -> Column:
    """Drop bytes that are not UTF-8, then trim whitespace at both ends."""
    repaired = F.regexp_replace(F.make_valid_utf8(value), "\ufffd", "")
    text = F.when(F.is_valid_utf8(value), value).otherwise(repaired)
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A Python-style pattern with Python's rules for ``.``, whitespace and case, for Spark."""
    flags = "(?idU)" if ignore_case else "(?dU)"
    blanks = pattern.replace(r"\s", r"[\s\x1c-\x1f]")
    return flags + blanks.replace(r"\S", r"[^\s\x1c-\x1f]")


def unquote(text: Column) -> Column:
    """Percent-decode once: ``+`` stays, and a ``%`` without two hex digits stays."""
    safe = F.regexp_replace(
        F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"
    )
    return F.when(F.contains(text, F.lit("%")), F.url_decode(safe)).otherwise(text)


def contains_ignore_case(text: Column, term: str) -> Column:
    """Literal substring test, any case."""
    return F.contains(F.lower(text), F.lower(F.lit(term)))


def attack_label(url: Column) -> Column:
    """Short attack name from case-sensitive parts of the url."""
    return (
        F.when(F.contains(url, F.lit("UNION")), "SQLi")
        .when(F.contains(url, F.lit("passwd")), "LFI")
        .when(F.contains(url, F.lit("login")), "BruteForce")
        .otherwise("Scanner")
    )


def shorten(text: Column, width: int = 25) -> Column:
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def http_label(status: Column) -> Column:
    return F.concat(F.lit("HTTP "), F.coalesce(status, F.lit(200)).cast("string"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part`` of ``whole`` in percent, 0 when ``whole`` is 0."""
    share = F.round(part / whole * 100, digits)
    return F.when(whole > 0, share).otherwise(F.lit(0.0))


def score_percent(score: Column) -> Column:
    return F.round(score * 100, 1)
