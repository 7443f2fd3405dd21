"""Line formats as column builders.

Each format has two steps so that a line meets its regular expression once: ``pieces`` captures all
groups in one pass (joined by newline, which no log line may contain, then split), and ``record`` names
them. ``record`` is NULL when the line does not match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import java_pattern


def _captures(pattern: str, groups: int) -> Callable[[Column], Column]:
    replacement = "\n".join(f"${i + 1}" for i in range(groups))

    def build(line: Column) -> Column:
        # A value that holds a newline itself is no line.
        one_line = F.when(~F.contains(line, F.lit("\n")), line)
        return F.split(
            F.regexp_replace(one_line, java_pattern(pattern) + ".*", replacement), "\n"
        )

    return build


def native_threat(
    flagged: Column | bool = False,
    threat_type: str = "Normal",
    severity: Column | None = None,
    score: float = 0.05,
) -> Column:
    flag = F.lit(flagged)
    return F.struct(
        F.when(flag, threat_type).otherwise("Normal").alias("threat_type"),
        (severity if severity is not None else F.lit("Normal")).alias("severity"),
        F.when(flag, "Anomaly").otherwise("Normal").alias("prediction"),
        F.lit(score).alias("score"),
    )


def record(
    log_type: Column | str,
    timestamp: Column,
    ip: Column,
    method: Column | str,
    url: Column,
    status: Column,
    size: Column | None = None,
    protocol: Column | None = None,
    is_fallback: bool = False,
    threat: Column | None = None,
) -> Column:
    """The parsed record every format produces, field for field."""

    # F.lit leaves Columns as they are.
    missing_text = F.lit(None).cast("string")
    return F.struct(
        F.lit(log_type).alias("log_type"),
        timestamp.alias("timestamp"),
        ip.alias("ip"),
        F.lit(method).alias("method"),
        url.alias("url"),
        (protocol if protocol is not None else missing_text).alias("protocol"),
        status.try_cast("int").alias("status"),
        (size if size is not None else F.lit(None)).cast("bigint").alias("size"),
        F.lit(is_fallback).alias("is_fallback"),
        (threat if threat is not None else native_threat()).alias("native_threat"),
    )


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.lower(text), F.lit(word))
    return found


def _size(text: Column) -> Column:
    return F.when(text == "-", 0).otherwise(text.try_cast("bigint"))


def _apache_strict(p: Callable[[int], Column]) -> Column:
    return record("Apache", p(1), p(0), p(2), p(3), p(5), _size(p(6)), p(4))


def _apache_lenient(p: Callable[[int], Column]) -> Column:
    url = F.when(p(3) == "", V.DEFAULT_URL).otherwise(p(3))
    protocol = F.when(p(4) == "", V.DEFAULT_PROTOCOL).otherwise(p(4))
    return record("Apache", p(1), p(0), p(2), url, p(5), _size(p(6)), protocol)


def _hdfs(p: Callable[[int], Column]) -> Column:
    level, message = p(2), p(4)
    flagged = any_of(message, ["unauthorized", "denied"])
    url = F.when(
        F.contains(message, F.lit("/")), F.substring_index(message, " ", -1)
    ).otherwise(V.HDFS_ROOT_URL)
    status = F.when(level == "ERROR", 500).when(flagged, 403).otherwise(200)
    severity = (
        F.when(flagged, "High Threat").when(level == "WARN", "Suspicious").otherwise("Normal")
    )
    threat = native_threat(flagged, "Unauthorized Access", severity, 0.85)
    return record("HDFS", p(0), p(1), "HDFS_OP", url, status, threat=threat)


def _kubernetes(p: Callable[[int], Column]) -> Column:
    level, message = p(1), p(4)
    flagged = any_of(message, ["fail", "exploit", "unauthorized"])
    status = F.when(flagged, 401).when(level == "INFO", 200).otherwise(400)
    severity = (
        F.when(flagged & (level == "ERROR"), "Critical")
        .when(flagged, "High Threat")
        .otherwise("Normal")
    )
    threat = native_threat(flagged, "Pod Bruteforce", severity, 0.92)
    url = F.concat(F.lit("/pods/"), p(2))
    return record("Kubernetes", p(0), p(3), "K8S_REQ", url, status, threat=threat)


def _cloudtrail(p: Callable[[int], Column]) -> Column:
    result = p(3)
    flagged = F.contains(result, F.lit("Denied")) | F.contains(result, F.lit("Unauthorized"))
    severity = F.when(flagged, "Critical").otherwise("Normal")
    threat = native_threat(flagged, "IAM Privilege Escalation", severity, 0.95)
    status = F.when(flagged, 403).otherwise(200)
    return record("CloudTrail", p(0), p(1), p(2), p(4), status, threat=threat)


def _android(year: int) -> Callable[[Callable[[int], Column]], Column]:
    def build(p: Callable[[int], Column]) -> Column:
        priority, message = p(1), p(5)
        failed = priority.isin("E", "F")
        flagged = failed | any_of(message, ["exploit", "malware"])
        severity = F.when(flagged, "High Threat").otherwise("Normal")
        threat = native_threat(flagged, "Logcat Malware Warning", severity, 0.88)
        return record(
            "Android",
            F.concat(F.lit(f"{year}-"), p(0)),
            p(4),
            F.concat(F.lit("ANDROID_"), priority),
            F.concat(F.lit("/app/"), p(2)),
            F.when(failed, 500).otherwise(200),
            threat=threat,
        )

    return build


@dataclass(frozen=True)
class LineFormat:
    """``pieces``: line -> array; ``matched``: array -> bool; ``named``: piece getter -> record."""

    pieces: Callable[[Column], Column]
    matched: Callable[[Column], Column]
    named: Callable[[Callable[[int], Column]], Column]

    def record(self, pieces: Column) -> Column:
        return F.when(self.matched(pieces), self.named(lambda i: F.get(pieces, F.lit(i))))


def _regex_format(pattern: str, groups: int, named) -> LineFormat:
    return LineFormat(
        _captures(pattern, groups), lambda a: F.coalesce(F.size(a), F.lit(-1)) == groups, named
    )


def line_formats(strict: bool = True, year: int = V.ANDROID_DEFAULT_YEAR) -> dict[str, LineFormat]:
    """Formats by lower-case log type."""
    return {
        "apache": _regex_format(V.APACHE_STRICT, 7, _apache_strict)
        if strict
        else _regex_format(V.APACHE_LENIENT, 7, _apache_lenient),
        "hdfs": _regex_format(V.HDFS_LINE, 5, _hdfs),
        "kubernetes": _regex_format(V.KUBERNETES_LINE, 5, _kubernetes),
        "cloudtrail": LineFormat(
            lambda line: F.split(line, " "),
            lambda a: F.size(a) >= V.CLOUDTRAIL_MIN_PARTS,
            _cloudtrail,
        ),
        "android": _regex_format(V.ANDROID_LINE, 6, _android(year)),
    }


def fallback_record(line: Column, log_type: Column, timestamp: Column) -> Column:
    """The normal-looking record that stands for a line no format matches."""
    lowered = F.lower(log_type)
    capitalized = F.concat(F.upper(F.substring(lowered, 1, 1)), F.substr(lowered, F.lit(2)))
    ip = F.when(F.contains(line, F.lit(V.FALLBACK_MARKER)), V.FALLBACK_MARKER_IP)
    url = F.when(F.contains(line, F.lit("/")), V.FALLBACK_PATH_URL)
    return record(
        capitalized,
        timestamp,
        ip.otherwise(V.FALLBACK_IP),
        "GET",
        url.otherwise(V.FALLBACK_PLAIN_URL),
        F.lit(200),
        F.length(line),
        is_fallback=True,
    )


def rebuilt_line(protocol: Column | str = V.DEFAULT_PROTOCOL) -> Column:
    """Canonical text of a parsed row, by its ``log_type`` column."""
    kind = F.lower(F.col("log_type"))
    protocol = F.lit(protocol)
    ts, ip, method, url = (F.col(c) for c in ("timestamp", "ip", "method", "url"))
    status, size = F.col("status").cast("string"), F.col("size").cast("string")

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) for p in parts])

    apache = text(
        ip, " - - [", ts, '] "', method, " ", url, " ", protocol, '" ', status, " ", size,
        ' "-" "-"',
    )
    return (
        F.when(kind == "apache", apache)
        .when(kind == "hdfs", text(ts, " ", ip, " INFO dfs.FSNamesystem: Access ", url))
        .when(kind == "kubernetes", text(ts, " INFO pod ", ip, " ", url, " success"))
        .when(kind == "cloudtrail", text(ts, " ", ip, " ", method, " Success ", url))
        .when(kind == "android", text(ts, " I ActivityManager IP ", ip, " Requesting ", url))
        .otherwise(text(ip, " - ", url))
    )
