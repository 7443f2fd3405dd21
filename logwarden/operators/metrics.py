"""Aggregates over enriched rows. Every one combines partially before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.text import attack_label, http_label, percent
from ..functions.times import timeline_key, trend_key
from .filters import (
    is_anomaly,
    is_failed_request,
    is_high_alert,
    is_threat_country,
)
from .geo import add_place
from .paging import keep_latest, last_keys, latest_threats, newest_first, top_by_count

SEVERITY_COLUMNS = {
    "Normal": "normal",
    "Suspicious": "suspicious",
    "High Threat": "high_threat",
    "Critical": "critical",
}


def _counts(rows: DataFrame, key: Column | str, name: str, count: str = "count") -> DataFrame:
    column = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias(count))


def _severity_counts() -> list[Column]:
    return [
        F.count_if(F.col("display_severity") == value).alias(name)
        for value, name in SEVERITY_COLUMNS.items()
    ]


def _alert_level(alerts: Column, many: int, some: int, names: tuple[str, str, str]) -> Column:
    return F.when(alerts > many, names[0]).when(alerts > some, names[1]).otherwise(names[2])


# --- batch analysis ----------------------------------------------------------------------------
def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("prediction") == "Normal").alias("normal"),
        F.count_if(is_anomaly()).alias("anomaly"),
    )


def severity_distribution(rows: DataFrame) -> DataFrame:
    return rows.agg(*_severity_counts())


def top_ips(rows: DataFrame, k: int = 10) -> DataFrame:
    return top_by_count(_counts(rows, "ip", "ip"), "ip", k)


def top_attackers(rows: DataFrame, k: int = 5) -> DataFrame:
    return top_ips(rows.filter(is_anomaly()), k)


def status_breakdown(rows: DataFrame) -> DataFrame:
    return _counts(rows, "status", "status").orderBy(F.desc("count"), "status")


def status_labels(rows: DataFrame) -> DataFrame:
    return _counts(rows, http_label(F.col("status")), "code").orderBy(F.desc("count"), "code")


def top_endpoints(rows: DataFrame, k: int = 5) -> DataFrame:
    return top_by_count(_counts(rows, "url", "endpoint"), "endpoint", k)


def request_trend(rows: DataFrame, grain: str | None = "hour", n: int = 10) -> DataFrame:
    """Requests per ``grain`` of event time, last ``n``; ``grain=None`` uses the timestamp text."""
    if grain is None:
        counts = _counts(rows, trend_key(F.col("timestamp")), "time")
    else:
        timed = rows.filter(F.col("event_time").isNotNull())
        counts = _counts(timed, F.date_trunc(grain, "event_time"), "time")
    return last_keys(counts, "time", n)


def line_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_logs"))


def batch_metadata(rows: DataFrame, passes: Column, batch_id: str) -> DataFrame:
    """Rows processed and rows that pass the filters, in one pass."""
    return rows.agg(
        F.count("*").alias("records_processed"),
        F.count_if(passes).alias("records_filtered"),
    ).withColumn("batch_id", F.lit(batch_id))


FIGURE_KEYS = ["attacker", "status", "time", "prediction", "endpoint", "display_severity"]


def batch_figures(rows: DataFrame, grain: str = "hour") -> DataFrame:
    """Counts by each of ``FIGURE_KEYS`` alone, from one scan; ``key`` names the one that a row counts by.

    One row for each value of each key, so the six figures of a batch can be read from it.
    """
    keys = rows.select(
        F.when(is_anomaly(), F.col("ip")).alias("attacker"),
        "status",
        F.date_trunc(grain, "event_time").alias("time"),
        "prediction",
        F.col("url").alias("endpoint"),
        "display_severity",
    )
    sets = keys.groupingSets([[name] for name in FIGURE_KEYS], *FIGURE_KEYS)
    counted = sets.agg(F.grouping_id().alias("_set"), F.count("*").alias("count"))
    # A key that a row is grouped by has bit 0; the first key has the highest bit.
    every = (1 << len(FIGURE_KEYS)) - 1
    names = {every ^ (1 << i): name for i, name in enumerate(reversed(FIGURE_KEYS))}
    key = F.coalesce(*[F.when(F.col("_set") == number, F.lit(name)) for number, name in names.items()])
    return counted.select(key.alias("key"), *FIGURE_KEYS, "count")


def figures_of(figures: DataFrame) -> dict[str, DataFrame]:
    """The six figures of ``plans.pipeline.analyze`` from ``batch_figures``."""

    def by(key: str, name: str | None = None) -> DataFrame:
        return figures.filter(F.col("key") == key).select(F.col(key).alias(name or key), "count")

    def total(key: str, values: dict[str, str]) -> DataFrame:
        own = by(key)
        return own.agg(
            *[F.coalesce(F.sum(F.when(F.col(key) == value, F.col("count"))), F.lit(0)).alias(name) for value, name in values.items()]
        )

    return {
        "top_attackers": top_by_count(by("attacker", "ip").filter("ip IS NOT NULL"), "ip", 5),
        "status_counts": by("status").orderBy(F.desc("count"), "status"),
        "request_trends": last_keys(by("time").filter("time IS NOT NULL"), "time", 10),
        "anomaly_counts": total("prediction", {"Normal": "normal", "Anomaly": "anomaly"}),
        "endpoint_analytics": top_by_count(by("endpoint"), "endpoint", 5),
        "severity_distribution": total("display_severity", SEVERITY_COLUMNS),
    }


def anomaly_rate(rows: DataFrame) -> DataFrame:
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_anomaly()).alias("a"))
    return counts.select(percent(F.col("a"), F.col("n"), 2).alias("anomaly_rate"))


# --- dashboard ---------------------------------------------------------------------------------
def dashboard_kpis(rows: DataFrame) -> DataFrame:
    """One row. Addresses are aggregated first, so the distinct counts see one row per address."""
    per_ip = rows.groupBy("ip", "country").agg(
        F.count("*").alias("n"),
        F.count_if(is_anomaly()).alias("a"),
        F.count_if(is_failed_request()).alias("f"),
        F.count_if(is_high_alert()).alias("h"),
    )
    attacking = F.col("a") > 0
    totals = per_ip.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("failed_requests"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("high_severity_alerts"),
        F.count_distinct(F.when(attacking & is_threat_country(), F.col("country"))).alias(
            "threat_countries"
        ),
        F.count_distinct(F.when(attacking, F.col("ip"))).alias("suspicious_ips"),
    )
    level = _alert_level(
        F.col("high_severity_alerts"), 20, 5, ("CRITICAL", "WARNING", "SECURE")
    )
    rate = percent(F.col("total_anomalies"), F.col("total_logs"), 2)
    return totals.withColumn("detection_rate", rate).withColumn("system_status", level)


def anomaly_summary(rows: DataFrame) -> DataFrame:
    high, critical = F.col("severity") == "High", F.col("severity") == "Critical"
    return rows.agg(
        F.count("*").alias("total_logs"),
        F.count_if(is_anomaly()).alias("total_anomalies"),
        F.count_if(is_anomaly() & high).alias("high_severity_alerts"),
        F.count_if(is_anomaly() & critical).alias("critical_severity_alerts"),
    ).withColumn("anomaly_rate", percent(F.col("total_anomalies"), F.col("total_logs"), 2))


def verdict_split(rows: DataFrame) -> DataFrame:
    """Two rows, whether or not both verdicts occur."""
    counts = verdict_counts(rows)
    return counts.select(
        F.inline(
            F.array(
                F.struct(F.lit("Normal Traffic").alias("name"), F.col("normal").alias("value")),
                F.struct(F.lit("Anomalies").alias("name"), F.col("anomaly").alias("value")),
            )
        )
    )


def attack_label_counts(rows: DataFrame) -> DataFrame:
    labels = attack_label(F.col("url"))
    return _counts(rows.filter(is_anomaly()), labels, "name", "value")


def audit_report(rows: DataFrame, limit_n: int | None = 500) -> DataFrame:
    """Counts over the newest ``limit_n`` rows, or over all of them."""
    scope = rows if limit_n is None else keep_latest(rows, limit_n)

    def severity(name: str) -> Column:
        return F.count_if(F.col("severity") == name).alias(name.lower())

    def threat(name: str, alias: str) -> Column:
        return F.count_if(F.col("threat_type") == name).alias(alias)

    return scope.agg(
        F.count("*").alias("total"),
        F.count_if(is_anomaly()).alias("anomalies"),
        severity("Critical"),
        severity("High"),
        severity("Medium"),
        severity("Low"),
        threat("Web Scanner / Reconnaissance", "scanners"),
        threat("SQL Injection", "sqli"),
        threat("Directory Traversal / LFI", "traversals"),
        threat("Brute Force Attack", "brute_force"),
    ).withColumn("high_risk", F.col("critical") + F.col("high"))


# --- threat map --------------------------------------------------------------------------------
def top_countries(rows: DataFrame, k: int = 10) -> DataFrame:
    """Countries of anomalies with their share of all anomalies and severity counts."""
    per_country = (
        rows.filter(is_anomaly())
        .groupBy("country")
        .agg(F.count("*").alias("count"), *_severity_counts())
    )
    # One row per country of the geo tables is left here.
    everything = F.sum("count").over(Window.partitionBy())
    shares = per_country.withColumn("percentage", percent(F.col("count"), everything, 2))
    return top_by_count(shares, "country", k)


def threat_map_kpis(rows: DataFrame) -> DataFrame:
    high = F.col("display_severity").isin("High Threat", "Critical")
    per_ip = rows.groupBy("ip", "country").agg(
        F.count("*").alias("n"), F.count_if(high).alias("h")
    )
    named = (F.col("country") != "") & (F.col("country") != "Unknown")
    totals = per_ip.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_attacks"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("high_or_critical"),
        F.count_distinct(F.when(named, F.col("country"))).alias("unique_countries"),
        F.count_distinct("ip").alias("unique_ips"),
    )
    names = ("CRITICAL LIMIT", "WARNING ESCALATION", "SECURE")
    return totals.withColumn(
        "critical_ratio", percent(F.col("high_or_critical"), F.col("total_attacks"), 1)
    ).withColumn("posture", _alert_level(F.col("high_or_critical"), 15, 5, names))


def threat_timeline(rows: DataFrame, n: int = 12) -> DataFrame:
    return last_keys(_counts(rows, timeline_key(F.col("timestamp")), "time"), "time", n)


def top_threat_countries(rows: DataFrame, k: int = 5) -> DataFrame:
    named = F.col("country").isNotNull() & ~F.col("country").isin("", "Unknown")
    return top_by_count(
        _counts(rows.filter(named), "country", "name", "attacks"), "name", k, "attacks"
    )


def severity_counts(rows: DataFrame) -> DataFrame:
    """Counts per display severity; unknown names count as Normal, absent ones are not listed."""
    known = F.when(
        F.col("display_severity").isin(list(SEVERITY_COLUMNS)), F.col("display_severity")
    ).otherwise("Normal")
    return _counts(rows, known, "name", "value")


def ip_clusters(rows: DataFrame) -> DataFrame:
    """One row per address: counts, its newest place, and its newest most severe record."""
    worst = ["threat_type", "timestamp", "method", "url", "status", "anomaly_score"]
    newest = ["country", "city", "isp", "latitude", "longitude", "size", "prediction"]
    seq = F.col("ingest_seq")
    rank = F.struct(severity_rank(F.col("display_severity")).alias("rank"), seq)
    grouped = (
        rows.filter(F.col("ip").isNotNull())
        .groupBy("ip")
        .agg(
            F.count("*").alias("count"),
            *_severity_counts(),
            F.max_by(F.struct("display_severity", *worst), rank).alias("w"),
            F.max_by(F.struct(*newest), seq).alias("l"),
        )
    )
    return grouped.select(
        "ip", "count", *SEVERITY_COLUMNS.values(), "w.*", *[F.col(f"l.{c}") for c in newest]
    )


def country_list(rows: DataFrame) -> DataFrame:
    named = F.col("country").isNotNull() & ~F.col("country").isin("", "Unknown")
    return rows.filter(named).select("country").distinct().orderBy("country")


def ip_suggestions(rows: DataFrame, term: str, k: int = 5) -> DataFrame:
    """Addresses containing ``term``, most recently seen first; none for an empty term."""
    if not term:
        return rows.select("ip").limit(0)
    found = rows.filter(F.contains(F.lower("ip"), F.lit(term.lower())))
    seen = found.groupBy("ip").agg(F.max("ingest_seq").alias("seen"))
    return seen.orderBy(F.desc("seen")).limit(k).select("ip")


def ip_investigation(rows: DataFrame, ip: str, as_of: str | None = None) -> DataFrame:
    """One row for ``ip``: place, count, and severity and time of its newest record.

    An address without records is Normal, with count 0 and ``as_of`` as its time.
    """
    spark: SparkSession = rows.sparkSession
    wanted = add_place(spark.range(1).select(F.lit(ip).alias("ip")))
    found = (
        rows.filter(F.col("ip") == ip)
        .groupBy("ip")
        .agg(
            F.count("*").alias("count"),
            F.max_by(F.struct("display_severity", "timestamp"), "ingest_seq").alias("newest"),
        )
    )
    if as_of is None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        now = F.lit(as_of)
    return wanted.join(found, "ip", "left").select(
        "ip",
        "latitude",
        "longitude",
        F.coalesce("newest.display_severity", F.lit("Normal")).alias("display_severity"),
        "country",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("newest.timestamp", now).alias("timestamp"),
    )


# --- threat intelligence -----------------------------------------------------------------------
def actor_profiles(rows: DataFrame, latest: int = 100, k: int = 10) -> DataFrame:
    """Busiest addresses among the latest threats, with the newest record of each."""
    profile = F.struct("country", "severity", "details")
    actors = (
        latest_threats(rows, latest)
        .groupBy("ip")
        .agg(F.count("*").alias("count"), F.max_by(profile, "ingest_seq").alias("p"))
        .select("ip", "count", "p.*")
    )
    return top_by_count(actors, "ip", k)


def latest_threat_countries(rows: DataFrame, latest: int = 100) -> DataFrame:
    counts = _counts(latest_threats(rows, latest), "country", "country")
    return counts.orderBy(F.desc("count"), "country")


# --- live charts -------------------------------------------------------------------------------
def last_n_series(rows: DataFrame, n: int = 15) -> DataFrame:
    """Threat flag and traffic of the newest ``n`` rows, oldest first."""
    points = newest_first(rows).limit(n)
    return points.select(
        "ingest_seq",
        "timestamp",
        F.when(is_anomaly(), 1).otherwise(0).alias("threats"),
        F.lit(1).alias("count"),
    ).orderBy("ingest_seq")
