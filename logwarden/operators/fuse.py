"""Merge of rule and model verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import (
    display_severity,
    merged_severity,
    merged_threat_type,
    verdict,
)


def add_verdict(
    rows: DataFrame,
    model_flags: Column | None = None,
    score: Column | None = None,
    model_label: str = "ML Anomaly",
) -> DataFrame:
    """Add ``prediction, severity, display_severity, threat_type, details, anomaly_score``.

    Without a model the verdict and the score are the rule's own.
    """
    flags = F.lit(False) if model_flags is None else model_flags
    points = F.col("rule.score") if score is None else score
    threat, severity = F.col("rule.is_threat"), F.col("rule.severity")
    return (
        rows.withColumn("prediction", verdict(threat, flags))
        .withColumn("severity", merged_severity(threat, severity, flags, points))
        .withColumn("display_severity", display_severity(F.col("severity")))
        .withColumn(
            "threat_type",
            merged_threat_type(threat, F.col("rule.threat_type"), flags, model_label),
        )
        .withColumn("details", F.col("rule.details"))
        .withColumn("anomaly_score", F.round(points, 4))
    )


def with_native_verdict(rows: DataFrame) -> DataFrame:
    """Opt-in: let the format's own threat flag also make a row an anomaly."""
    native = F.col("native_threat")
    flagged = (native["prediction"] == "Anomaly") & (F.col("prediction") == "Normal")
    return (
        rows.withColumn("_native", flagged)
        .withColumn(
            "threat_type", F.when(flagged, native["threat_type"]).otherwise(F.col("threat_type"))
        )
        .withColumn(
            "display_severity",
            F.when(F.col("_native"), native["severity"]).otherwise(F.col("display_severity")),
        )
        .withColumn(
            "severity",
            F.when(F.col("_native") & (native["severity"] == "High Threat"), "High")
            .when(F.col("_native"), native["severity"])
            .otherwise(F.col("severity")),
        )
        .withColumn("prediction", F.when(F.col("_native"), "Anomaly").otherwise(F.col("prediction")))
        .drop("_native")
    )
