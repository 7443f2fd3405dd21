"""Severity vocabularies and the merge of rule and model verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import SEVERITY_NAMES


def display_severity(severity: Column) -> Column:
    """Store name to display name; unknown names become the lowest one."""
    named = F.when(F.lit(False), "")
    for store, display in SEVERITY_NAMES:
        named = named.when(severity == store, display)
    return named.otherwise(SEVERITY_NAMES[0][1])


def severity_rank(severity: Column) -> Column:
    """0 to 3, from either vocabulary; unknown names rank -1."""
    rank = F.when(F.lit(False), -1)
    for position, names in enumerate(SEVERITY_NAMES):
        rank = rank.when(severity.isin(*names), position)
    return rank.otherwise(-1)


def verdict(is_threat: Column, model_flags: Column) -> Column:
    return F.when(is_threat | model_flags, "Anomaly").otherwise("Normal")


def merged_severity(is_threat: Column, severity: Column, model_flags: Column, score: Column) -> Column:
    """Rule severity of an anomaly, raised by the model score when the rules saw none."""
    raised = F.when(severity != "Low", severity).when(score >= 0.7, "High").otherwise("Medium")
    return F.when(is_threat | model_flags, raised).otherwise("Low")


def merged_threat_type(
    is_threat: Column, threat_type: Column, model_flags: Column, model_label: str = "ML Anomaly"
) -> Column:
    return F.when(is_threat, threat_type).when(model_flags, model_label).otherwise("Normal")
