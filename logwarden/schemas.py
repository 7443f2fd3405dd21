"""Fixed schemas and column lists; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_LINE = T.StructType([T.StructField("value", T.StringType())])

CLASSIFIERS = [
    "isolation_forest", "random_forest", "logistic_regression", "gradient_boosting",
]

EXPORT_COLUMNS = [
    "ip", "timestamp", "method", "url", "status", "size", "log_type", "threat_severity",
    "prediction", "anomaly_score", "country", "city", "batch_id",
]
