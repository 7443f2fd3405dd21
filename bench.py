"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores. The ``scaled``
part, which is not in the total, repeats the log ``BENCH_COPIES`` times (default 20) with new line
numbers, and scores the log once with models fitted on the bootstrap lines.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from checks.registry import registered
from logwarden.operators import metrics
from logwarden.operators.fuse import add_verdict
from logwarden.operators.geo import add_place
from logwarden.operators.models import add_scores, bootstrap_lines
from logwarden.operators.parse import parse_lines
from logwarden.operators.rules import add_rules
from logwarden.plans.training import train
from logwarden.sources.samples import log_lines

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
COPIES = int(os.environ.get("BENCH_COPIES", "20"))

HEADLINE = [
    "parse_apache_strict", "parse_fallback", "url_decode_twice", "signature_match", "rule_verdicts",
    "rule_summary", "flood_trailing", "geo_hash_fallback", "top_countries", "ip_clusters",
    "dashboard_kpis", "request_trend", "export_rows", "log_page", "actor_profiles", "weak_labels",
    "tfidf_terms", "stream_ingest",
]


def consume(df: DataFrame) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def scaled(spark: SparkSession) -> dict:
    """Lines per second of the main steps on a repeated log."""
    log = log_lines(spark, SF_DIR)
    size = log.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")
    lines = log.select("*", copies).select(
        (F.col("line_no") + F.col("copy") * size).alias("line_no"), "value"
    ).persist(StorageLevel.MEMORY_AND_DISK)
    total = lines.count()
    parsed = parse_lines(lines)
    enriched = add_place(add_verdict(add_rules(parsed)))
    steps = {
        "parse": parsed,
        "rules": add_rules(parsed),
        "enrich": enriched,
        "dashboard_kpis": metrics.dashboard_kpis(enriched),
    }
    speeds = {"log_lines": total}
    for name, df in steps.items():
        start = time.perf_counter()
        consume(df)
        speeds[name] = int(total / (time.perf_counter() - start))
    lines.unpersist()
    models = train(bootstrap_lines(spark))
    start = time.perf_counter()
    consume(add_scores(models, log))
    speeds["score_all"] = int(size / (time.perf_counter() - start))
    return speeds


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    consume(queries["rule_summary"](spark, SF_DIR))  # start-up cost is not a query's cost
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        consume(queries[name](spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
        "scaled_lines_per_second": scaled(spark),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
