"""Places of addresses: joins with two small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.places import (
    digest_remainder,
    latitude_jitter,
    longitude_jitter,
    pool_index,
)


def _sql_value(value: str | float | int | bool) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    values = ", ".join("(" + ", ".join(map(_sql_value, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def geo_profiles(spark: SparkSession) -> DataFrame:
    """12 rows."""
    return _table(spark, V.GEO_PROFILES, "ip, country, city, latitude, longitude, is_malicious")


def geo_pool(spark: SparkSession) -> DataFrame:
    """13 rows; ``idx`` is the position."""
    rows = [(i, *row) for i, row in enumerate(V.GEO_POOL)]
    return _table(spark, rows, "idx, country, city, latitude, longitude, isp")


def add_profile_place(rows: DataFrame) -> DataFrame:
    """Profile place by exact address; others are ``Unknown`` at 0, 0."""
    profiles = F.broadcast(geo_profiles(rows.sparkSession).drop("is_malicious").alias("p"))
    joined = rows.join(profiles, "ip", "left")

    def either(column: str, default) -> Column:
        return F.coalesce(F.col(f"p.{column}"), F.lit(default)).alias(column)

    return joined.select(
        *[F.col(c) for c in rows.columns],
        either("country", "Unknown"),
        either("city", "Unknown"),
        either("latitude", 0.0),
        either("longitude", 0.0),
    )


def add_place(rows: DataFrame) -> DataFrame:
    """Profile place, else one of the pool's places picked and shifted by the address's md5."""
    spark = rows.sparkSession
    profiles = F.broadcast(geo_profiles(spark).alias("p"))
    pool = F.broadcast(geo_pool(spark).alias("g"))
    rest = F.col("_rest")
    known = F.col("p.country").isNotNull()
    digest = F.md5(F.col("ip").cast("binary"))
    joined = (
        rows.join(profiles, "ip", "left")
        .withColumn("_rest", F.when(~known, digest_remainder(digest)))
        .join(pool, pool_index(rest) == F.col("g.idx"), "left")
    )
    isp = F.when(F.col("p.is_malicious"), V.ISP_MALICIOUS).otherwise(V.ISP_OTHER)

    def shifted(column: str, jitter: Column) -> Column:
        return F.when(known, F.col(f"p.{column}")).otherwise(
            F.round(F.col(f"g.{column}") + jitter, V.COORDINATE_DIGITS)
        )

    return joined.select(
        *[F.col(c) for c in rows.columns],
        F.when(known, F.col("p.country")).otherwise(F.col("g.country")).alias("country"),
        F.when(known, F.col("p.city")).otherwise(F.col("g.city")).alias("city"),
        shifted("latitude", latitude_jitter(rest)).alias("latitude"),
        shifted("longitude", longitude_jitter(rest)).alias("longitude"),
        F.when(known, isp).otherwise(F.col("g.isp")).alias("isp"),
    )


def attack_vectors(clusters: DataFrame) -> DataFrame:
    """Edges from each non-normal address cluster to the protected site, with a range."""
    lat, lon = V.ATTACK_TARGET
    severity = F.col("display_severity")
    reach = F.when(severity == "Critical", 45).when(severity == "High Threat", 30).otherwise(15)
    located = F.col("latitude").isNotNull() & ~F.isnan("latitude")
    located = located & F.col("longitude").isNotNull() & ~F.isnan("longitude")
    return clusters.filter((severity != "Normal") & located).select(
        "ip",
        F.col("latitude").alias("source_lat"),
        F.col("longitude").alias("source_lon"),
        F.lit(lat).alias("target_lat"),
        F.lit(lon).alias("target_lon"),
        severity.alias("display_severity"),
        reach.alias("range"),
    )
