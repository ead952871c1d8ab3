"""SparkSession settings that every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "orelens", master: str | None = None) -> SparkSession.Builder:
    """UTC, ANSI arithmetic, adaptive execution with skew handling; the master is left to spark-submit if not given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    return b.master(master) if master else b
