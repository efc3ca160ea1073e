"""Spark session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",  # M and m are two columns
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidemill").master(master)
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | more
    return builder.config(map=settings).getOrCreate()
