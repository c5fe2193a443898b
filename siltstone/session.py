"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session; with no master, the one that the launcher names."""
    builder = SparkSession.builder.appName("siltstone")
    builder = builder.master(master) if master else builder
    spark = builder.config(map={**SETTINGS, **(extra or {})}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
