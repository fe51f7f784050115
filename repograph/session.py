"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "repograph", **settings: str) -> SparkSession:
    """AQE on, UTC, Arrow; everything else is the cluster's choice unless given."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
