"""A session with the settings that the measures expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fabulary", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; further settings by name with dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
