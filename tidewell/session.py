"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
