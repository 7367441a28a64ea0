"""A session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidegauge", **conf: str) -> SparkSession:
    """UTC, adaptive plans; a cluster's own settings win where it has them."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
