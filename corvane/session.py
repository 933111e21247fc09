"""Session factory with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` keys use `__` for dots."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
