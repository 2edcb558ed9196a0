"""Session builder with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "textmill", **conf: str) -> SparkSession:
    """A session with adaptive execution on; keyword settings use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
