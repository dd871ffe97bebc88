"""Session defaults that make results independent of the machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "verdictlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
