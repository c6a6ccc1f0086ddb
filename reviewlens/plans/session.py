"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts: bound an Arrow batch by its size and not only by its rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "reviewlens", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` to spark-submit and set
    ``spark.sql.shuffle.partitions`` for the data size; adaptive execution merges small partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (_SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
