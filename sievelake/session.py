"""Session builder with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Values fit a cluster; local runs override master and shuffle partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # texts are expensive per byte: small partitions are worth a task of their own
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "sievelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, then ``conf`` (underscores for dots are not translated)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
