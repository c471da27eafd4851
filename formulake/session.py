"""Session settings for clusters and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "formulake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with ANSI semantics, UTC, and adaptive execution with skew handling.

    On a cluster leave ``shuffle_partitions`` unset: a large initial number is
    coalesced at run time to what the data need.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
