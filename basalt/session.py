"""The session this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "basalt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI arithmetic, adaptive execution and partitions overwritten one by one.

    Shuffle partitions are left to the cluster's setting and merged at run time; a master is set for local runs only."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
