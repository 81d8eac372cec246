"""The session that programs and tests use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, ANSI rules and UTC; other settings come from the cluster, or from conf."""
    builder = SparkSession.builder.appName("flowgraph")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | (conf or {})).getOrCreate()
