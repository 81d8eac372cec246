"""Follower counts of a growing folder of edge lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.combine import count_lines


def follower_stream(spark: SparkSession, folder: str, node_lines: str = "zero") -> DataFrame:
    """A streaming (user, followers): write it in complete or update mode. The batch operator itself, over a stream of files."""
    lines = spark.readStream.text(folder).withColumnRenamed("value", "line")
    return count_lines(lines, node_lines)
