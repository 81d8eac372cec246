"""Typed readers. Paths may be one path, several, or globs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import field, is_edge

Paths = str | Sequence[str]
NODE_STATE = "nodeId INT, adjList ARRAY<INT>, isObj BOOLEAN, isActive BOOLEAN, kMap MAP<STRING, INT>"


def _list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def text_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(line)"""
    return spark.read.text(_list(paths)).withColumnRenamed("value", "line")


def edges_csv(spark: SparkSession, paths: Paths, mode: str = "FAILFAST") -> DataFrame:
    """(src, dst) of header-less comma-separated edges, typed, so that bounds on ids reach the scan."""
    return spark.read.schema("src BIGINT, dst BIGINT").option("mode", mode).csv(_list(paths))


def edges_of_lines(lines: DataFrame) -> DataFrame:
    """(src, dst) of the lines that are edges; lines whose ends are not whole numbers are left out."""
    found = lines.where(is_edge(F.col("line"))).select(field(F.col("line"), 0).alias("src"), field(F.col("line"), 1).alias("dst"))
    return found.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def nodes_of_lines(lines: DataFrame) -> DataFrame:
    """(id) of the lines that are nodes."""
    return lines.where(~is_edge(F.col("line"))).select(field(F.col("line"), 0).alias("id")).where("id IS NOT NULL")


def edges_parquet(spark: SparkSession, paths: Paths, src: str = "src", dst: str = "dst") -> DataFrame:
    return spark.read.parquet(*_list(paths)).select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"))


def tagged(**inputs: DataFrame) -> DataFrame:
    """Several inputs of one shape as one, each row tagged with its input's name."""
    parts = [df.withColumn("tag", F.lit(name)) for name, df in inputs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def coo_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """(row, col, val, src) of a file that holds one or both matrices; src names the matrix of a cell."""
    return spark.read.schema("row BIGINT, col BIGINT, val BIGINT, src STRING").csv(_list(paths))


def coo_matrix(cells: DataFrame, src: str, names: tuple[str, str] = ("row", "col")) -> DataFrame:
    """One matrix of tagged cells, as (names, val)."""
    return cells.where(F.col("src") == src).select(F.col("row").alias(names[0]), F.col("col").alias(names[1]), "val")


def node_states(lines: DataFrame) -> DataFrame:
    """The vertex states that JSON lines hold; distances by source id as numbers."""
    state = lines.select(F.from_json("line", NODE_STATE).alias("s")).select("s.*")
    return state.withColumn("kMap", F.transform_keys("kMap", lambda k, _: k.cast("int")))
