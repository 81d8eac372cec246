"""Text sinks. All write folders of part files; one_file gathers small results into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _out(df: DataFrame, one_file: bool) -> DataFrame:
    return df.coalesce(1) if one_file else df


def write_tuples(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Lines like (a,b)."""
    inside = F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])
    _out(df.select(F.concat(F.lit("("), inside, F.lit(")"))), one_file).write.text(path)


def write_delimited(df: DataFrame, path: str, separator: str = "\t", one_file: bool = False) -> None:
    """Fields side by side; the separator may be empty."""
    _out(df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in df.columns])), one_file).write.text(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    _out(df, one_file).write.csv(path)


def node_json(df: DataFrame) -> DataFrame:
    """(line): vertex states as JSON."""
    state = df.withColumn("kMap", F.transform_keys("kMap", lambda k, _: k.cast("string")))
    return state.select(F.to_json(F.struct("nodeId", "adjList", "isObj", "isActive", "kMap")).alias("line"))


def write_node_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    _out(node_json(df), one_file).write.text(path)
