"""Follower counts (in-degrees), by five ways of combining values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import followed, is_edge

STRATEGIES = ("group", "reduce", "fold", "aggregate", "dataset")


def count_lines(lines: DataFrame, node_lines: str = "zero") -> DataFrame:
    """(user, followers) of text lines. An edge line counts 1 for what follows its first comma; a node line counts 0 for
    itself (node_lines="zero"), so that users without followers appear, or 1 ("one")."""
    one = F.lit(1) if node_lines == "one" else F.when(is_edge(F.col("line")), 1).otherwise(0)
    return lines.groupBy(followed(F.col("line")).alias("user")).agg(F.sum(one).cast("bigint").alias("followers"))


def follower_count(edges: DataFrame, strategy: str = "dataset", nodes: DataFrame | None = None) -> DataFrame:
    """(user, followers). reduce, fold, aggregate and dataset combine before the shuffle; group ships every value and is
    kept for comparison only. reduce, fold and aggregate differ in how they begin (with a value, a zero, a zero a partition); as
    a count is a sum of ones, and sums of partitions are summed, Spark makes one plan of the three. nodes (id): users who appear with 0 if no one follows them."""
    ones = edges.select(F.col("dst").alias("user"), F.lit(1).cast("bigint").alias("one"))
    if nodes is not None:
        ones = ones.unionByName(nodes.select(F.col("id").alias("user"), F.lit(0).cast("bigint").alias("one")))
    if strategy == "group":
        total = F.aggregate(F.collect_list("one"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    elif strategy == "reduce":
        total = F.sum("one")
    elif strategy == "fold":
        total = F.coalesce(F.sum("one"), F.lit(0)) + F.lit(0)  # the zero of the fold
    elif strategy == "aggregate":
        total = F.sum(F.coalesce("one", F.lit(0))) + F.lit(0)  # one operation within, one between partitions
    elif strategy == "dataset":
        total = F.count(F.lit(1)) if nodes is None else F.sum("one")
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    return ones.groupBy("user").agg(total.cast("bigint").alias("followers"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours) with neighbours in ascending order, repeats kept. A hub's list is one row: for large graphs keep edges flat."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def vertices(edges: DataFrame) -> DataFrame:
    """(node): every end of an edge, once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def sources_of(edges: DataFrame) -> DataFrame:
    """(node): every vertex with an edge out of it, once."""
    return edges.select(F.col("src").alias("node")).distinct()


def max_id(edges: DataFrame, bound: int) -> DataFrame:
    """The edges whose ends are both at most `bound`."""
    return edges.where((F.col("src") <= bound) & (F.col("dst") <= bound))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
