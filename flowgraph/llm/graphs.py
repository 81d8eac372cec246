"""Connected components of a link table: what one task's links connect is folded, where they are read and then in as few
tasks as hold FOLDED links each, so that no link is shuffled. What these tasks leave is contracted as stars in turns (larger
neighbours, smaller neighbours), in which no node's links are gathered in one row, and folded again, until nothing changes.
Stars run only where the folded links are more than one task holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import Steps

#: Links that a task is given, and nodes that it folds at once; what they connect is handed on, and a new fold begins.
FOLDED = 500_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (hi, lo) of the same components as a task's links, at most one a node and fold."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = [x for x, up in parent.items() if x != up]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["hi", "lo"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOLDED:
            yield from stars()
            parent.clear()
    yield from stars()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node."""
    found = members(links, a, b)
    return found.union(found.select("component", "component").distinct())


def members(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that is linked to a smaller one, once each; the smallest nodes have no rows."""
    steps = Steps(links.sparkSession)
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    proper = links.where(F.col(a) != F.col(b)).select(high.alias("hi"), low.alias("lo"))
    edges = steps.put("edges", proper.mapInArrow(_fold, "hi long, lo long"))
    while not _stars(edges := steps.put("edges", _refold(edges))):
        # Large stars: each node's larger neighbours are linked to the smallest node around it.
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        # Small stars: each node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        edges = steps.put("edges", small.select("e.hi", "e.lo").where("hi != lo").distinct())
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _refold(edges: DataFrame) -> DataFrame:
    """The written links, folded in as few tasks as hold FOLDED links each."""
    return edges.coalesce(max(1, -(-edges.count() // FOLDED))).mapInArrow(_fold, "hi long, lo long")


def _stars(edges: DataFrame) -> bool:
    """Whether every node that links lower does so once, and to a node that doesn't."""
    ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("down")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("down"))))
    nodes = edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return nodes.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0))).isEmpty()
