"""PageRank with a sink: what vertices without edges collect at the sink is shared out among all others each round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import materialise, partitioned
from ..sources.generators import SINK


def spread(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, got): each vertex shares its rank among its edges, which carry its out-degree in `fan`; one join, one sum."""
    sent = edges.join(ranks, edges["src"] == ranks["node"]).select(F.col("dst").alias("node"), (F.col("rank") / F.col("fan")).alias("got"))
    return sent.unionByName(ranks.select("node", F.lit(0.0).alias("got"))).groupBy("node").agg(F.sum("got").alias("got"))


def settled(got: DataFrame, sunk: Column, n: int, damping: float = 1.0) -> DataFrame:
    """(node, rank): the sink keeps what it got, and its part (times damping, plus the rest of 1) is added in equal shares to the
    n other vertices."""
    shared = F.lit(damping) * (F.col("got") + sunk / F.lit(n)) + F.lit((1.0 - damping) / n)
    return got.select("node", F.when(F.col("node") == SINK, F.col("got")).otherwise(shared).alias("rank"))


def step(edges: DataFrame, ranks: DataFrame, n: int, damping: float = 1.0) -> DataFrame:
    """(node, rank) after one round, as one plan."""
    got = spread(edges, ranks)
    at_sink = got.where(F.col("node") == SINK).agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("sunk"))
    return settled(got.crossJoin(F.broadcast(at_sink)), F.col("sunk"), n, damping)  # one row


def with_fan(edges: DataFrame) -> DataFrame:
    """edges with the out-degree of their source."""
    return edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("fan")), "src")


def sunk(edges: DataFrame) -> DataFrame:
    """edges, and one to the sink from every vertex without edges out of it."""
    ends = edges.select(F.col("dst").alias("src")).distinct().join(edges.select("src").distinct(), "src", "left_anti").where(F.col("src") != SINK)
    return edges.select("src", "dst").unionByName(ends.select("src", F.lit(SINK).cast("bigint").alias("dst")))


def pagerank(edges: DataFrame, ranks: DataFrame, rounds: int = 10, damping: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(node, rank) after `rounds` rounds, and the history (iteration, mass): the ranks of all but the sink, which sum to 1. Of
    each round two numbers go to the driver, what reached the sink and what reached the others."""
    spark, at_sink = ranks.sparkSession, F.col("node") == SINK
    n = ranks.where(~at_sink).count()
    edges, masses = partitioned(materialise(with_fan(edges), "edges"), "src"), []
    try:
        for round_ in range(1, rounds + 1):
            got = materialise(spread(edges, ranks), "ranks")
            sunk, rest = got.agg(F.sum(F.when(at_sink, F.col("got")).otherwise(0.0)), F.sum(F.when(at_sink, 0.0).otherwise(F.col("got")))).first()
            masses.append((round_, damping * (rest + sunk) + 1.0 - damping))
            ranks = settled(got, F.lit(sunk), n, damping)
    finally:
        edges.unpersist()
    return ranks, spark.createDataFrame(masses, "iteration int, mass double")


def first(ranks: DataFrame, n: int = 101) -> DataFrame:
    """The ranks of the n smallest ids, in order."""
    return ranks.orderBy("node").limit(n)
