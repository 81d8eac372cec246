"""Hop distances from several sources at once, and eccentricities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import iterate
from ..plans.checkpoint import materialise, partitioned
from .combine import vertices


#: Rounds after which the distances found so far are written as one table: plans stay bounded however long the paths are.
COMPACT = 8


def start(edges: DataFrame, sources: list[int]) -> DataFrame:
    """(source, node, dist): every source that the graph has, at itself. Absent sources have no rows; repeats count once."""
    spark = edges.sparkSession
    wanted = spark.createDataFrame([(int(s),) for s in sorted(set(sources))], "node bigint")
    # The sources are a parameter list: they are broadcast, the vertices are not.
    present = vertices(edges).join(F.broadcast(wanted), "node")
    return present.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"))


def relax(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(source, node, dist): one hop on from every row of the frontier, once a node."""
    hop = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + 1).alias("dist"))
    return hop.groupBy("source", "node").agg(F.min("dist").alias("dist"))


def distances(edges: DataFrame, sources: list[int], max_iter: int | None = None) -> DataFrame:
    """(source, node, dist) of all reached nodes, after max_iter rounds or (None) when no distance changes any more. Only
    rows found in the last round are relaxed in the next one."""
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    frontier = known = materialise(start(edges, sources), "distances")
    edges = partitioned(edges, "src")

    def hop(now: DataFrame, _: int) -> DataFrame:
        return relax(edges, now).join(known, ["source", "node"], "left_anti")

    def done(now: DataFrame, round_: int) -> bool:
        nonlocal known
        if now.isEmpty():
            return True
        known = known.unionByName(now)
        if round_ % COMPACT == 0:
            known = materialise(known, "distances")
        return False

    try:
        iterate.run(frontier, hop, max_iter, done)
    finally:
        edges.unpersist()
    return known


def eccentricity(found: DataFrame, sources: list[int] | None = None, unreached: float | None = None) -> DataFrame:
    """(source, eccentricity): the largest finite distance from each source. sources: those asked for, with `unreached` for
    the ones that the graph does not have."""
    most = found.groupBy("source").agg(F.max("dist").cast("double" if unreached is not None else "int").alias("eccentricity"))
    if sources is None:
        return most
    asked = found.sparkSession.createDataFrame([(int(s),) for s in sorted(set(sources))], "source bigint")
    return asked.join(most, "source", "left").select("source", F.coalesce("eccentricity", F.lit(unreached)).alias("eccentricity"))


def by_source(found: DataFrame, sources: list[int]) -> DataFrame:
    """(node, d_<source> ...): a column a source; null where a node was not reached."""
    wide = found.groupBy("node").pivot("source", [int(s) for s in sources]).agg(F.min("dist"))
    return wide.select("node", *[F.col(f"`{s}`").alias(f"d_{s}") for s in sources])


def node_states(edges: DataFrame, found: DataFrame, sources: list[int]) -> DataFrame:
    """Vertex states: nodeId, adjList, isObj, isActive, kMap {source: distance}."""
    lists = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.col("dst").cast("int"))).alias("adjList"))
    reached = found.groupBy("node").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("source").cast("int"), "dist")))).alias("kMap"))
    rows = vertices(edges).join(lists, "node", "left").join(reached, "node", "left")
    empty = F.array().cast("array<int>")
    return rows.select(
        F.col("node").cast("int").alias("nodeId"),
        F.coalesce("adjList", empty).alias("adjList"),
        F.col("node").isin([int(s) for s in sources]).alias("isObj"),
        F.lit(False).alias("isActive"),
        F.coalesce("kMap", F.create_map().cast("map<int,int>")).alias("kMap"),
    )
