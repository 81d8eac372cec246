"""Paths of two edges and directed triangles, each by several join strategies with equal results.

Edges are a bag: repeated edges multiply counts (distinct=True: they don't). Repeats are summed to weights first, so that
joins meet each pair of ends once, whatever its multiplicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import broadcast_if_small, materialise

HINTS = {"shuffle": "merge", "shuffle_hash": "shuffle_hash"}
STRATEGIES = ("shuffle", "shuffle_hash", "broadcast", "countproduct")


def weighted(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(src, dst, w)"""
    weight = F.lit(1).cast("bigint") if distinct else F.count(F.lit(1))
    return edges.groupBy("src", "dst").agg(weight.alias("w"))


def _other(df: DataFrame, strategy: str) -> DataFrame:
    """df as the build side of a join."""
    return broadcast_if_small(df) if strategy == "broadcast" else df.hint(HINTS[strategy])


def path2_count(edges: DataFrame, strategy: str = "degree") -> DataFrame:
    """(paths): the number of paths of two edges, those that end where they start among them. degree: in-degree times
    out-degree, summed over the vertices in between, by a shuffle; broadcast: each edge adds the out-degree of its end,
    looked up in a table that is broadcast if it is small."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n_out"))
    if strategy == "degree":
        into = edges.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n_in"))
        total = F.sum(F.col("n_in") * F.col("n_out"))
        joined = into.join(out, "v")
    elif strategy == "broadcast":
        total, joined = F.sum("n_out"), edges.select(F.col("dst").alias("v")).join(broadcast_if_small(out), "v")
    else:
        raise ValueError("strategy must be degree or broadcast")
    return joined.agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("paths"))


def path2_edges(edges: DataFrame, strategy: str = "shuffle", exclude_return: bool = True, distinct: bool = False) -> DataFrame:
    """(src, dst, paths): how many paths of two edges lead from src to dst; exclude_return: not back to the start."""
    w = weighted(edges, distinct)
    first = w.select("src", F.col("dst").alias("mid"), F.col("w").alias("w1"))
    second = _other(w.select(F.col("src").alias("mid"), "dst", F.col("w").alias("w2")), strategy)
    joined = first.join(second, "mid")
    if exclude_return:
        joined = joined.where(F.col("src") != F.col("dst"))
    return joined.groupBy("src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).cast("bigint").alias("paths"))


def triangles(edges: DataFrame, strategy: str = "shuffle", exclude_return: bool = True, distinct: bool = False) -> DataFrame:
    """(closed_paths, triangles): paths of two edges that an edge closes, and a third of them, rounded down.

    countproduct multiplies the number of paths between two vertices with that of edges back. The other strategies meet
    each cycle of three vertices once, in the middle of a path at its vertex of least degree (ties: least id), and count it
    three times. No vertex has more than the square root of twice the edges as neighbours of its degree or more, so that a
    hub is no hot key: it is in the middle of hardly any path. What self-loops add (paths through a loop) is a sum over
    pairs of opposite edges."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "countproduct":
        paths = path2_edges(edges, "shuffle", exclude_return, distinct)
        back = weighted(edges, distinct).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        closed = paths.join(back, ["src", "dst"]).agg(F.coalesce(F.sum(F.col("paths") * F.col("w")), F.lit(0)).cast("bigint").alias("closed_paths"))
        return closed.withColumn("triangles", F.expr("closed_paths div 3"))
    w = materialise(weighted(edges, distinct), "weights")  # read four times
    proper = w.where(F.col("src") != F.col("dst"))
    ends = proper.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    ranked = proper.join(ends.select(F.col("v").alias("src"), F.col("degree").alias("src_degree")), "src")
    ranked = ranked.join(ends.select(F.col("v").alias("dst"), F.col("degree").alias("dst_degree")), "dst")
    rises = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
    ranked = materialise(ranked.select("src", "dst", "w", rises.alias("rises")), "ranked")
    first = ranked.where(~F.col("rises")).select(F.col("src").alias("a"), F.col("dst").alias("m"), F.col("w").alias("w1"))
    second = _other(ranked.where("rises").select(F.col("src").alias("m"), F.col("dst").alias("b"), F.col("w").alias("w2")), strategy)
    third = _other(proper.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("w").alias("w3")), strategy)
    cycles = first.join(second, "m").where(F.col("a") != F.col("b")).join(third, ["a", "b"])
    parts = [cycles.select((3 * F.col("w1") * F.col("w2") * F.col("w3")).alias("n"))]
    loops = w.where(F.col("src") == F.col("dst")).select(F.col("src").alias("v"), F.col("w").alias("loops"))
    out, back = proper.alias("o"), proper.alias("r")
    at_loop = (F.col("o.src") == F.col("r.dst")) & (F.col("o.dst") == F.col("r.src"))
    pairs = out.join(loops, F.col("o.src") == F.col("v")).join(back, at_loop).select((F.col("o.w") * F.col("r.w") * F.col("loops")).alias("n"))
    # With a loop at v and edges v -> u -> v, the loop can be the first or the second edge of a path between them.
    parts.append(pairs.select((2 * F.col("n")).alias("n")))
    if not exclude_return:
        parts += [pairs, loops.select((F.col("loops") * F.col("loops") * F.col("loops")).alias("n"))]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("closed_paths")).withColumn("triangles", F.expr("closed_paths div 3"))
