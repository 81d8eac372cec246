"""Exact top-k search by inner product over integer vectors, by norm buckets.

Vectors are ordered by length and cut into buckets, the longest first: blocks of the table, and in them runs of rows that
grow. The first block is searched first and gives every query a score that its k best must reach; in a block that score
rises from bucket to bucket. Over the query's length and the bucket's largest it is a local threshold of the cosine: above
1 the bucket is skipped; vectors that are too short are pruned by length; if it is high the coordinate bounds that it
implies prune (a vector of at least that cosine has its coordinates near the query's, most of all in the query's largest
ones); then the products over the query's largest coordinates do, with the lengths of what is left of both as a bound of
the rest. What is left is verified by its product. Nothing is pruned that could tie, and all of this runs at every size.

Products are taken in double precision while they are exact there, else in whole numbers without bound; scores beyond
64 bits are cut to the nearest that has 64.

Cases: vectors that are null or hold null or non-finite components (or such that are not finite times the scale) take no
part, nor do rows of null id; zero vectors do, with score 0; equal vectors, ties, repeated rows and an id on several
vectors: see vectors; rows of a query's own id are not its candidates; shorter vectors count as ending in zeros; an empty
table gives an empty result. Extra columns are not read, and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, ship
from .vectors import BLOCK_ROWS, best, distinct_vectors, matrix, nearest, query_vectors, search, usable

#: From this local threshold on coordinates prune, below it lengths do; and the query's largest coordinates that are looked at.
COORDINATE_COSINE, FOCUS = 0.6, 4
#: Shares of the query's coordinates, largest first, whose products prune in turn.
PARTS = (0.5, 0.75)
#: Ranges of length of the table, before those of too many rows are cut further; rows of a block's first bucket.
BUCKETS, FIRST = 64, 256
LARGEST = (1 << 63) - 1


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exactly, as 64-bit numbers."""
    bound = np.abs(vectors).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if bound < 2.0**53:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    sums = [sum(int(a) * b for a, b in zip(row, whole)) for row in vectors]
    return np.array([max(-LARGEST - 1, min(LARGEST, x)) for x in sums], np.int64)


def pruned(vectors: np.ndarray, lengths: np.ndarray, query: np.ndarray, least: float) -> np.ndarray:
    """The rows (in descending order of length) whose product with the query can reach `least`; all bounds are loosened for rounding."""
    n = float(np.linalg.norm(query))
    if not len(vectors) or least <= 0 or n == 0:
        return np.arange(len(vectors)) if least <= 0 or n == 0 and least <= 0 else np.empty(0, np.int64)
    cosine = least / (n * max(lengths[0], 1e-300)) * (1 - 1e-9)
    if cosine > 1:
        return np.empty(0, np.int64)
    long_enough = len(lengths) - int(np.searchsorted(lengths[::-1], least / n * (1 - 1e-9)))
    rows, unit = np.arange(long_enough), query / n
    largest = np.argsort(-np.abs(unit), kind="stable")
    for f in largest[:FOCUS].tolist() if cosine >= COORDINATE_COSINE else ():
        spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[f] ** 2)))
        at = vectors[rows, f] / np.maximum(lengths[rows], 1e-300)
        bottom, top = cosine * unit[f] - spread - 1e-9, cosine * unit[f] + spread + 1e-9
        # Towards the query's own direction a coordinate may go further: there the bound is the unit sphere's.
        if unit[f] >= 0:
            top = 1.0 + 1e-9 if cosine <= unit[f] else unit[f] * cosine + spread + 1e-9
        else:
            bottom = -1.0 - 1e-9 if cosine <= -unit[f] else unit[f] * cosine - spread - 1e-9
        rows = rows[(at >= bottom) & (at <= top)]
    for part in PARTS:
        front = largest[: max(1, int(len(query) * part))]
        own = vectors[rows][:, front]
        rest = np.sqrt(np.maximum(0.0, lengths[rows] ** 2 - np.einsum("ij,ij->i", own, own))) * np.linalg.norm(np.delete(query, front))
        rows = rows[~(own @ query[front] + rest < least - 1e-6 * n * lengths[0])]  # numbers too large for a bound stay
    return rows


def scan(vectors: np.ndarray, lengths: np.ndarray, ids: list, query: np.ndarray, k: int, bound: float) -> tuple[list, list, int]:
    """The k + 1 best ids of a block (in descending order of length) with their scores, of those that reach the bound; and how
    many rows were verified."""
    found, scores, start, step, verified = [], [], 0, FIRST, 0
    while start < len(vectors):
        part = slice(start, start + step)
        near = np.arange(len(vectors[part])) if bound == -np.inf else pruned(vectors[part], lengths[part], query, bound)
        verified += len(near)
        more = products(vectors[part][near], query)
        near, more = near[more >= bound] + start, more[more >= bound]
        every = np.concatenate([np.array(scores, np.int64), more])
        found, scores = best(every, [[x] for x in found] + [ids[i] for i in near.tolist()], k)
        if len(found) > k:
            bound = max(bound, float(scores[-1]))
        start, step = start + step, 2 * step
    return found, scores, verified


def top_products(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query (a condition on the column id) the k rows of highest inner
    product, components being floor(scale * x)."""
    ship(df.sparkSession)
    rows = usable(df, key, vector, zero=True)
    v = F.transform("v", lambda x: _floor(x * F.lit(scale)))
    rows = rows.withColumn("v", v).where(F.forall("v", lambda x: F.abs(x) < F.lit(float("inf"))))
    rows = materialise(rows, "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    reps = materialise(distinct_vectors(rows, k).withColumn("length", length), "distinct")
    total = reps.count()
    n = max(1, min(BUCKETS, -(-total // BLOCK_ROWS)))
    cuts = reps.agg(F.percentile_approx("length", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if n > 1 else []
    bucket = F.lit(len(cuts)) - sum((F.when(F.col("length") > c, 1).otherwise(0) for c in cuts), F.lit(0))  # 0: the longest
    placed = reps.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # BUCKETS rows at most
    first, parts, at = {}, {}, 0
    for b in range(len(cuts) + 1):
        first[b], parts[b] = at, max(1, -(-sizes.get(b, 0) // BLOCK_ROWS))
        at += parts[b]
    pick = lambda of: F.element_at(F.create_map(*[F.lit(x) for b in of for x in (b, of[b])]), F.col("bucket"))
    blocks = placed.withColumn("block", (pick(first) + F.pmod(F.xxhash64("rep", F.lit(5)), pick(parts))).cast("int"))
    of, queries = query_vectors(rows, is_query)

    def find(block: pa.Table, chunk: pa.Table) -> tuple[list, list, list]:
        vectors, ids = matrix(block["v"]), block["ids"].to_pylist()
        asked, reps, least = matrix(chunk["v"], vectors.shape[1]), chunk["rep"].to_pylist(), chunk["least"].to_pylist()
        lengths = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-lengths, kind="stable")
        vectors, lengths, ids = vectors[order], lengths[order], [ids[i] for i in order.tolist()]
        out: tuple[list, list, list] = ([], [], [])
        for i, rep in enumerate(reps):
            found, scores, _ = scan(vectors, lengths, ids, asked[i], k, -np.inf if least[i] is None else float(least[i]))
            out[0].extend([rep] * len(found))
            out[1].extend(found)
            out[2].extend(map(int, scores))
        return out

    none = F.lit(None).cast("long")
    ahead = materialise(search(blocks.where("block = 0"), queries.withColumn("least", none), 1, k, find, "long"), "first")
    if at == 1:
        return nearest(of, ahead, k)
    reached = ahead.groupBy("rep").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))
    rest = blocks.where("block > 0").withColumn("block", F.col("block") - 1)
    return nearest(of, search(rest, queries.join(reached, "rep", "left"), at - 1, k, find, "long", ahead), k)


def _floor(x):
    """floor() as a double, for any finite double (Spark's own gives a 64-bit number)."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double") + F.lit(0.0)).otherwise(x)
