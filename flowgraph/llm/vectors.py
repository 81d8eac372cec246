"""What the vector searches share: which rows take part, one row per distinct vector, and a stated query set dealt
against all rows in blocks of bounded size.

Equal vectors have equal scores and ties go to smaller ids, so that of each distinct vector only its k + 1 smallest ids can
be among the k best of any query (one more, as a query is not its own candidate). The rest of a hot vector's rows drop
out where they are read, and all queries of one vector are searched once. Repeated rows count once; an id that several
vectors carry stands for each of them: as a candidate it has its best score, as a query the best of their results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

#: Rows of a block, and queries that are searched with it at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id, v) of the rows that take part: no null id, no null vector, and no null or non-finite component; zero: whether
    vectors of zeros (or of no component) do."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.where(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    rows = rows.withColumn("v", F.transform(v, lambda x: x + F.lit(0.0)))  # one zero only
    return rows if zero else rows.where(F.exists(v, lambda x: x != F.lit(0.0)))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): each distinct vector with its k + 1 smallest ids, the smallest as rep."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return kept.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros, longer ones than width are cut."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = array.value_lengths().to_numpy()
    most = int(counts.max(initial=0)) if width is None else width
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(counts) and (counts == most).all():
        return flat.reshape(len(counts), most)
    out = np.zeros((len(counts), most))
    for i, (end, n) in enumerate(zip(np.cumsum(counts), counts)):
        out[i, : min(n, most)] = flat[end - n : end][:most]
    return out


def best(scores: np.ndarray, ids: list, k: int) -> tuple[list[int], list]:
    """The k + 1 best ids with their scores out of candidates (score, ascending ids of one vector); ties go to smaller ids."""
    if len(scores) > k + 1:
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    found = sorted((-scores[i], j) for i in near.tolist() for j in ids[i])[: k + 1]
    return [j for _, j in found], [-s for s, _ in found]


def search(
    blocks: DataFrame, queries: DataFrame, n_blocks: int, k: int, find: Callable, score_type: str, again: DataFrame | None = None
) -> DataFrame:
    """(rep, vec_id, score): the k + 1 best of each query vector. blocks: (block, rep, v, ids) of at most some BLOCK_ROWS rows a
    block; queries: (rep, v, chunk, chunks, least), dealt to every block in chunks; find(block, queries) returns, for a
    block and a chunk as Arrow tables, lists of rep, vec_id and score. again: rows of the same shape found before."""
    wide = blocks.crossJoin(F.broadcast(queries.agg(F.coalesce(F.max("chunks"), F.lit(1)).alias("chunks"))))  # one row
    left = wide.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", "rep", "v", "ids")
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("block", "chunk", "rep", "v", "least")

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        reps, found, scores = find(block, chunk) if len(block) and len(chunk) else ([], [], [])
        kind = pa.int64() if score_type == "long" else pa.float64()
        return pa.table({"rep": pa.array(reps, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, kind)})

    out = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, f"rep long, vec_id long, score {score_type}")
    out = out if again is None else out.unionByName(again)
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def query_vectors(rows: DataFrame, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """(query_id, rep) of every query, and (rep, v, chunk, chunks) of every distinct query vector."""
    asked = rows.where(is_query)
    reps = materialise(asked.groupBy("v").agg(F.min("id").alias("rep")), "queries")
    chunks = max(1, -(-reps.count() // BLOCK_QUERIES))
    of = asked.join(reps, "v").select(F.col("id").alias("query_id"), "rep").distinct()
    return of, reps.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(chunks).alias("chunks"))


def nearest(of: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query: what was found for its vector, without itself."""
    joined = of.join(found, "rep").where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
