"""Products of sparse matrices of whole numbers, by three ways of partitioning with equal results.

Cells are (i, k, v) and (k, j, v); repeated cells add up. coo joins on the inner index and sums. block deals both
matrices out over a grid of rows x inner x columns blocks, each cell copied along the dimension that it lacks, and
multiplies block by block. cannon rolls square blocks past each other: in step s block (i, j) meets A's block
(i, i + j + s) and B's block (i + j + s, j); the steps are rows of one plan and not a loop of jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import block_of, rolled

STRATEGIES = ("coo", "block", "cannon")


def block_coordinates(cells: DataFrame, row: str, col: str, sizes: tuple[int, int], parts: tuple[int, int]) -> DataFrame:
    """cells with the row and column of the block that each lies in."""
    return cells.withColumn("block_row", block_of(F.col(row), sizes[0], parts[0])).withColumn("block_col", block_of(F.col(col), sizes[1], parts[1]))


def _steps(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def multiply(
    a: DataFrame, b: DataFrame, strategy: str = "coo", sizes: tuple[int, int, int] | None = None, grid: tuple[int, int, int] = (5, 4, 5), side: int = 4,
    drop_zeros: bool = False, distinct: bool = False,
) -> DataFrame:
    """(i, j, v) of a (i, k, v) times b (k, j, v). sizes: extents of i, k and j, which block and cannon need (they need not be
    divisible). drop_zeros leaves out cells that are 0 in the end; distinct takes one of repeated cells (the largest)."""
    one = F.max if distinct else F.sum
    a = a.groupBy("i", "k").agg(one(F.col("v").cast("bigint")).cast("bigint").alias("va"))
    b = b.groupBy("k", "j").agg(one(F.col("v").cast("bigint")).cast("bigint").alias("vb"))
    if strategy == "coo":
        pairs = a.join(b, "k")
    elif strategy == "block":
        rows, inner, cols = grid
        a = a.withColumn("bi", block_of(F.col("i"), sizes[0], rows)).withColumn("bk", block_of(F.col("k"), sizes[1], inner)).withColumn("bj", _steps(cols))
        b = b.withColumn("bj", block_of(F.col("j"), sizes[2], cols)).withColumn("bk", block_of(F.col("k"), sizes[1], inner)).withColumn("bi", _steps(rows))
        pairs = a.join(b, ["bi", "bk", "bj", "k"])
    elif strategy == "cannon":
        a = a.withColumn("bi", block_of(F.col("i"), sizes[0], side)).withColumn("bk", block_of(F.col("k"), sizes[1], side)).withColumn("step", _steps(side))
        b = b.withColumn("bj", block_of(F.col("j"), sizes[2], side)).withColumn("bk", block_of(F.col("k"), sizes[1], side)).withColumn("step", _steps(side))
        a = a.withColumn("bj", rolled(F.col("bk"), F.col("bi") + F.col("step"), side))
        b = b.withColumn("bi", rolled(F.col("bk"), F.col("bj") + F.col("step"), side))
        pairs = a.drop("bk").join(b.drop("bk"), ["bi", "bj", "step", "k"])
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    out = pairs.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).cast("bigint").alias("v"))
    return out.where("v != 0") if drop_zeros else out
