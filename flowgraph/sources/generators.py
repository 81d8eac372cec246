"""Generated graphs and matrices, made on the executors from ranges and seeded arithmetic that SQL can state as well."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id of the vertex that collects the rank of chains' ends.
SINK = 0


def chain_graph(spark: SparkSession, k: int) -> DataFrame:
    """(src, dst): k chains of k vertices, ids 1 to k * k; the last vertex of each chain points to the sink."""
    node = F.col("id")
    return spark.range(1, k * k + 1).select(node.alias("src"), F.when(node % k == 0, F.lit(SINK)).otherwise(node + 1).cast("bigint").alias("dst"))


def chain_ranks(spark: SparkSession, k: int) -> DataFrame:
    """(node, rank): 0 for the sink, an equal share of 1 for the others."""
    return spark.range(0, k * k + 1).select(F.col("id").alias("node"), F.when(F.col("id") == SINK, 0.0).otherwise(1.0 / (k * k)).alias("rank"))


#: The prime that draws are made by, and a multiplier.
PRIME, FACTOR = 2_147_483_647, 48_271


def _uniform(key: Column, salt: int, below: int) -> Column:
    """A draw from 0 to below - 1: twice a multiplication modulo a prime, with a square between; no step exceeds 64 bits."""
    first = (F.pmod(key, F.lit(PRIME)) * FACTOR + (salt * 69_621 + 1) % PRIME) % PRIME
    return ((first * first % PRIME) * FACTOR + first) % PRIME % below


def uniform_sql(key: str, salt: int, below: int) -> str:
    """The same draw in SQL."""
    first = f"((({key}) % {PRIME}) * {FACTOR} + {(salt * 69_621 + 1) % PRIME}) % {PRIME}"
    return f"((({first}) * ({first}) % {PRIME}) * {FACTOR} + {first}) % {PRIME} % {below}"


def cell_step(cells: int, seed: int) -> int:
    """The factor of a seeded affine permutation of so many cells."""
    step = random.Random(seed).randrange(1, cells + 1)
    while math.gcd(step, cells) != 1:
        step += 1
    return step


def sparse_matrix(spark: SparkSession, rows: int, cols: int, density: float, seed: int = 0, largest: int = 99) -> DataFrame:
    """(row, col, val): round(rows * cols * density) distinct cells with values 1 to largest. Cells are the first so many of a
    seeded permutation of all of them (an affine map), so that no set of used cells has to be kept."""
    cells = rows * cols
    step = cell_step(cells, seed)
    cell = F.pmod(F.col("id").cast("decimal(38,0)") * F.lit(step).cast("decimal(19,0)") + F.lit(seed), F.lit(cells)).cast("bigint")
    out = spark.range(round(cells * density)).select(cell.alias("cell"))
    return out.select(F.expr(f"cell div {cols}").alias("row"), (F.col("cell") % cols).alias("col"), (_uniform(F.col("cell"), seed, largest) + 1).alias("val"))


def random_triples(spark: SparkSession, rows: int, cols: int, density: float, seed: int = 0) -> DataFrame:
    """(row, col, val): rows * cols * density independent cells, repeats possible, indices below the last one, values 0 to 99."""
    n = int(rows * cols * density)
    key = F.col("id")
    return spark.range(n).select(
        _uniform(key, 3 * seed, max(1, rows - 1)).alias("row"), _uniform(key, 3 * seed + 1, max(1, cols - 1)).alias("col"), _uniform(key, 3 * seed + 2, 100).alias("val")
    )


def random_sources(k: int, largest: int, seed: int = 0) -> list[int]:
    """k ids from 1 to largest, drawn with replacement."""
    draw = random.Random(seed)
    return [draw.randint(1, largest) for _ in range(k)]
