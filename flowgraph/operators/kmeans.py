"""One-dimensional k-means over a histogram of whole numbers.

Sums are taken in whole numbers and divided once, so that results do not depend on the order of rows. Ties go to the
lower centroid; clusters that no point is nearest to vanish; a round's error is measured against the centroids that
its points were assigned to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import materialise

# The first centroids, the move that counts as none, and the most rounds.
SEEDS, TOLERANCE, ROUNDS = (1.0, 2.0, 3.0, 4.0), 0.001, 10


def histogram(points: DataFrame, x: str = "followers") -> DataFrame:
    """(x, n)"""
    return points.groupBy(F.col(x).cast("bigint").alias("x")).agg(F.count(F.lit(1)).alias("n"))


def step(hist: DataFrame, centroids: list[float]) -> DataFrame:
    """(old, centroid, n, sse) of the clusters that have points. The centroids, k numbers, are literals of the plan."""
    options = F.array(*[F.lit(float(c)) for c in sorted(set(centroids))])
    nearest = F.array_min(F.transform(options, lambda c: F.struct(F.abs(F.col("x") - c).alias("d"), c.alias("c"))))["c"]
    x, n = F.col("x"), F.col("n")
    sums = hist.groupBy(nearest.alias("old")).agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"))
    sse = F.col("sxx") - 2 * F.col("old") * F.col("sx") + F.col("old") * F.col("old") * F.col("n")
    return sums.select("old", (F.col("sx") / F.col("n")).alias("centroid"), "n", sse.alias("sse"))


def kmeans(hist: DataFrame, seeds: tuple[float, ...] = SEEDS, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(centroid) in the end, and the history (iteration, centroid, n, sse): until no centroid moves by more than the
    tolerance, or for the given number of rounds."""
    hist, now, history = materialise(hist, "histogram"), [float(s) for s in seeds], []
    for round_ in range(1, rounds + 1):
        found = sorted(step(hist, now).collect(), key=lambda r: r["centroid"])  # k rows at most
        history += [(round_, r["centroid"], r["n"], float(r["sse"])) for r in found]
        now = [r["centroid"] for r in found]
        if all(abs(r["centroid"] - r["old"]) <= tolerance for r in found):
            break
    spark = hist.sparkSession
    return spark.createDataFrame([(c,) for c in now], "centroid double"), spark.createDataFrame(history, "iteration int, centroid double, n bigint, sse double")
