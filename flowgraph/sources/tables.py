"""Graphs and matrices out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts on neighbouring lines of an order, as a simple directed graph without self-loops."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).where(F.col("l_partkey") != F.col("dst"))
    return pairs.select(F.col("l_partkey").alias("src"), "dst").distinct()


COPURCHASE_SQL = """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey
"""


def user_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each event's user and the next event's, with duplicates and self-loops. The order is found day by day;
    only the first event of each day is ordered among the days. Events without a time come last."""
    events = read(spark, sf_dir, "events").select("ts", "event_id", "user_id").withColumn("day", F.to_date("ts"))
    order = F.struct("ts", "event_id")
    within = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id")))
    days = events.groupBy("day").agg(F.min_by("user_id", order).alias("first"))
    days = days.select("day", F.lead("first").over(Window.orderBy(F.col("day").asc_nulls_last())).alias("tomorrow"))  # one row a day
    days = days.withColumnRenamed("day", "of")
    joined = within.join(days, F.col("day").eqNullSafe(F.col("of"))).select(F.col("user_id").alias("src"), F.coalesce("next", "tomorrow").alias("dst"))
    return joined.where(F.col("dst").isNotNull())


USER_SEQUENCE_SQL = """
SELECT src, dst FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL
"""


def large_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts as nodes, and edges into the parts ordered in large quantity, so that some nodes have none."""
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return nodes, lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


#: Extents of the two matrices: I x K and K x J.
SIZES = (200, 200, 50)


def matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(i, k, v) and (k, j, v) of whole numbers."""
    lines = read(spark, sf_dir, "lineitem")
    n, m, p = SIZES
    whole = lambda c: F.sum(F.col(c).cast("bigint")).alias("v")
    a = lines.groupBy((F.col("l_orderkey") % n).alias("i"), (F.col("l_partkey") % m).alias("k")).agg(whole("l_quantity"))
    b = lines.groupBy((F.col("l_partkey") % m).alias("k"), (F.col("l_suppkey") % p).alias("j")).agg(whole("l_linenumber"))
    return a, b


MATRICES_SQL = """
a AS (SELECT l_orderkey % 200 AS i, l_partkey % 200 AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_partkey % 200 AS k, l_suppkey % 50 AS j, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)
"""
