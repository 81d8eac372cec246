"""op4 and op7: the nearest rows of every twentieth embedding, found approximately and exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_products
from .tables import read
from .topk import top_products


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_products(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

QUERIES = {"op4_ann": op4_ann, "op7_topk": op7_topk}
SQL = {"op7_topk": TOPK_SQL}
