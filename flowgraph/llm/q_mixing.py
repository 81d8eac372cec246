"""op2: all documents mixed to the weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import SEED, copies
from .tables import read


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = copies(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    size = F.col("mix.size")
    return mix.select("doc_id", size.alias("size"), F.col("mix.source_size"), F.col("mix.target"), (size * F.col("mix.copies")).alias("taken"))


MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM sums),
weighed AS (
  SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS stop FROM placed),
filled AS (
  SELECT *,
    ((SELECT sum(source_size) FROM weighed) - (sum(stop) OVER o - stop))
      / ((SELECT sum(weight) FROM weighed) - (sum(weight) OVER o - weight)) AS level
  FROM weighed
  WINDOW o AS (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
water AS (
  SELECT level FROM filled WHERE level * weight <= stop ORDER BY stop / weight, place LIMIT 1),
goals AS (
  SELECT source, source_size, least(stop, coalesce((SELECT level FROM water) * weight, stop)) AS target FROM weighed),
rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS chance
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

QUERIES = {"op2_mix": op2_mix}
SQL = {"op2_mix": MIX_SQL}
