"""op3: all documents put into 24 shards by their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import MULTIPLIER, PART_ROWS, PARTS, sharded
from .tables import read

SHARDS = 24


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# DuckDB has no CRC-32: the sum is written out over the bytes of each text, four bits at a time.
SHARD_SQL = f"""
WITH RECURSIVE nibble AS (
  SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
  FROM range(16) t(i)),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM nibble),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 0) AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT d.*, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h) + 1), lambda i: (('0x' || substr(h, CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1))::UBIGINT))),
    lambda a, x: xor(a >> 4, tab.t[CAST(xor(a, x) & 15 AS BIGINT) + 1]))) AS crc
  FROM docs d, tab),
jump(r, k, b, j) AS (
  SELECT r, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key::HUGEINT END, -1::BIGINT, 0::BIGINT FROM docs
  UNION ALL
  SELECT r, n, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, j, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS n FROM jump WHERE j < {SHARDS + 1})),
placed AS (
  SELECT r, max(b) FILTER (b < {SHARDS}) AS shard, max(b) AS grown FROM jump GROUP BY r),
rows AS (
  SELECT d.doc_id, CAST(len(h) // 2 + 8 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law,
    CAST(shard AS INTEGER) AS shard, CAST(grown AS INTEGER) AS grown_shard, (key + CAST(crc AS BIGINT)) % parts AS part
  FROM crc d JOIN placed USING (r), (SELECT greatest({PARTS}, CAST(ceil(count(*) / {SHARDS * PART_ROWS}.0) AS BIGINT)) AS parts FROM docs))
SELECT doc_id, size, text_crc32, law, shard, grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot
FROM rows
"""

QUERIES = {"op3_shard": op3_shard}
SQL = {"op3_shard": SHARD_SQL}
