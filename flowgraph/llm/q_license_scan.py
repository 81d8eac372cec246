"""op9: the licence notices in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import LEAST, TEMPLATES, scan
from .tables import read


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # The best match: of the highest score, then the first by name.
    best = F.array_min(F.transform("licenses", lambda x: F.struct((-x["score"]).alias("minus"), x["license"].alias("license"))))
    lines = F.sort_array(F.transform("licenses", lambda x: x["line"]))
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        F.coalesce(-best["minus"], F.lit(0.0)).alias("score"),
        F.size("licenses").cast("long").alias("n_matches"),
        F.coalesce(F.get(lines, F.lit(0)), F.lit(-1)).alias("first_line"),
    )


def sql() -> str:
    quoted = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES.items())
    return rf"""
WITH raw AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS body FROM raw
  UNION ALL SELECT r, 0, text FROM raw WHERE len(parts) > 1),
cut AS (
  SELECT r, line, list_transform(regexp_extract_all(body, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM units),
given AS (
  SELECT license, list_transform(regexp_extract_all(body, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM (VALUES {quoted}) t(license, body)),
bags AS (
  SELECT license, len(w) - 1 AS size, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM given),
near AS (
  SELECT r, line, len(w) - 1 AS size, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM cut
  WHERE len(w) > 1 AND EXISTS (SELECT 1 FROM bags b WHERE 2 * least(len(w) - 1, b.size) >= {LEAST}::DOUBLE * (len(w) - 1 + b.size))),
counted AS (SELECT r, line, size, g, count(*) AS n FROM (SELECT r, line, size, unnest(g) AS g FROM near) GROUP BY ALL),
template AS (SELECT license, size AS tsize, g, count(*) AS m FROM (SELECT license, size, unnest(g) AS g FROM bags) GROUP BY ALL),
scored AS (
  SELECT r, line, license, 2 * CAST(sum(least(n, m)) AS DOUBLE) / CAST(any_value(size) + any_value(tsize) AS DOUBLE) AS score
  FROM counted JOIN template USING (g)
  WHERE 2 * least(size, tsize) >= {LEAST}::DOUBLE * (size + tsize) GROUP BY r, line, license),
hits AS (
  SELECT r, line, license, score FROM scored WHERE score >= {LEAST}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY score DESC, license) = 1),
best AS (SELECT r, license, score FROM hits QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
sums AS (SELECT r, count(*) AS n_matches, min(line) AS first_line FROM hits GROUP BY r)
SELECT doc_id, license, coalesce(score, 0) AS score, coalesce(n_matches, 0) AS n_matches, CAST(coalesce(first_line, -1) AS INTEGER) AS first_line
FROM raw LEFT JOIN best USING (r) LEFT JOIN sums USING (r)
"""


QUERIES = {"op9_license_scan": op9_license_scan}
SQL = {"op9_license_scan": sql()}
