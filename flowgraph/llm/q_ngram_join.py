"""op5: classes of documents that are near copies of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import near_duplicates
from .tables import LOWER, UPPER, read


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


JOIN_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS grams FROM w),
sets AS MATERIALIZED (SELECT grams, min(doc_id) AS doc, len(grams) AS n FROM (SELECT doc_id, list_sort(grams) AS grams FROM s) WHERE len(grams) > 0 GROUP BY grams),
g AS MATERIALIZED (SELECT doc, n, unnest(grams) AS gram FROM sets),
links AS MATERIALIZED (
  SELECT a.doc AS a, b.doc AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc <> b.doc
  GROUP BY a.doc, b.doc, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(doc, other) AS (SELECT doc, doc FROM sets UNION SELECT r.doc, l.b FROM reached r JOIN links l ON l.a = r.other),
classes AS (SELECT doc, min(other) AS component FROM reached GROUP BY doc)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id
FROM s LEFT JOIN sets ON len(s.grams) > 0 AND list_sort(s.grams) = sets.grams LEFT JOIN classes c ON c.doc = sets.doc
"""

QUERIES = {"op5_ngram_join": op5_ngram_join}
SQL: dict[str, str] = {"op5_ngram_join": JOIN_SQL}
