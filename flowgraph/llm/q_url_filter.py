"""op6: the verdict on every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import url_filter as u
from .tables import LOWER, UPPER, read

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return u.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


#: Levels that the SQL is written out to; it holds for tables without longer paths.
SQL_LEVELS = 4


def _tree(name: str, group: str, before: str) -> list[str]:
    """The levels of a tree of templates: {name}0 has each url's group and the empty template, the last has the whole ones."""
    out = [f"{name}0 AS (SELECT *, {group} AS g_{name}, '' AS t_{name} FROM {before})"]
    for d in range(SQL_LEVELS):
        out.append(f"""
{name}c{d} AS (
  SELECT g_{name} AS g, t_{name} AS t, parts[{d + 1}] AS seg, count(*) AS n, count(*) FILTER (label = 'block') AS b
  FROM {name}{d} WHERE len(parts) > {d} GROUP BY ALL),
{name}n{d} AS (
  SELECT g, t, CAST(sum(n) AS DOUBLE) AS all_n, CAST(sum(b) AS DOUBLE) AS all_b, count(*) AS k FROM {name}c{d} GROUP BY ALL),
{name}k{d} AS (
  SELECT c.g, c.t, c.seg,
    CASE WHEN k >= {u.CHILDREN} AND all_n < k * {u.REPEATS} THEN '/*'
      WHEN all_b > 0 AND all_b < all_n AND (b - n * (all_b / all_n)) * (b - n * (all_b / all_n))
        >= {u.CHI_SQUARE}::DOUBLE * (n * (all_b / all_n) * (1 - all_b / all_n)) THEN '/=' || c.seg
      ELSE '/~' END AS branch
  FROM {name}c{d} c JOIN {name}n{d} USING (g, t)),
{name}{d + 1} AS (
  SELECT u.* REPLACE (CASE WHEN len(parts) > {d} THEN u.t_{name} || branch ELSE u.t_{name} END AS t_{name})
  FROM {name}{d} u LEFT JOIN {name}k{d} k ON u.g_{name} = k.g AND u.t_{name} = k.t AND len(parts) > {d} AND u.parts[{d + 1}] = k.seg)""")
    return out


def sql(rules: dict[str, str] = RULES) -> str:
    """The same in SQL, with the levels of the trees written out."""
    fits = [
        (rule, verdict, f"((host = '{rule.split('/', 1)[0]}' OR suffix(host, '.{rule.split('/', 1)[0]}')) AND prefix(path, '/{rule.split('/', 1)[1]}'))")
        for rule, verdict in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0]))
    ]
    smooth, last = f"{u.SMOOTH}::DOUBLE", f"e{SQL_LEVELS}"
    parts = [rf"""WITH split AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
sited AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r}'" for r, _, f in fits)} END AS rule,
    CASE {' '.join(f"WHEN {f} THEN '{v}'" for _, v, f in fits)} END AS label,
    CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS parts FROM sited)""",
        *_tree("h", "host", "ruled"), *_tree("e", "''", f"h{SQL_LEVELS}"), f"""
common AS (
  SELECT t_e, (count(*) FILTER (label = 'block') + {smooth} * 0.5::DOUBLE) / (count(label) + {smooth}) AS prior FROM {last} GROUP BY ALL),
leaf AS (
  SELECT host, t_h, count(*) FILTER (label = 'block') AS n_blocked, count(label) AS n_decided FROM {last} GROUP BY ALL),
pure AS (
  SELECT page_id, host, path, rule, label, t_h AS template, (n_blocked + {smooth} * prior) / (n_decided + {smooth}) AS purity
  FROM {last} JOIN common USING (t_e) JOIN leaf USING (host, t_h))
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= {u.LEAST}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM pure"""]  # fmt: skip
    return ",".join(parts)


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {"op6_url_filter": sql()}
