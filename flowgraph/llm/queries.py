"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import q_bpe, q_langid, q_license_scan, q_mixing, q_ngram_join, q_sharding, q_toxicity, q_url_filter, q_vectors

MODULES = (q_bpe, q_mixing, q_sharding, q_toxicity, q_langid, q_ngram_join, q_vectors, q_url_filter, q_license_scan)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
