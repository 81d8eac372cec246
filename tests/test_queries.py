"""Every query of the core against its SQL, on the smallest tables."""

import importlib
import sys

import pytest

from flowgraph import queries


@pytest.fixture(scope="module")
def con(duck):
    return duck("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, con, same, name):
    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.execute(queries.SQL[name]).df())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_text_counts_keep_all_edges(spark):
    sf = "/root/testdata/sf0.001"
    edges, parts = queries.t.copurchase(spark, sf).count(), spark.read.parquet(f"{sf}/part.parquet").count()
    followers = {r["user"]: r["followers"] for r in queries.QUERIES["text_follower_count"](spark, sf).collect()}
    ones = {r["user"]: r["followers"] for r in queries.QUERIES["text_line_count"](spark, sf).collect()}
    assert sum(followers.values()) == edges and sum(ones.values()) == edges + 2 * parts
    assert any(n for user, n in followers.items() if int(user) % 3 == 0)
    assert {n for user, n in followers.items() if int(user) < 0} == {0}


def test_entry_without_the_optional_subpackage(spark, monkeypatch):
    for name in [n for n in sys.modules if n.startswith("flowgraph.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "flowgraph.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES)
    assert set(entry.oracle_sql()) == set(queries.SQL)
    assert entry.entry(spark).columns == ["closed_paths", "triangles"]
    monkeypatch.delitem(sys.modules, "__spark_entry__")
