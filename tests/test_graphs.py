"""Small graphs with answers worked out by hand, and what must hold on any."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowgraph.operators import combine, pagerank, paths, shortest
from flowgraph.plans.introspect import operators
from flowgraph.sources import generators, readers

PATH4 = [(1, 2), (2, 3), (3, 4), (5, 1)]
TRIANGLE_PLUS = [(1, 2), (2, 3), (3, 1), (2, 1), (3, 4)]
LOOP = [(1, 1), (1, 2), (2, 1)]
DOUBLE = [(1, 2), (1, 2), (2, 3), (3, 1)]
small = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
graphs = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14)


def edges(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint")


def plain_closed(rows, exclude_return=True):
    return sum(1 for a, m in rows for m2, b in rows for b2, c in rows if m == m2 and b == b2 and c == a and (a != b or not exclude_return))


def only(df):
    return tuple(df.first())


@pytest.mark.parametrize("node_lines,expected", [("zero", {"2": 2, "1": 1, "4": 0, "b,c": 1}), ("one", {"2": 2, "1": 1, "4": 1, "b,c": 1})])
def test_lines(spark, node_lines, expected):
    lines = spark.createDataFrame([(x,) for x in ("1,2", "3,2", "2,1", "4", "a,b,c")], "line string")
    assert dict(map(tuple, combine.count_lines(lines, node_lines).collect())) == expected


def test_lines_parse(spark):
    lines = spark.createDataFrame([(x,) for x in ("1,2", "x,2", "7", "3,4,5")], "line string")
    assert sorted(map(tuple, readers.edges_of_lines(lines).collect())) == [(1, 2), (3, 4)]
    assert [tuple(r) for r in readers.nodes_of_lines(lines).collect()] == [(7,)]


@pytest.mark.parametrize("strategy", combine.STRATEGIES)
def test_follower_count(spark, strategy):
    nodes = spark.createDataFrame([(1,), (9,)], "id bigint")
    assert dict(map(tuple, combine.follower_count(edges(spark, DOUBLE), strategy).collect())) == {2: 2, 3: 1, 1: 1}
    assert dict(map(tuple, combine.follower_count(edges(spark, DOUBLE), strategy, nodes).collect())) == {2: 2, 3: 1, 1: 1, 9: 0}


@pytest.mark.parametrize("strategy", paths.STRATEGIES)
def test_triangles(spark, strategy):
    assert only(paths.triangles(edges(spark, PATH4), strategy)) == (0, 0)
    assert only(paths.triangles(edges(spark, TRIANGLE_PLUS), strategy)) == (3, 1)
    assert only(paths.triangles(edges(spark, LOOP), strategy)) == (2, 0)
    assert only(paths.triangles(edges(spark, LOOP), strategy, exclude_return=False)) == (4, 1)
    assert only(paths.triangles(edges(spark, DOUBLE), strategy)) == (6, 2)
    assert only(paths.triangles(edges(spark, DOUBLE), strategy, distinct=True)) == (3, 1)
    assert only(paths.triangles(edges(spark, []), strategy)) == (0, 0)


@small
@given(graphs)
def test_triangles_of_any_graph(spark, rows):
    for exclude in (True, False):
        assert paths.triangles(edges(spark, rows), "shuffle", exclude).first()["closed_paths"] == plain_closed(rows, exclude)


@pytest.mark.parametrize("strategy", ["degree", "broadcast"])
def test_path2_count(spark, strategy):
    assert [only(paths.path2_count(edges(spark, g), strategy))[0] for g in (PATH4, TRIANGLE_PLUS, [])] == [3, 6, 0]


@pytest.mark.parametrize("strategy,node", [("shuffle", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")])
def test_join_strategies(spark, strategy, node):
    plan = paths.path2_edges(edges(spark, TRIANGLE_PLUS), strategy)
    assert operators(plan)[node] == 1


def test_bounds_reach_the_scan(spark, tmp_path):
    edges(spark, PATH4).write.parquet(str(tmp_path / "e"))
    found = combine.max_id(readers.edges_parquet(spark, str(tmp_path / "e")), 3)
    assert "LessThanOrEqual(src,3)" in found._jdf.queryExecution().executedPlan().toString()


def test_distances(spark):
    found = shortest.distances(edges(spark, PATH4), [1, 2, 99, 1])
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 2, 0), (2, 3, 1), (2, 4, 2)]
    assert dict(map(tuple, shortest.eccentricity(found).collect())) == {1: 3, 2: 2}
    assert dict(map(tuple, shortest.eccentricity(found, [1, 99], unreached=-1.0).collect())) == {1: 3.0, 99: -1.0}
    assert shortest.distances(edges(spark, PATH4), [1], max_iter=2).count() == 3


def test_long_paths_make_no_long_plans(spark, monkeypatch):
    monkeypatch.setattr(shortest, "COMPACT", 4)
    found = shortest.distances(edges(spark, [(i, i + 1) for i in range(1, 12)]), [1])
    assert sorted(map(tuple, found.collect())) == [(1, i + 1, i) for i in range(12)]
    assert len(found.inputFiles()) and found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4


def test_pagerank_chain(spark):
    ranks, history = pagerank.pagerank(generators.chain_graph(spark, 100), generators.chain_ranks(spark, 100))
    found = dict(map(tuple, ranks.collect()))
    expected = {0: 0.010936852726843594, 1: 1.0936852726843594e-06, 2: 2.17654197831244e-06, 9: 9.462212541120451e-06, 10: 1.046221254112045e-05, 50: 1.1046221254112045e-04}
    assert all(abs(found[k] - v) < 1e-12 for k, v in expected.items())
    assert all(abs(r["mass"] - 1) < 1e-9 for r in history.collect())
    assert [r["node"] for r in pagerank.first(ranks).collect()] == list(range(101))


def test_pagerank_keeps_its_mass_on_any_graph(spark):
    graph = pagerank.sunk(edges(spark, [(1, 2), (1, 3), (3, 1), (2, 4)]))
    ranks = spark.createDataFrame([(0, 0.0), *((i, 0.25) for i in range(1, 5))], "node bigint, rank double")
    assert all(abs(r["mass"] - 1) < 1e-12 for r in pagerank.pagerank(graph, ranks, 5)[1].collect())


def test_a_hub_makes_no_paths_through_it(spark):
    """Edges into and out of one hub, and one triangle: without the order of degrees the hub alone makes n * n paths."""
    n = 300
    edges = [(i, 0) for i in range(1, n)] + [(0, i) for i in range(n, 2 * n)] + [(n, 1)]
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    for strategy in ("shuffle", "broadcast"):
        assert tuple(paths.triangles(frame, strategy).first()) == (3, 1)
    degree = {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    rank = lambda v: (degree[v], v)
    into, out = {}, {}
    for a, b in edges:
        if rank(b) < rank(a):
            into[b] = into.get(b, 0) + 1
        else:
            out[a] = out.get(a, 0) + 1
    assert sum(x * out.get(v, 0) for v, x in into.items()) <= len(edges)
