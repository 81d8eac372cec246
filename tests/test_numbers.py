"""k-means, matrices, generators and text formats."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowgraph.operators import kmeans, matrix
from flowgraph.sources import generators, readers, sinks
from flowgraph.streaming import follower_stream

A, B = [(0, 0, 1), (0, 1, 2), (1, 1, 3)], [(0, 0, 4), (1, 0, 5), (1, 1, 6)]
cells = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(-3, 3)), max_size=12)


def product(spark, a, b, **options):
    left, right = spark.createDataFrame(a, "i bigint, k bigint, v bigint"), spark.createDataFrame(b, "k bigint, j bigint, v bigint")
    return {(r["i"], r["j"]): r["v"] for r in matrix.multiply(left, right, **options).collect()}


@pytest.mark.parametrize("strategy", matrix.STRATEGIES)
def test_products(spark, strategy):
    options = {"strategy": strategy, "sizes": (2, 2, 2), "grid": (2, 2, 2), "side": 2}
    assert product(spark, A, B, **options) == {(0, 0): 14, (0, 1): 12, (1, 0): 15, (1, 1): 18}
    assert product(spark, [(0, 0, 0)], [(0, 0, 5)], **options) == {(0, 0): 0}
    assert product(spark, [(0, 0, 0)], [(0, 0, 5)], drop_zeros=True, **options) == {}
    assert product(spark, [(0, 0, 1), (0, 0, 2)], [(0, 0, 5)], **options) == {(0, 0): 15}
    assert product(spark, [(0, 0, 1), (0, 0, 2)], [(0, 0, 5)], distinct=True, **options) == {(0, 0): 10}
    assert product(spark, [(0, 0, 1), (0, 1, 1)], [(0, 0, 3), (1, 0, -3)], drop_zeros=True, **options) == {}
    assert product(spark, [(0, 0, 2**31)], [(0, 0, 2)], **options) == {(0, 0): 2**32}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells, cells)
def test_strategies_agree_on_uneven_blocks(spark, a, b):
    plain = product(spark, a, b)
    for strategy in ("block", "cannon"):
        assert product(spark, a, b, strategy=strategy, sizes=(7, 7, 7), grid=(3, 2, 4), side=3) == plain


def points(spark, xs):
    return kmeans.histogram(spark.createDataFrame([(x,) for x in xs], "followers bigint"))


def test_kmeans_drops_empty_clusters(spark):
    centroids, history = kmeans.kmeans(points(spark, [1, 1, 10]))
    assert [r[0] for r in centroids.collect()] == [1.0, 10.0]
    rounds = {}
    for r in history.collect():
        rounds[r["iteration"]] = rounds.get(r["iteration"], 0) + r["sse"]
    assert rounds == {1: 36.0, 2: 0.0}


def test_kmeans_ties_go_to_the_lower_centroid(spark):
    assert [tuple(r)[:2] for r in kmeans.step(points(spark, [2]), [3.0, 1.0]).collect()] == [(1.0, 2.0)]


def test_kmeans_error_never_rises(spark):
    _, history = kmeans.kmeans(points(spark, [x * x % 97 for x in range(300)]))
    errors = {}
    for r in history.collect():
        errors[r["iteration"]] = errors.get(r["iteration"], 0) + r["sse"]
    values = [errors[i] for i in sorted(errors)]
    assert all(a >= b - 1e-6 for a, b in zip(values, values[1:]))


def test_generators(spark):
    cells = [tuple(r) for r in generators.sparse_matrix(spark, 50, 40, 0.1, seed=3).collect()]
    assert len(cells) == len({c[:2] for c in cells}) == 200
    assert all(0 <= r < 50 and 0 <= c < 40 and 1 <= v <= 99 for r, c, v in cells)
    triples = [tuple(r) for r in generators.random_triples(spark, 50, 40, 0.1).collect()]
    assert len(triples) == 200 and max(t[0] for t in triples) <= 48 and max(t[1] for t in triples) <= 38 and {t[2] for t in triples} <= set(range(100))
    assert generators.random_sources(5, 10, 1) == generators.random_sources(5, 10, 1)
    assert sorted(map(tuple, generators.chain_graph(spark, 2).collect())) == [(1, 2), (2, 0), (3, 4), (4, 0)]


def test_generated_product(spark):
    a, b = (generators.sparse_matrix(spark, 20, 20, 0.2, seed=s).collect() for s in (1, 2))
    expected = {}
    for i, k, v in a:
        for k2, j, w in b:
            if k == k2:
                expected[i, j] = expected.get((i, j), 0) + v * w
    assert product(spark, [tuple(r) for r in a], [tuple(r) for r in b]) == expected


def test_node_json(spark):
    text = '{"nodeId":1,"adjList":[2],"isObj":false,"isActive":false,"kMap":{"1":0}}'
    states = readers.node_states(spark.createDataFrame([(text,)], "line string"))
    assert states.first()["kMap"] == {1: 0}
    assert json.loads(sinks.node_json(states).first()["line"]) == json.loads(text)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    for name, write, expected in (
        ("tuples", lambda p: sinks.write_tuples(df, p, one_file=True), ["(1,2)", "(3,4)"]),
        ("tabs", lambda p: sinks.write_delimited(df, p), ["1\t2", "3\t4"]),
        ("none", lambda p: sinks.write_delimited(df, p, ""), ["12", "34"]),
        ("csv", lambda p: sinks.write_csv(df, p), ["1,2", "3,4"]),
    ):
        write(str(tmp_path / name))
        assert sorted(r[0] for r in readers.text_lines(spark, str(tmp_path / name)).collect()) == expected


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1,2\n3,2\n4\n")
    stream = follower_stream(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("followers")
    running = stream.option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        running.processAllAvailable()
        (tmp_path / "in" / "b").write_text("5,4\n")
        running.processAllAvailable()
        assert dict(map(tuple, spark.sql("SELECT * FROM followers").collect())) == {"2": 2, "4": 1}
    finally:
        running.stop()
