"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgraph.llm import ann, q_vectors, topk, vectors

def is_query():
    return F.col("id") % 20 == 0


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "?") for i, v in rows], "vec_id bigint, embedding array<float>, score string")


def usable(v, zero):
    return v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) and (zero or any(np.float32(x) != 0 for x in v))


def brute(rows, k, score, zero):
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and usable(v, zero)]
    out = []
    for q, x in rows:
        if q % 20 == 0:
            best = sorted((-score(x, y), i) for i, y in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def whole(x, y):
    n = max(len(x), len(y))
    a, b = ([int(np.floor(64 * z)) for z in v] + [0] * (n - len(v)) for v in (x, y))
    return sum(p * q for p, q in zip(a, b))


def dot(x, y):
    return float(x @ y)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def random_rows():
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16) * rng.uniform(0.1, 3)) for i in range(300)]
    rows += [(i, np.ones(16)) for i in range(300, 380)]  # a hot vector
    return rows + [(400, None), (401, [None] + [1.0] * 15), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (420, [0.0] * 16), (None, [1.0] * 16), (421, [-0.0] * 16)]


def test_exact_search(spark, random_rows, monkeypatch):
    expected = brute(random_rows, 20, whole, zero=True)
    assert rows_of(topk.top_products(table(spark, random_rows), is_query())) == expected
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 6)
    assert rows_of(topk.top_products(table(spark, random_rows), is_query())) == expected


def test_exact_search_with_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1.0, -1e25]), (2, [-1e30, 2.0]), (3, [3e38, 3e38])]
    found = rows_of(topk.top_products(table(spark, rows), is_query(), k=2))
    # Two products are beyond 64 bits and cut to the same score: the tie goes to the smaller id.
    assert found == [(0, 1, 1, topk.LARGEST), (0, 2, 3, topk.LARGEST)]


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(2)
    points = np.floor(64 * rng.standard_normal((400, 8)) * rng.uniform(0.1, 2, (400, 1)))
    lengths = np.linalg.norm(points, axis=1)
    order = np.argsort(-lengths)
    points, lengths = points[order], lengths[order]
    for q in points[:60]:
        products = points @ q
        for least in np.quantile(products, [0.5, 0.9, 0.99, 1.0]):
            kept = set(topk.pruned(points, lengths, q, least).tolist())
            assert set(np.flatnonzero(products >= least).tolist()) <= kept


def test_forest_finds_all_of_a_small_table(spark, random_rows):
    found, expected = rows_of(ann.nearest_products(table(spark, random_rows), is_query())), brute(random_rows, 20, dot, zero=False)
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert len({r[:3] for r in found} & {r[:3] for r in expected}) >= 0.9 * len(expected)
    scores = {(q, i): s for q, _, i, s in expected}
    assert all(abs(s - scores[q, i]) < 1e-9 for q, _, i, s in found if (q, i) in scores)


def unit(rng, n, width=64):
    points = rng.standard_normal((n, width))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_buckets_prune_at_any_size():
    rng = np.random.default_rng(4)
    for n, spread, most in ((2000, True, 0.35), (2000, False, 0.75), (8000, False, 0.6)):
        points = np.floor(64 * unit(rng, n) * (rng.uniform(0.1, 3, (n, 1)) if spread else 1.0))
        lengths = np.linalg.norm(points, axis=1)
        order = np.argsort(-lengths, kind="stable")
        points, lengths = points[order], lengths[order]
        verified = 0
        for i in range(0, n, n // 40):
            found, scores, seen = topk.scan(points, lengths, [[j] for j in range(n)], points[i], 20, -np.inf)
            exact = points @ points[i]
            assert list(zip(found, scores)) == [(j, exact[j]) for j in np.lexsort((np.arange(n), -exact))[:21]]
            verified += seen
        assert verified / (40 * n) < most


def test_forest_recall():
    points = unit(np.random.default_rng(3), 4000)
    asked, forest = points[::40], ann.Forest(points)
    codes, low, high = forest.ranges(asked)
    most, hits = int(ann.SHARE * len(points)), 0
    for i, q in enumerate(asked):
        near = forest.candidates(codes[:, i], low[:, i], high[:, i], most)
        assert len(near) == most
        hits += len(set(near.tolist()) & set(np.argsort(-(points @ q))[:20].tolist()))
    assert hits >= 0.92 * 20 * len(asked)


def test_forest_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    points = unit(np.random.default_rng(6), 3000).astype(np.float32).astype(np.float64)
    found = rows_of(ann.nearest_products(table(spark, list(enumerate(points))), is_query()))
    asked = range(0, 3000, 20)
    truth = {(q, j) for q in asked for j in [x for x in np.argsort(-(points @ points[q]))[:21].tolist() if x != q][:20]}
    assert len(found) == 20 * len(asked)
    assert len(truth & {(r[0], r[2]) for r in found}) >= 0.9 * len(truth)


def test_one_id_on_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5])]
    for search, scale in ((ann.nearest_products, 1), (topk.top_products, 4096)):
        assert rows_of(search(table(spark, rows), is_query())) == [(0, 1, 1, 3 * scale), (0, 2, 2, 1 * scale)]


@pytest.mark.parametrize("search", [ann.nearest_products, topk.top_products])
def test_empty_and_tiny_tables(spark, search):
    assert search(table(spark, []), is_query()).count() == 0
    assert search(table(spark, [(0, [1.0])]), is_query()).count() == 0
    assert [r["vec_id"] for r in search(table(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]), is_query()).orderBy("rank").collect()] == [1, 2]


def test_exact_query_agrees_with_sql(spark, duck, same):
    same(q_vectors.op7_topk(spark, "/root/testdata/sf0.001"), duck("sf0.001").execute(q_vectors.TOPK_SQL).df())
