"""The n-gram join against brute force, and what it is made of."""

import random
import re

import numpy as np
import pytest

from flowgraph.llm import graphs, ngram_join, shingles


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, width=5):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(texts):
    """(n_shingles, component) of each text, numbered in order."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id bigint, text string, n long".replace("n long", "n string"))
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}


def prose(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "a b c d", "A  b\nC d", "a b c d e", "é É x y z w", "x\u00a0y x\u00a0y"]
    passage = prose(draw, 60)
    for _ in range(25):  # families at all distances around the threshold
        base = prose(draw, draw.randrange(6, 150))
        texts.append(" ".join(base))
        for _ in range(draw.randrange(1, 7)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(copy[: draw.randrange(max(1, len(copy) * 8 // 10), len(copy) + 1)]))
    texts += [" ".join([*prose(draw, 12), *passage]) for _ in range(20)]  # a passage that many share
    chain = prose(draw, 100)
    for i in range(15):  # a chain: each links to the next only
        chain = [*chain[6:], *prose(draw, 6)]
        texts.append(" ".join(chain))
    hot = prose(draw, 80)
    texts += [" ".join([*hot[:i], f"z{i}", *hot[i + 1 :]]) for i in range(80)]  # one large group of near copies
    texts += [" ".join(hot)] * 20 + ["word " * 3000] * 2
    draw.shuffle(texts)
    return texts


def test_against_brute_force(spark, corpus):
    assert run(spark, corpus) == brute(corpus)


def test_agrees_with_sql(spark, duck, same):
    from flowgraph.llm import q_ngram_join

    sf = "/root/testdata/sf0.001"
    same(q_ngram_join.op5_ngram_join(spark, sf), duck("sf0.001").execute(q_ngram_join.JOIN_SQL).df())


def test_a_very_long_text_and_many_rows_of_one_list(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_SHARE", 3)
    draw = random.Random(9)
    long = [f"w{i}" for i in range(200_000)]
    passage = prose(draw, 40)
    texts = [" ".join(long), " ".join([*long[:150_000], "x", *long[150_001:]]), " ".join(long[:100_000])]
    texts += [" ".join([*passage, f"y{i}", f"z{i % 7}", f"z{i % 5}"]) for i in range(40)]
    found = run(spark, texts)
    assert found[0] == (199_996, 0) and found[1] == (199_996, 0) and found[2] == (99_996, 2)
    assert {i - 3: (n, c - 3) for i, (n, c) in found.items() if i > 2} == brute(texts[3:])


def test_without_leader_rounds(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert run(spark, corpus[:120]) == brute(corpus[:120])


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [None, "", " "]) == {0: (0, 0), 1: (0, 1), 2: (0, 2)}
    assert run(spark, ["just one text of six words"]) == {0: (2, 0)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "q r s t u v")]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 2, None)], key=str)


def test_sets_do_not_depend_on_lots(corpus, monkeypatch):
    def all_sets():
        out = {}
        for first, hashes, counts in shingles.sets(corpus, 5):
            for i, own in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
                out[first + i] = own.tolist()
        return out

    whole = all_sets()
    assert [len(whole[i]) for i in range(len(corpus))] == [len(shingle_set(t)) for t in corpus]
    monkeypatch.setattr(shingles, "HELD", 300)
    assert all_sets() == whole


def test_parity_bounds_the_difference():
    draw = np.random.default_rng(1)

    def bitmap(own):
        bits = 1 << max(6, int(2 * len(own) - 1).bit_length())
        odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    for n, m, common in ((10, 12, 9), (100, 130, 90), (1000, 900, 10), (40, 300, 40)):
        x = draw.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = x[:n], np.concatenate([x[:common], x[n : n + m - common]])
        x, y = bitmap(a), bitmap(b)
        assert ngram_join._difference(int.from_bytes(x, "little"), len(x), int.from_bytes(y, "little"), len(y)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)]
    found = dict(map(tuple, graphs.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    expected = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)} | {500 + i: 500 for i in range(30)}
    assert found == expected
    many = spark.createDataFrame(links, "a bigint, b bigint").repartition(9)  # no task sees a whole component
    assert dict(map(tuple, graphs.components(many).collect())) == expected
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_in_many_tasks_fold_without_rounds(spark, monkeypatch):
    draw, put, names = random.Random(3), graphs.Steps.put, []
    monkeypatch.setattr(graphs.Steps, "put", lambda self, name, df: names.append(name) or put(self, name, df))
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(300)] + [(3000 + i, 3000 + draw.randrange(600)) for i in range(600)]
    draw.shuffle(links)
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = {i: root(i) for i in parent if any(i in x and x[0] != x[1] for x in links)}
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as on many machines
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(links, "a bigint, b bigint").repartition(30).cache()
        assert dict(map(tuple, graphs.components(df).collect())) == expected
        assert len(names) <= 2  # where they are read, and in one task; rounds of stars are for more links than a task holds
        assert sorted(map(tuple, graphs.members(df).collect())) == sorted((i, c) for i, c in expected.items() if i != c)
        monkeypatch.setattr(graphs, "FOLDED", 100)
        assert sorted(map(tuple, graphs.members(df).collect())) == sorted((i, c) for i, c in expected.items() if i != c)
        assert len(names) > 6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sketches_are_summed_in_rounds(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SUMMED", 2)
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string").repartition(7)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert found == brute(corpus)
