"""Language ID and toxicity by held-out accuracy, and the pipeline stage by stage."""

import base64
import random
import zlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowgraph.llm import langid, q_langid, q_toxicity, toxicity
from flowgraph.llm.mixing import copies

from .test_join import brute

SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_language_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = q_langid.op10_langid(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_language_of_awkward_rows(spark):
    train = [(i, "the cat and the dog are here", "en", None, 0) for i in range(30)] + [(i, "der Hund und die Katze sind hier", "de", None, 0) for i in range(30, 60)]
    model = langid.fit(docs(spark, [*train, (99, "xx", None, None, 0), (100, None, "en", None, 0)]))
    texts = [None, "", "123 !?", "the dog", "DIE KATZE", "the cat " * 400_000, "ß"]
    df = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).withColumn("Score", F.lit("?"))
    found = langid.predict(df, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found][:6] == ["und", "und", "und", "en", "de", "en"]
    assert [r["rejected"] for r in found][:3] == [True] * 3 and not found[3]["rejected"]
    assert langid.predict(df.limit(0), model).count() == 0
    assert langid.fit(docs(spark, [])) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}


def test_noise_and_unlearned_languages_are_rejected(spark):
    """Letter noise of several lengths, and all languages learned but one; own held-out texts stay."""
    drawn, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    noise = ["".join(drawn.choice(letters) for _ in range(n)) for n in (100, 1000, 8000) for _ in range(10)]
    noise += [" ".join("".join(drawn.choice(letters) for _ in range(drawn.randint(2, 9))) for _ in range(n)) for n in (20, 200, 2000) for _ in range(10)]
    noise += [base64.b64encode(drawn.randbytes(n)).decode() for n in (100, 1000, 8000) for _ in range(10)]
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    train, rest = table.where("doc_id % 5 != 0"), table.where("doc_id % 5 = 0").select("lang", "text")

    def share(df, model):
        rows = langid.predict(df, model).groupBy("rejected").count().collect()
        return sum(r["count"] for r in rows if r["rejected"]) / sum(r["count"] for r in rows)

    model = langid.fit(train)
    assert share(docs(spark, [(i, x, None, None, 0) for i, x in enumerate(noise)]), model) >= 0.98
    assert share(rest, model) <= 0.005
    for left in ("de", "en"):
        assert share(rest.where(F.col("lang") == left), langid.fit(train.where(F.col("lang") != left))) >= 0.95


def test_language_of_few_texts(spark):
    for n in (1, 3, 4, 7):
        model = langid.fit(docs(spark, [(i, "the cat and the dog are here", "en", None, 0) for i in range(n)]))
        assert [r["rejected"] for r in langid.predict(docs(spark, [(0, "the dog and the cat are here", None, None, 0), (1, "zqxj wvkq", None, None, 0)]), model).orderBy("doc_id").collect()] == [False, True]


def test_long_texts_are_counted_whole(monkeypatch):
    texts = ["abc é " * 50, None, "q" * 500, "x"]
    whole = {int(i): c.tolist() for rows, counts in langid.counted(texts) for i, c in zip(rows, counts)}
    monkeypatch.setattr(langid, "HELD_BYTES", 37)
    assert {int(i): c.tolist() for rows, counts in langid.counted(texts) for i, c in zip(rows, counts)} == whole


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = q_toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] for r in rows if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in rows)
    alarms = sum(r["predicted"] for r in rows if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in rows)
    assert hits >= 0.85 and alarms <= 0.02
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)


def test_toxicity_against_a_plain_version(spark):
    """Every row of op8, scored word by word and sentence by sentence with the weights learned."""
    import math
    import re

    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = q_toxicity.learned(table, labels)
    assert len(weights) > 1

    def plain(text):
        chance = lambda z: 1 / (1 + math.exp(-z))
        left, sentences = 1.0, 0
        for sentence in re.split(r"[.!?\n]", "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")):
            own = re.findall(r"[^\W_]+", sentence)
            z = weights[""] + sum(weights.get(f, 0.0) for w in own for f in [w, *(w[:n] + "-" for n in range(3, 7) if n < len(w))])
            if own:
                left, sentences = left * (1 - chance(z)) / (1 - chance(weights[""])), sentences + 1
        return 1 - (1 - toxicity.LEAK) * left if sentences else 0.0

    found = {r["doc_id"]: r for r in q_toxicity.op8_toxicity(spark, sf).collect()}
    rows = table.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        assert abs(found[r["doc_id"]]["score"] - plain(r["text"])) < 1e-9
        assert found[r["doc_id"]]["predicted"] == (found[r["doc_id"]]["score"] >= 0.3)


def test_learned_ties_and_repeated_rows(spark):
    """Languages of equal texts: the first name wins; repeated rows are judged alike, and capitals that grow don't move spans."""
    rows = [(i, "common words of one text", ("bb", "aa")[i % 2]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.predict(table.union(table), langid.fit(table)).collect()
    assert len(found) == 80 and {r["lang_pred"] for r in found} == {"aa"}
    assert len({(r["text"], r["score"]) for r in found}) == len({r["text"] for r in found})
    weights = {"": -6.0, "scum": 9.0}
    df = spark.createDataFrame([(1, "\u0130\u0130 fine. You SCUM!")] * 2, "doc_id bigint, text string")
    for r in toxicity.score(df, weights).collect():
        span = r["offending"][0]
        assert r["text"][span["start"] : span["end"]] == "You SCUM"


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, f"fine words number{i} here. more good words" + (" you scum" if i % 3 == 0 else ""), None, None, 0) for i in range(120)]
    labels = spark.createDataFrame([*((i, int(i % 3 == 0)) for i in range(120)), (0, 0), (None, 1), (5, None), (999, 1)], "doc_id bigint, toxic int")
    weights = toxicity.fit(docs(spark, rows), labels)
    texts = [None, "", "...", "All fine here. You SCUM! Good words.", "good words. " * 50_000, "x" * 100_000]
    df = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).withColumn("offending", F.lit("?"))
    found = toxicity.score(df, weights).orderBy("doc_id").collect()
    assert [r["score"] >= toxicity.THRESHOLD for r in found] == [False, False, False, True, False, False]
    (span,) = found[3]["offending"]
    assert texts[3][span["start"] : span["end"]] == "You SCUM" and found[0]["score"] == 0
    one_kind = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(docs(spark, rows), one_kind)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(docs(spark, []), labels)).collect()} == {0.0}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over a small table with copies, toxic, empty and null texts, and an extra column."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    awkward = docs(spark, [(10_001, None, "en", "src0", 0), (10_002, "", None, None, 0), (10_003, "12 34", "en", "src1", 5), (10_003, "12 34", "en", "src1", 5)])
    at = table.unionByName(awkward).unionByName(table.limit(3)).withColumn("score", F.lit("?"))
    found = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, at, "/root/testdata/sf0.001").write.parquet(folder)
        out = spark.read.parquet(folder)
        found.append((at, out))
        at = out
    return found


def test_stages_keep_the_columns(stages):
    assert all(before.columns == after.columns for before, after in stages[:-1])
    assert all(r["score"] == "?" for r in stages[3][1].collect())


def test_language_stage(spark, stages):
    before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    assert not kept & {10_001, 10_002, 10_003}
    assert after.count() >= 0.97 * before.count() - 4


def test_toxicity_stage(spark, stages):
    before, after = stages[1]
    weights = q_toxicity.learned(before, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    known = toxicity.Weights(weights)
    expected = [r["doc_id"] for r in before.collect() if toxicity.noisy_or(toxicity.sentence_sums(r["text"], known, weights[""]), weights[""]) < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(expected)


def test_join_stage(stages):
    before, after = stages[2]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    ids = sorted(rows)
    classes = brute([rows[i] for i in ids])
    assert sorted(r["doc_id"] for r in after.collect()) == [ids[i] for i, (_, c) in sorted(classes.items()) if c == i]


def test_mixing_stage(stages):
    before, after = stages[3]
    expected = {r["doc_id"]: r["mix"]["copies"] for r in copies(before).collect() if r["mix"]["copies"]}
    found = {}
    for r in after.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == expected


def test_token_stage(stages):
    from .test_text import REAL

    assert isinstance(REAL, tiktoken.Encoding)
    before, after = stages[4]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after.collect()) == sorted((r["doc_id"], len(REAL.encode_ordinary(r["text"] or ""))) for r in before.collect())


def test_stages_take_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), "/root/testdata/sf0.001").count() == 0
