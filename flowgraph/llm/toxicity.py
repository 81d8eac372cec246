"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance to offend is a logistic function of its words and their prefixes (of 3
to 6 letters, for inflected words), p, against that of a sentence without any telling word, q. The document's score is the
noisy-or of its sentences over that of as many such sentences, and of a fixed leak (documents are labelled without telling
words, too): 1 - (1 - LEAK) * prod((1 - p) / (1 - q)), so that length alone never scores. Only documents are labelled: the
weights, none below 0, maximise the likelihood of their labels by this very score. Once learned, the sentences that carry a
document's score can be named.

The model is learned in one task from at most `positives` and `negatives` labelled documents (bounds as parameters),
chosen by a hash of their ids. Broadcast are those ids (bounded alike) and the weights, FEATURES of them at most.

Cases: null and empty text, and text without words, have no sentences and score 0; texts of any length are read whole, letters
whose lower case is longer stay as they are; repeated rows score alike, and of rows that repeat an id the greatest text is
learned from; the sample's order is that of a hash of the ids, ties by id; rows without a label, or of null label or id, are not learned
from; a document labelled twice counts as labelled 1 if any of its labels is 1; without documents of both labels every
score is 0; further columns pass through, but for those of a result's name, which the results replace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import without

FEATURES = 4096
POSITIVES, NEGATIVES = 2000, 4000
THRESHOLD = 0.3
#: The likelihood that a document is labelled toxic without any telling word.
LEAK = 0.01
ROUNDS = 300
#: Most words whose weight a task remembers; bounds memory only.
MEMO_WORDS = 1 << 16
#: Words, or one of the marks that end a sentence.
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """The word itself and its prefixes, these marked by a trailing hyphen."""
    return [word, *(f"{word[:n]}-" for n in range(3, 7) if n < len(word))]


def fold(text: str) -> str:
    """The text in lower case, letter by letter, so that places stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def learn(texts: list[str | None], labels: np.ndarray, rounds: int = ROUNDS) -> dict[str, float]:
    """Weights by feature, and the bias under the empty name."""
    numbers: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    docs = []  # of each document, of each sentence its feature numbers
    for text in texts:
        sentences, own = [], set()
        for token in TOKEN.findall(fold(text or "")):
            if token in ENDS:
                if own:
                    sentences.append(own)
                own = set()
            else:
                if token not in of_word:
                    of_word[token] = [numbers.setdefault(f, len(numbers)) for f in features(token)]
                own.update(of_word[token])
        docs.append([np.fromiter(s, np.int32) for s in (*sentences, own) if s])
    y, n = labels.astype(np.float64), len(numbers)
    if not n or y.min() == y.max():
        return {"": -50.0}
    seen = np.zeros((2, n))
    for sentences, label in zip(docs, labels.astype(int)):
        if sentences:
            seen[label, np.unique(np.concatenate(sentences))] += 1
    share = (seen[1] + 0.5) / (y.sum() + 1), (seen[0] + 0.5) / (len(y) - y.sum() + 1)
    spread = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    telling = np.log(share[0] / share[1]) / spread
    # Words may only speak for toxicity: a sentence isn't less offensive for the harmless words around the offence.
    chosen = np.argsort(-telling, kind="stable")[:FEATURES]
    chosen = chosen[telling[chosen] > 3]
    place = np.full(n, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    doc_of, row_of, column = [], [], []
    at = 0
    for i, sentences in enumerate(docs):
        for s in sentences:
            own = place[s]
            own = own[own >= 0]
            column.append(own)
            row_of.append(np.full(len(own), at, np.int32))
            doc_of.append(i)
            at += 1
    doc_of, row_of, column = np.array(doc_of, np.int32), np.concatenate(row_of), np.concatenate(column)
    w, b = np.zeros(len(chosen)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(row_of, w[column], minlength=at)
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        total = np.bincount(doc_of, np.logaddexp(0, z) - np.logaddexp(0, b), minlength=len(y)) - np.log1p(-LEAK)
        slope = np.where(y > 0, -np.exp(-total) / -np.expm1(-total), 1.0)
        each = slope[doc_of] * p
        gw = np.bincount(column, each[row_of], minlength=len(w)) / len(y) + 2e-5 * w
        gb = (each.sum() - (slope[doc_of] * base).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.15 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = np.maximum(0.0, w - rate * m / (np.sqrt(v) + 1e-8))
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    names = list(numbers)
    return {"": float(b)} | {names[j]: float(x) for j, x in zip(chosen, w)}


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", positives: int = POSITIVES, negatives: int = NEGATIVES
) -> dict[str, float]:
    """Learn from docs that labels marks."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    bound = F.when(F.col("label") == 1, positives).otherwise(negatives)
    part = F.when(F.col("label") == 1, min(1.0, 1.5 * positives / max(1, sizes.get(1, 0)))).otherwise(min(1.0, 1.5 * negatives / max(1, sizes.get(0, 0))))
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("key"), "key"))
    drawn = marked.where(draw < part).withColumn("place", place).where(F.col("place") <= bound).drop("place")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")
    # One text for each id drawn, so that repeated rows don't undo the bound.
    rows = rows.groupBy("key").agg(F.max("label").alias("label"), F.max("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in batches if len(f)]
        if frames:
            frame = pd.concat(frames).sort_values("key")
            w = learn(frame["text"].tolist(), frame["label"].fillna(0).to_numpy())
            yield pd.DataFrame({"feature": list(w), "weight": list(w.values())})

    found = {r["feature"]: r["weight"] for r in rows.repartition(1).mapInPandas(run, "feature string, weight double").collect()}
    return found or {"": -50.0}


class Weights(dict):
    """The weight of a word, summed over its features; NaN for a mark that ends a sentence."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(dict.fromkeys(ENDS, np.nan))
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) < MEMO_WORDS:
            self[word] = found
        return found


def sentence_sums(text: str, weights: Weights, bias: float) -> np.ndarray:
    """The logits of the sentences that have words."""
    tokens = TOKEN.findall(fold(text))
    x = np.fromiter(map(weights.__getitem__, tokens), np.float64, len(tokens))
    ends = np.isnan(x)
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    x[ends] = 0.0
    words = np.add.reduceat((~ends).astype(np.int64), starts)
    return (bias + np.add.reduceat(x, starts))[words > 0]


def noisy_or(sums: np.ndarray, bias: float, leak: float = LEAK) -> float:
    """The document's score, the likelihood that is learned; 0 without sentences."""
    return min(1.0, max(0.0, float(-np.expm1((np.logaddexp(0, bias) - np.logaddexp(0, sums)).sum() + np.log1p(-leak))))) if len(sums) else 0.0


def score(df: DataFrame, weights: dict[str, float], text: str = "text", names: tuple[str, str] = ("score", "offending"), threshold: float = THRESHOLD) -> DataFrame:
    """df with the score (0 to 1) of each whole text, and of texts that reach the threshold the sentences of that score
    themselves, or else the one of the highest score, as spans (start, end in characters, score)."""
    df = without(df, names, text)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def spans(value: str, known: Weights, bias: float) -> list[dict]:
        found, start, sums, end = [], None, bias, 0
        for match in [*TOKEN.finditer(fold(value)), None]:
            if match is None or match[0] in ENDS:
                if start is not None:
                    found.append({"start": start, "end": end, "score": float(1 / (1 + np.exp(-sums)))})
                start, sums = None, bias
            else:
                start, end = match.start() if start is None else start, match.end()
                sums += known[match[0]]
        high = [x for x in found if x["score"] >= threshold]
        return high or ([max(found, key=lambda x: x["score"])] if found else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = Weights(shared.value), shared.value[""]
        leak = LEAK if len(shared.value) > 1 else 0.0  # nothing was learned
        for batch in batches:
            scores, where = [], []
            for value in batch.column(at).to_pylist():
                p = noisy_or(sentence_sums(value, known, bias), bias, leak) if value else 0.0
                scores.append(p)
                where.append(spans(value, known, bias) if value and p >= threshold else [])
            more = [pa.array(scores, pa.float64()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(span))]))
