"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (byte pairs and triples of its lower-cased UTF-8; ASCII digits, signs and
white space count as blanks), weighted sqrt(tf) * idf and scaled to length 1. Every learned language has a few centroids,
found by spherical k-means, and the language of the centroid of largest cosine is the prediction. A text is rejected
if its cosine is below `slack` times the usual one of held-out texts of the language and of its length (in distinct
n-grams: short texts have small cosines, and repeats make none longer). The usual cosine is the median of each of up to
eight classes of length, between them by the logarithm of the length, and below the shortest by its square root. Held out
is each quarter of the sample in turn; a sample of fewer than four texts is compared with its own centroids.

What is learned from: document frequencies from every labelled row given; centroids from a sample of at most `sample`
rows a language (the bound is a parameter), chosen by a hash of the key. Broadcast are the idf vector and the centroids:
DIMENSIONS * clusters numbers a language; the languages are the classes of the labels.

Cases: null text and text without a letter are `und` with score 0 and rejected; nothing learned: all `und`; rows of null
language are not learned from; a very long text is counted in spans of bounded size, whole; rows that repeat a text get the same
prediction, and each counts in what is learned; an empty table gives an empty result; ties between centroids go to the first language in
code point order; further columns pass through, but for those of a result's name, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import without

DIMENSIONS = 4096
UNDETERMINED = "und"
#: Texts whose vectors are held at once: so many, and so many bytes (one longer text is cut into spans of this size and summed).
HELD_TEXTS, HELD_BYTES = 256, 1 << 21
#: Defaults of fit().
SAMPLE, CLUSTERS, SLACK = 400, 3, 0.3
#: Parts of a sample that are held out in turn; classes of length, and the texts that one needs.
FOLDS, CLASSES, CLASS_TEXTS = 4, 8, 20

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _spans(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts as lower-cased bytes, in lots of bounded size; a long text may come in several spans."""
    who, lot, size = [], [], 0
    for i, text in enumerate(texts):
        data = b" " + (text or "").lower().encode() + b"  "
        for at in range(0, max(1, len(data) - 2), HELD_BYTES):
            span = data[at : at + HELD_BYTES + 2]  # two bytes over, for the n-grams that begin in this span
            who.append(i)
            lot.append(span)
            size += len(span)
            if size >= HELD_BYTES or len(lot) >= HELD_TEXTS:
                yield who, lot
                who, lot, size = [], [], 0
    if lot:
        yield who, lot


def _count(lot: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts, a row for each span."""
    lengths = np.array([len(x) for x in lot])
    data = _BLANK[np.frombuffer(b"".join(lot), np.uint8)].astype(np.uint32)
    first = np.repeat(np.arange(len(lot), dtype=np.int64) * DIMENSIONS, lengths)
    ends = np.cumsum(lengths)
    out = np.zeros(len(lot) * DIMENSIONS, np.int64)
    code = data
    for n, factor in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        code = code[:-1] * np.uint32(256) + data[n - 1 :]
        keep = np.ones(len(code), bool)
        for back in (1, 2):  # the last two bytes of a span begin no n-gram: they are blanks, or begin one in the next span
            at = ends - back
            keep[at[at < len(code)]] = False
        slot = (code * np.uint32(factor) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64) + first[: len(code)]
        out += np.bincount(slot[keep], minlength=len(out))
    return out.reshape(len(lot), DIMENSIONS)


def counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, n-gram counts of their whole texts)."""
    held: tuple[int, np.ndarray] | None = None
    for who, lot in _spans(texts):
        rows, counts = np.array(who), _count(lot)
        if held:
            if rows[0] == held[0]:
                counts[0] += held[1]
            else:
                yield np.array([held[0]]), held[1][None]
            held = None
        own, at = np.unique(rows, return_index=True)
        counts = np.add.reduceat(counts, at, axis=0)
        held = (int(own[-1]), counts[-1])
        if len(own) > 1:
            yield own[:-1], counts[:-1]
    if held:
        yield np.array([held[0]]), held[1][None]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means: begins at the mean's nearest vector, then always at the vector furthest from those taken."""
    taken = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(taken) < min(k, len(vectors)):
        taken.append(int((vectors @ vectors[taken].T).max(axis=1).argmin()))
    centres = vectors[taken]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.array([vectors[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def usual(vectors: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, rising, and the usual cosine at each of texts that k centroids have not seen."""
    if len(vectors) < FOLDS:
        cosines = (vectors @ cluster(vectors, k).T).max(axis=1)
    else:
        cosines, fold = np.zeros(len(vectors)), np.arange(len(vectors)) % FOLDS
        for i in range(FOLDS):
            cosines[fold == i] = (vectors[fold == i] @ cluster(vectors[fold != i], k).T).max(axis=1)
    classes = np.array_split(np.argsort(sizes, kind="stable"), max(1, min(CLASSES, len(sizes) // CLASS_TEXTS)))
    at, first = np.unique([np.median(sizes[c]) for c in classes], return_index=True)
    return at, np.maximum.accumulate(np.array([np.median(cosines[c]) for c in classes])[first])


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    usual: list[tuple[np.ndarray, np.ndarray]]  # of each centroid: sizes and usual cosines
    idf: np.ndarray
    slack: float

    def least(self, centroid: int, size: float) -> float:
        """Cosines below are rejected in a text of so many distinct n-grams."""
        sizes, cosines = self.usual[centroid]
        return self.slack * float(np.interp(np.log(size), np.log(sizes), cosines)) * min(1.0, size / sizes[0]) ** 0.5


def fit(
    df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, clusters: int = CLUSTERS, slack: float = SLACK
) -> Model | None:
    """Learn from all rows of df whose language isn't null; None if there are none."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    if not sizes:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for _, counts in counted(batch.column(0).to_pylist()):
                found[:-1] += (counts > 0).sum(axis=0)
            n += batch.num_rows
        found[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(found)], names=["slot", "n"])

    found = np.zeros(DIMENSIONS + 1)
    for r in rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        found[r["slot"]] = r["n"]
    idf = (np.log((1 + found[-1]) / (1 + found[:-1])) + 0.1).astype(np.float32)

    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.element_at(F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, 1.5 * sample / n)))]), F.col("lang"))
    drawn = rows.where(draw < part).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "text")))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        found = [(weighted(counts, idf), (counts > 0).sum(axis=1)) for _, counts in counted(group["text"].tolist())]
        vectors, sizes = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        kept = np.linalg.norm(vectors, axis=1) > 0
        vectors, sizes = vectors[kept], sizes[kept]
        centres, (at, cosines) = cluster(vectors, clusters), usual(vectors, sizes, clusters)
        n = len(centres)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "sizes": [at.tolist()] * n, "cosines": [cosines.tolist()] * n})

    learned = drawn.where(F.col("place") <= sample).groupBy("lang").applyInPandas(learn, "lang string, centre binary, sizes array<double>, cosines array<double>")
    centres = sorted(((r["lang"], bytes(r["centre"]), r["sizes"], r["cosines"]) for r in learned.collect()), key=lambda x: x[0].encode())
    bounds = [(np.array(c[2]), np.array(c[3])) for c in centres]
    return Model([c[0] for c in centres], np.array([np.frombuffer(c[1], np.float32) for c in centres]), bounds, idf, slack)


def predict(df: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """df with the predicted language, the cosine of its centroid (0 to 1) and whether the text is rejected."""
    df = without(df, names, text)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        model, letter = shared.value, regex.compile(r"\p{L}").search
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for rows, counts in counted(texts) if model else ():
                near = weighted(counts, model.idf) @ model.centroids.T
                best, sizes = near.argmax(axis=1), (counts > 0).sum(axis=1)
                for i, j, cosine, size in zip(rows.tolist(), best.tolist(), near[np.arange(len(best)), best].tolist(), sizes.tolist()):
                    if texts[i] and letter(texts[i]):
                        lang[i], score[i], rejected[i] = model.languages[j], min(1.0, max(0.0, cosine)), cosine < model.least(j, size)
            more = [pa.array(lang), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *map(T.StructField, names, kinds)]))
