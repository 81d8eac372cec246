"""From raw documents to tokens: five stages, each applied to all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Part of the subpackage flowgraph.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm import langid, ngram_join, q_bpe, q_langid, q_toxicity, toxicity
from flowgraph.llm.mixing import mixed
from flowgraph.llm.tables import materialise, own, read, ship, unique_name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or far from every language learned, go."""
    ship(spark)
    names = tuple(unique_name(docs, x) for x in ("language_found", "language_score", "language_rejected"))
    found = langid.predict(docs, q_langid.learned(docs), names=names)
    return found.where(~F.col(names[2])).select(own(docs))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic texts go."""
    weights = q_toxicity.learned(docs, read(spark, sf_dir, "labels"))
    names = unique_name(docs, "toxic_score"), unique_name(docs, "toxic_spans")
    return toxicity.score(docs, weights, names=names).where(F.col(names[0]) < toxicity.THRESHOLD).select(own(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest id stays. Of rows that repeat an id one stays; rows of null id
    stay (nothing can name them)."""
    classes = materialise(ngram_join.near_duplicates(docs), "classes")
    ids = classes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least"))
    gone = materialise(ids.where(F.col("least") < F.col("doc_id")).select("doc_id"), "gone")
    left = docs.join(F.broadcast(gone) if gone.count() <= ngram_join.BROADCAST_IDS else gone, "doc_id", "left_anti").select(own(docs))
    if ids.where("n > 1").isEmpty():
        return left
    named = left.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*own(docs))).alias("row"))
    return named.select("row.*").unionByName(left.where(F.col("doc_id").isNull()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy encoded and decoded: doc_id, n_tokens and the digests of both."""
    ship(spark)
    return q_bpe.digests(docs)


STAGES = [("language", language), ("toxicity", harmless), ("near copies", distinct), ("mixing", mix), ("tokens", tokens)]
#: Learned models and exact set joins aren't SQL; tests/llm compares with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
