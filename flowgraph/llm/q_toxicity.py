"""op8: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .q_langid import remainder
from .tables import read


def learned(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    return toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, learned(docs, read(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
