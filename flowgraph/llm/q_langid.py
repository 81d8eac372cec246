"""op10: the language of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .tables import read


def remainder(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def learned(docs: DataFrame) -> langid.Model | None:
    return langid.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_langid": op10_langid}
SQL: dict[str, str] = {}
