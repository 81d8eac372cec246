"""op1: every document encoded, decoded, and both digested."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .tables import read

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digests(df: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """df (doc_id, text) as doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = bpe.read_ranks(ranks_path)
    coded = bpe.encode(df.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
