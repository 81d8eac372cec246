"""Mixing sources to target weights.

Sizes are aggregated per source; targets come from weights by water-filling (no source is asked for more than `most`
times what it has, the excess is shared out again by weight); a source's repetition rate is target / size. Each document
is then taken floor(rate) times, and once more if a number in [0, 1) hashed from its id and the seed is below the
fraction. Built-in expressions only.

The per-source table has one row a source. It is broadcast only while it has at most `broadcast_sources` rows, else
joined by a shuffle in which every source is dealt out over `salts` keys, so that a hot source is no hot task.

Cases: null and empty text has size 0; a very long text counts its words where it is read and is taken whole or not at all;
the null source is a source, the last in order; sources of size 0 get target 0; sources that stop at the same level go by their
place in order; null ids hash as a fixed text; rows that repeat an id and source share their decision; an empty table gives
an empty mix; further columns pass through, also those of a result's name, as the results then take another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise, own, size_in_words, unique_name

SEED = 17
#: More sources than this are not broadcast.
BROADCAST_SOURCES = 10_000
SALTS = 64


def source_sizes(df: DataFrame, size: str, source: str = "source") -> DataFrame:
    """One row per source: its size and its place in code point order, null last."""
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # One row a source, summed before: the sort is over sources and not over documents.
    return sizes.withColumn("place", F.row_number().over(order).cast("long"))


def targets(sizes: DataFrame, weights: Column, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes with the target of each source, as a double: weights share out `share` of all sizes; a source whose part is
    above `most` times its size stops there, and what is left is shared by weight among the others, until none is above.

    The water level is found in one pass: in the order of most * size / weight the stopped sources come first."""
    sizes = sizes.withColumn("weight", weights.cast("double")).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    upto = Window.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = sizes.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    filled = (
        sizes.withColumn("before_size", F.sum("stop").over(upto) - F.col("stop"))
        .withColumn("before_weight", F.sum("weight").over(upto) - F.col("weight"))
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("before_size")) / (F.col("all_weight") - F.col("before_weight")))
    )
    # The first source that does not reach its stop sets the level for itself and all after it.
    open_ = F.col("level") * F.col("weight") <= F.col("stop")
    level = filled.where(open_).agg(F.min_by("level", F.struct(F.col("stop") / F.col("weight"), "place")).alias("water"))
    target = F.least(F.col("stop"), F.coalesce(F.col("water") * F.col("weight"), F.col("stop")))
    return sizes.crossJoin(F.broadcast(level)).select("source", "place", "source_size", target.alias("target"))


def chance(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a key and a seed: 48 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def copies(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    share: float = 1.0,
    most: float = 3.0,
    seed: int = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
    salts: int = SALTS,
) -> DataFrame:
    """df with mix = struct(size, source_size, target, copies): how often each document is taken. Sources weigh 1, 2, 3,
    repeating, in code point order."""
    mix, salt, of, plan_of, copy = (unique_name(df, x) for x in ("mix", "mix_salt", "mix_source", "mix_plan", "mix_copy"))
    size = size_in_words(F.col(text))
    sized = df.select(F.col(source).alias("source"), size.alias("size"))
    weights = (F.col("place") - 1) % 3 + 1
    plan = materialise(targets(source_sizes(sized, "size"), weights, share, most), "mix")
    side = plan.select(F.col("source").alias(of), F.struct("source_size", "target").alias(plan_of))
    if plan.count() <= broadcast_sources:
        joined = df.join(F.broadcast(side), df[source].eqNullSafe(side[of]), "left")
    else:
        dealt = df.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(salts)))
        side = side.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = dealt.join(side, dealt[source].eqNullSafe(side[of]) & (dealt[salt] == side[copy]), "left").drop(salt, copy)
    has = F.col(plan_of)["source_size"] > 0
    rate = F.when(has, F.least(F.col(plan_of)["target"] / F.col(plan_of)["source_size"], F.lit(float(most)))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    taken = (whole + (chance(F.col(key), seed) < rate - whole).cast("int")).cast("int")
    return joined.withColumn(mix, F.struct(size.alias("size"), F.col(plan_of)["source_size"].alias("source_size"), F.col(plan_of)["target"].alias("target"), taken.alias("copies"))).drop(of, plan_of)


def mixed(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: df's columns, each document as often as it is taken."""
    plan = copies(df, text, key, source, **options)
    mix = plan.columns[-1]
    n = unique_name(df, "mix_n")
    out = plan.where(F.col(mix)["copies"] > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(mix)["copies"])))
    return out.select(own(df))
