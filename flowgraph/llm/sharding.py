"""Sharding by jump consistent hashing.

A stable key is mapped to one of n shards without a table of ring points: with n + 1 shards a key either stays or moves
to the new shard. The generator is the published one, a 64-bit linear congruential step. Its product is taken in three
limbs of 24, 24 and 16 bits, so that no expression overflows, under ANSI rules too. Built-in expressions only.

Rows get gapless slots within their shard. A shard may hold more rows than one task should sort: it is cut into `parts`
by a hash of the row, each part is numbered on its own and starts after the rows of the parts before it (their counts are
summed before they are shuffled, shards * parts rows in all). Parts follow a count of the rows, so that what one task sorts
stays the same size however large the table is.

Cases: a null key counts as 0; null text has no bytes and the CRC 0; equal rows (the only ties) get different slots, in any
order; a very long text is one row of its shard, and is sorted by its key, CRC and size and not by its text; an empty table
gives an empty result; further columns pass through, but for those of a result's name, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import unique_name, without

#: Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
LIMB, TOP = (1 << 24) - 1, (1 << 16) - 1
#: Parts of a shard, at least, and rows that a part is to have, on average, once there are more.
PARTS, PART_ROWS = 64, 1 << 18


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a 64-bit key among `shards`."""
    c0, c1, c2 = MULTIPLIER & LIMB, MULTIPLIER >> 24 & LIMB, MULTIPLIER >> 48 & TOP
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def state(low, mid, high, shard, jump):
        return F.struct(low.alias("low"), mid.alias("mid"), high.alias("high"), shard.alias("shard"), jump.alias("jump"))

    def step(s: Column, _: Column) -> Column:
        p0 = s["low"] * F.lit(c0) + F.lit(1)
        p1 = s["mid"] * F.lit(c0) + s["low"] * F.lit(c1) + F.shiftright(p0, 24)
        p2 = s["high"] * F.lit(c0) + s["mid"] * F.lit(c1) + s["low"] * F.lit(c2) + F.shiftright(p1, 24)
        low, mid, high = p0.bitwiseAND(F.lit(LIMB)), p1.bitwiseAND(F.lit(LIMB)), p2.bitwiseAND(F.lit(TOP))
        upper = F.shiftleft(high, 15).bitwiseOR(F.shiftright(mid, 9))  # the upper 31 bits
        jump = F.floor((s["jump"] + 1) * (F.lit(float(1 << 31)) / (upper + 1).cast("double")))
        return F.when(s["jump"] < F.lit(shards), state(low, mid, high, s["jump"], jump)).otherwise(s)

    start = state(
        key.bitwiseAND(F.lit(LIMB)), F.shiftright(key, 24).bitwiseAND(F.lit(LIMB)), F.shiftright(key, 48).bitwiseAND(F.lit(TOP)),
        F.lit(-1).cast("long"), F.lit(0).cast("long"),
    )
    # Each round that still jumps raises the shard, so that `shards` rounds always are enough.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def sharded(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """df with shard (int), slot (long, gapless from 0 in each shard), size (bytes of the text plus 8), text_crc32 and
    grown_shard (the shard with one shard more). parts: of each shard; None counts df for it, once more."""
    parts = parts or max(PARTS, -(-df.count() // (shards * PART_ROWS)))
    df = without(df, ("shard", "slot", "size", "text_crc32", "grown_shard"), key)
    part, shift, rank, s, p = (unique_name(df, x) for x in ("shard_part", "shard_shift", "shard_rank", "shard_of", "shard_part_of"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (
        df.withColumn("shard", jump_shard(F.col(key), shards))
        .withColumn("grown_shard", jump_shard(F.col(key), shards + 1))
        .withColumn("size", F.octet_length(body).cast("long") + 8)
        .withColumn("text_crc32", F.crc32(body))
        .withColumn(part, F.pmod(F.coalesce(F.col(key), F.lit(0)) + F.col("text_crc32"), F.lit(parts)))
    )
    counts = rows.groupBy(F.col("shard").alias(s), F.col(part).alias(p)).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(s).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(s, p, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift))
    within = Window.partitionBy("shard", part).orderBy(F.col(key), F.col("text_crc32"), F.col("size"))
    joined = rows.withColumn(rank, F.row_number().over(within)).join(
        F.broadcast(starts) if shards * parts <= 1 << 17 else starts, (F.col("shard") == F.col(s)) & (F.col(part) == F.col(p))
    )
    return joined.withColumn("slot", (F.col(shift) + F.col(rank) - 1).cast("long")).drop(s, p, part, shift, rank)
