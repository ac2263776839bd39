"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in native expressions.

A key's 64-bit state runs through a linear congruential generator; each step jumps to the
next shard count at which the key would move. The shard is the last one below the count, so
with one more shard a key either stays or moves to the new one. There is no ring table.

Defined cases: a null key counts as the empty text; a null text has size 1 and checksum 0;
repeated rows get the same shard and slots of their own; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

# Fixed values of the published generator: 2862933555777941757 in two 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
LOW32 = (1 << 32) - 1
STEPS = 48  # jumps every row makes; rows that need more are finished by a longer loop


def key_halves(key: Column) -> tuple[Column, Column]:
    """Two 32-bit halves of a 64-bit digest of the key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return half(1), half(9)


def _low_product(a: Column, c: int) -> Column:
    """Low 32 bits of a 32-bit number times a 32-bit constant, without overflow."""
    upper = (F.shiftright(a, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF))
    return (a.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + F.shiftleft(upper, 16)).bitwiseAND(F.lit(LOW32))


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """``state * multiplier + 1`` modulo 2^64 on 32-bit halves."""
    first = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LOW)
    second = F.shiftright(low, 16) * F.lit(MULTIPLIER_LOW)
    total = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(second, 16)
    new_high = carry + _low_product(high, MULTIPLIER_LOW) + _low_product(low, MULTIPLIER_HIGH)
    return new_high.bitwiseAND(F.lit(LOW32)), total.bitwiseAND(F.lit(LOW32))


def _jumps(high: Column, low: Column, shards: int, steps: int) -> Column:
    """State after at most ``steps`` jumps: halves, current shard, next shard."""

    def step(state: Column, _: Column) -> Column:
        new_high, new_low = _advance(state["high"], state["low"])
        divisor = (F.shiftright(new_high, 1) + 1).cast("double")
        target = F.floor((state["next"] + 1).cast("double") * (F.lit(2147483648.0) / divisor))
        moved = F.struct(
            new_high.alias("high"),
            new_low.alias("low"),
            state["next"].alias("shard"),
            target.alias("next"),
        )
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        high.alias("high"),
        low.alias("low"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_shard(high: Column, low: Column, shards: int) -> Column:
    """Shard in ``0 .. shards - 1`` of a key given by its two halves.

    A row makes about ``ln(shards)`` jumps and at most ``shards``. The short loop ends for
    practically every row; the full one is evaluated only for a row that is not done.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    brief = _jumps(high, low, shards, min(STEPS, shards))
    if shards <= STEPS:
        return brief["shard"].cast("int")
    whole = _jumps(high, low, shards, shards)
    return F.when(brief["next"] >= shards, brief["shard"]).otherwise(whole["shard"]).cast("int")


def shard_documents(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", ranges: int = 4096
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each document.

    Slots follow the key's digest. A shard is numbered in ``ranges`` ranges of the digest, each
    shifted by the rows of the ranges before it, so no task holds a shard. The counts that are
    broadcast number ``shards * ranges`` at most.
    """
    ranges = max(1, min(ranges, 200_000 // shards))  # bounds the broadcast table of counts
    text_col = text_of(text)
    high, low = key_halves(F.col(key))
    keyed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_col) + 1).cast("long").alias("size"),
        F.crc32(text_col.cast("binary")).alias("text_crc32"),
        high.alias("_high"),
        low.alias("_low"),
    )
    placed = keyed.select(
        "*",
        jump_shard(F.col("_high"), F.col("_low"), shards).alias("shard"),
        jump_shard(F.col("_high"), F.col("_low"), shards + 1).alias("grown_shard"),
        F.shiftright(F.col("_high") * ranges, 32).cast("int").alias("_range"),
    )
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy("shard", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_range").orderBy(
        "_high", "_low", "doc_id", "size", "text_crc32"
    )
    return placed.join(F.broadcast(shift), ["shard", "_range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.row_number().over(inside) - 1 + F.col("_before")).cast("long").alias("slot"),
        "grown_shard",
    )
