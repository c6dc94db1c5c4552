"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard depends on its key and the number of shards alone, and one more
shard takes rows only into itself (law ``key``). No ring table exists: the
shard is the end of a walk through a linear congruential generator seeded with
the key (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash").

Spark's 64-bit arithmetic does not wrap under ANSI rules, so the generator runs
on two unsigned 32-bit halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import materialise

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_MASK = 0xFFFFFFFF
_M_HI, _M_LO = MULTIPLIER >> 32, MULTIPLIER & _MASK
#: Most walks end within so many steps; longer ones go on in a second loop.
SHORT_WALK = 8


def _low32(a: Column, b: int) -> Column:
    """Low 32 bits of a * b for unsigned 32-bit a and b, without overflow."""
    b1, b0 = b >> 16, b & 0xFFFF
    return (a * F.lit(b0) + F.shiftleft((a * F.lit(b1)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    m1, m0 = _M_LO >> 16, _M_LO & 0xFFFF
    p0, p1 = lo * F.lit(m0), lo * F.lit(m1)
    low = p0.bitwiseAND(F.lit(_MASK)) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(INCREMENT)
    carried = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low, 32)
    high = _low32(hi, _M_LO) + _low32(lo, _M_HI) + carried
    return high.bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))


def _walk(state: Column, shards: int, steps: int) -> Column:
    def step(at: Column, _: Column) -> Column:
        hi, lo = _advance(at["hi"], at["lo"])
        ahead = F.floor((at["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(at["j"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), at["j"].alias("b"), ahead.alias("j"))).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)


def jump_state(key: Column, shards: int) -> Column:
    """Struct whose ``b`` is the shard of ``key``; ``j`` is the next shard number at which it would move."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_MASK)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    return _walk(start, shards, min(SHORT_WALK, shards))


def jump_hash(df: DataFrame, key: Column, shards: int, shard: str, grown: str | None = None) -> DataFrame:
    """Adds the shard of each row, and in ``grown`` its shard among one more."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    out = df.withColumn("__walk", jump_state(key, shards))
    if shards > SHORT_WALK:
        rest = _walk(F.col("__walk"), shards, shards - SHORT_WALK)
        out = out.withColumn("__walk", F.when(F.col("__walk.j") < shards, rest).otherwise(F.col("__walk")))
    out = out.withColumn(shard, F.col("__walk.b").cast("int"))
    if grown:
        out = out.withColumn(grown, F.when(F.col("__walk.j") == shards, F.lit(shards)).otherwise(F.col("__walk.b")).cast("int"))
    return out.drop("__walk")


def _key(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(F.col(name))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: where it goes, in which slot, and where with one more shard.

    ``size`` is the UTF-8 length plus 16, null texts count as empty. Slots are
    gapless from 0 and follow (id with nulls first, size, checksum). A null id
    hashes as key 0; keys that are not integers go through XXH64 first. Repeated
    rows get a slot each. An empty table gives no rows. Other columns are not read.

    One shuffle of the narrow rows, by ranges of the slot order; then each range
    numbers its own rows and adds what earlier ranges hold of the shard. That
    table of starts has one row per range and shard border, so it is broadcast.
    """
    narrow = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        _key(docs, id_col).alias("__key"),
    )
    placed = jump_hash(narrow, F.col("__key"), shards, "shard", "grown_shard").drop("__key")
    order = ["shard", id_col, "size", "text_crc32"]
    ranged = (
        # rows that are alike in every column may be parted anywhere
        placed.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "__tie")
        .sortWithinPartitions(*order)
        .drop("__tie")
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    kept = materialise(ranged, "shard-slots").withColumn("__range", F.shiftright("__pos", 33))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kept.groupBy("shard", "__range")
        .agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    slot = F.col("__pos") - F.col("__first") + F.col("__before")
    return kept.join(F.broadcast(starts), ["shard", "__range"]).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard"
    )
