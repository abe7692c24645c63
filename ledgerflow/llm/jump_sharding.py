"""Jump consistent hashing: a stable key and the shard count alone give the shard.

Nothing is stored about the ring, and a further shard takes about 1/(n+1) of the rows,
each straight into itself. All of it is SQL expressions: one narrow shuffle for slots.

Law ``key``: shard = jump(key of doc_id, n). Cases: a null doc_id has a key of its own
(all such rows share a shard); a null text has size 16 and the crc32 of nothing (0);
rows that repeat get slots of their own (many null or repeated doc_ids with different texts
are numbered in several tasks); an empty table gives no rows; further columns
of the input are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40
#: Rows that one window task numbers at a time.
SLOT_ROWS = 200_000
# The multiplier of the generator that the published method names.
_LOW, _HIGH = 2862933555777941757 & 0xFFFFFFFF, 2862933555777941757 >> 32
_MASK = 0xFFFFFFFF


def _times(a: Column, b: int) -> tuple[Column, Column]:
    """High and low 32 bits of a*b for 32-bit a and b, in longs that can't overflow."""
    b0, b1 = b & 0xFFFF, b >> 16
    p0, p1 = a * F.lit(b0), a * F.lit(b1)  # under 2^48
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftright(p1, 16) + F.shiftright(low, 32), low.bitwiseAND(F.lit(_MASK))


def jump(hi: Column, lo: Column, shards: int) -> Column:
    """The shard of the 64-bit key hi*2^32+lo. Each step leaps to the next shard count
    at which the key moves; after the last of them the state stays as it is."""

    def step(s: Column, _: Column) -> Column:
        p_hi, p_lo = _times(s["lo"], _LOW)
        cross = _times(s["lo"], _HIGH)[1] + _times(s["hi"], _LOW)[1]
        low = p_lo + F.lit(1)
        nlo = low.bitwiseAND(F.lit(_MASK))
        nhi = (p_hi + cross + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK))
        to = F.floor((s["j"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(nhi, 1) + 1).cast("double"))
        return F.when(s["j"] < shards, F.struct(nhi.alias("hi"), nlo.alias("lo"), s["j"].alias("b"), to.cast("bigint").alias("j"))).otherwise(s)

    zero = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, step, lambda s: s["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    key = F.xxhash64(F.col("doc_id"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint") + 16).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.shiftrightunsigned(key, 32).alias("_hi"),
        key.bitwiseAND(F.lit(_MASK)).alias("_lo"),
    ).withColumns({"shard": jump(F.col("_hi"), F.col("_lo"), shards), "grown_shard": jump(F.col("_hi"), F.col("_lo"), shards + 1)})

    # Slots: every shard is cut into parts by a hash of the key and the text, parts are
    # numbered on their own, and the sizes of the parts before give where each part begins.
    n = docs.count()
    parts = max(1, math.ceil(n / (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64("_lo", "text_crc32", "size"), F.lit(parts)).cast("int").alias("_part")
    narrow = rows.select("_hi", "_lo", "text_crc32", "size") if parts > 1 else rows.select("_hi", "_lo", F.lit(0).alias("text_crc32"), F.lit(0).alias("size"))
    counts = narrow.groupBy(jump(F.col("_hi"), F.col("_lo"), shards).alias("shard"), part).count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_part", part).withColumn("_row", F.row_number().over(own).cast("bigint") - 1)
    if parts * shards <= 100_000:  # a row for each part: its size is known here
        starts = F.broadcast(starts)
    return placed.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_row")).alias("slot"), "grown_shard",
    )
