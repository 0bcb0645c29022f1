"""Sharding by jump consistent hashing (Lamping and Veach), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published hash: multiplier of its linear congruential generator.
JUMP_MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF
#: Rows that one task numbers, about. Only a task's size follows from it.
ROWS_PER_RUN = 200_000


def _next_state(key: Column) -> Column:
    """key * JUMP_MULTIPLIER + 1 modulo 2**64, by halves, so that nothing overflows under ANSI rules."""
    m_low, m_high = JUMP_MULTIPLIER & _LOW, JUMP_MULTIPLIER >> 32
    low, high = key.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(key, 32)
    # low is cut to 16 bits twice: each product stays under 2**48
    a, b = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_low) + F.lit(1), F.shiftrightunsigned(low, 16) * F.lit(m_low)
    bottom = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftrightunsigned(bottom, 32) + F.shiftrightunsigned(b, 16)

    def cross(x: Column, m: int) -> Column:  # x * m modulo 2**32, for x under 2**32
        x0, x1 = x.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(x, 16)
        return (x0 * F.lit(m) + F.shiftleft((x1 * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))

    top = (carry + cross(low, m_high) + cross(high, m_low)).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(top, 32).bitwiseOR(bottom.bitwiseAND(F.lit(_LOW)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a long key.

    Each step jumps ahead, so at most `shards` steps are needed; no ring table exists. Between
    n and n + 1 shards, a key either stays or goes to the new shard n.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        state = _next_state(s["key"])
        ahead = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(state, 33) + 1).cast("double"))).cast("long")
        live = s["j"] < shards
        return F.struct(
            F.when(live, state).otherwise(s["key"]).alias("key"),
            F.when(live, s["j"]).otherwise(s["b"]).alias("b"),
            F.when(live, ahead).otherwise(s["j"]).alias("j"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards by key: the id and the shard count decide, nothing else.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard). A slot
    is the place in the shard, without gaps. Numbering runs in two levels: rows fall into runs of
    bounded size by a hash, runs of one shard are offset by the counts of the runs before, and
    only a run is ever ordered in one task. So a shard may outgrow any machine.

    Null ids: all dealt as the id -1 is. Null text: size 1 and the checksum of no bytes. Repeated rows:
    each has its own slot. Other columns, whatever their names, play no part.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    runs = max(1, -(-docs.count() // (ROWS_PER_RUN * shards)))
    # the steps for one shard more pass through the same states, but each count is its own fold
    rows = rows.withColumns({
        "shard": jump_hash(key, shards),
        "grown_shard": jump_hash(key, shards + 1),
        "run": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(runs * 16)).cast("int"),
    })
    counts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32"))
    return (
        rows.withColumn("place", place)
        .join(offsets, ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
    )
