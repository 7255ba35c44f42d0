"""Sharding by jump consistent hashing, in column expressions only.

Jump hashing (Lamping and Veach, 2014) walks a pseudo-random sequence seeded by the key and keeps the last jump below
the number of shards. It needs no ring table, and one more shard takes rows only into itself. The 64-bit generator is
computed in 32-bit halves, as Spark's ANSI arithmetic raises an error where a product wraps around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm.common import partitions

#: The multiplier of the published algorithm (fixed value).
MULTIPLIER = 2862933555777941757
_MASK = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of (hi, lo) * MULTIPLIER + 1 mod 2**64; no part passes 2**50."""
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & _MASK
    p0, p1 = lo * F.lit(a_lo & 0xFFFF), lo * F.lit(a_lo >> 16)
    s = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(p1, 16)

    def low_product(x: Column, k: int) -> Column:
        return _low(x * F.lit(k & 0xFFFF) + F.shiftleft(_low(x * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))

    return _low(carry + low_product(lo, a_hi) + low_product(hi, a_lo)), _low(s)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a bigint key (null: as key 0). Each step jumps ahead by one at least, so `shards` steps do."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("bigint"), F.lit(0))
    start = F.struct(_low(F.shiftrightunsigned(key, 32)).alias("hi"), _low(key).alias("lo"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def walk(acc: Column, _: Column) -> Column:
        hi, lo = _step(acc["hi"], acc["lo"])
        ahead = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")))
        on = acc["j"] < F.lit(shards)
        return F.struct(hi.alias("hi"), lo.alias("lo"), F.when(on, acc["j"]).otherwise(acc["b"]).alias("b"), F.when(on, ahead).otherwise(acc["j"]).alias("j"))

    return F.aggregate(F.array_repeat(F.lit(0), shards), start, walk, lambda acc: acc["b"].cast("int"))


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shard_rows(df: DataFrame, key: Column, shards: int, order: list[Column]) -> DataFrame:
    """Add shard, slot (gapless from 0 in each shard) and grown_shard (with one shard more).

    Rows of a shard are first dealt to buckets by a hash of `order`, numbered within their bucket, and moved on by the
    count of rows in earlier buckets: no shard is sorted by one task. The table of counts has at most shards * buckets
    rows, whatever the input. Defined cases: a null key counts as 0; equal keys share a shard; equal rows get different
    slots; an empty table gives no rows; the input's other columns are kept, but for the three names that are added.
    """
    buckets = 4 * partitions(df.sparkSession)
    bucket, rank, count, before = (_free(df, name) for name in ("_bucket", "_rank", "_n", "_before"))
    # the columns are evaluated together: key and order mean the input's columns, also those called like the added ones
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in ("shard", "grown_shard", "slot")]
    ordered = [(_free(df, f"_order{k}"), c) for k, c in enumerate(order)]
    put = df.select(*kept, *[c.alias(name) for name, c in ordered], jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias(bucket))
    counts = put.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(count))
    earlier = counts.select("shard", bucket, (F.sum(count).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(count)).alias(before))
    numbered = put.withColumn(rank, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*[name for name, _ in ordered])) - 1)
    out = numbered.join(F.broadcast(earlier), ["shard", bucket])  # at most shards * buckets rows of 20 bytes
    return out.withColumn("slot", F.col(before) + F.col(rank)).drop(bucket, rank, before, *[name for name, _ in ordered])


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; a null text is empty, a null doc_id counts as 0, and
    ids may be of any type."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # what is shuffled is narrow: the texts are measured in the scan
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    # the key is hashed first, as consecutive ids are no random seeds
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(0).cast("bigint"))).otherwise(F.xxhash64("doc_id"))
    out = shard_rows(rows, key, shards, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_hash_reference(key: int, shards: int) -> int:
    """The published loop in Python, for tests."""
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < shards:
        b = j
        key = (key * MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


__all__ = ["jump_hash", "jump_hash_reference", "shard_documents", "shard_rows"]
