"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shard follows from the key and the number of shards: a generator seeded with the key
names the shard counts at which the key jumps, always into the shard just added.  There is no
ring table to keep, and one more shard takes 1 / (n + 1) of the rows, only into itself.

The generator is the 64-bit linear congruential one of the published algorithm.  Spark's ANSI
arithmetic rejects overflow, so the state is held as two 32-bit halves and multiplied in parts.
The jumps are folded over ``sequence(1, n)``; at most n - 1 jumps can occur, so the fold is exact.

``slot`` numbers the rows of a shard without gaps.  No shard is ever gathered in one task: rows
are numbered inside (shard, bucket) groups of an even hash, and each group starts where the
groups before it end.  That table of starts has at most ``STARTS`` rows, whatever the input.

Defined cases: a null key counts as key 0; a null text has size 1 and crc32 0; repeated rows each
get a slot of their own; an empty table gives an empty result; columns of the input named like
an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibra.llm._spark import fresh, table, written

#: Fixed values of the published algorithm: multiplier of its generator, and the increment 1.
MULTIPLIER = 2862933555777941757

STARTS = 1 << 15
_MASK32 = 0xFFFFFFFF


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64, each product below 2**63."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _MASK32
    a, b = m_lo >> 16, m_lo & 0xFFFF
    low = lo * b + F.shiftleft((lo * a).bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(lo * a, 16) + (lo * m_hi).bitwiseAND(_MASK32)
    high = carry + hi * b + F.shiftleft((hi * a).bitwiseAND(0xFFFF), 16)
    return high.bitwiseAND(_MASK32), low.bitwiseAND(_MASK32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a long key; null counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_MASK32).alias("lo"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(-1).cast("long").alias("next"),
    )

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next(acc["hi"], acc["lo"])
        took = F.when(acc["next"] < 0, F.lit(0).cast("long")).otherwise(acc["next"])
        # next = floor((shard + 1) * 2**31 / ((state >> 33) + 1))
        ahead = F.floor((took + 1) * (1 << 31) / (F.shiftright(hi, 1) + 1).cast("double")).cast("long")
        jumped = F.struct(hi.alias("hi"), lo.alias("lo"), took.alias("shard"), ahead.alias("next"))
        return F.when(acc["next"] >= shards, acc).otherwise(jumped)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"].cast("int"))


def sized(df: DataFrame) -> DataFrame:
    """Adds size (bytes of the text plus one) and text_crc32."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return df.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})


def assign_shards(df: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """``df`` with law, shard and grown_shard (the shard, were there one more)."""
    return df.withColumns({
        "law": F.lit("key"),
        "shard": jump_shard(F.col(key), shards),
        "grown_shard": jump_shard(F.col(key), shards + 1),
    })


def number_slots(df: DataFrame, shards: int) -> DataFrame:
    """``df`` (with shard), and slot: 0, 1, ... within each shard. The rows are written to the shared folder first."""
    buckets = max(1, STARTS // shards)
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    bucket, start, at = fresh(df, "bucket", "start", "at")
    rows = written(df.drop("slot").withColumn(bucket, spread))
    sizes = rows.groupBy("shard", bucket).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", bucket, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(start))
    number = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(bucket))
    out = rows.withColumn(at, number).join(F.broadcast(starts), ["shard", bucket])
    return out.withColumn("slot", F.col(start) + F.col(at) - 1).drop(bucket, at, start)


def write_shards(df: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """Writes ``df`` as one folder for each shard (shard=0, shard=1, ...)."""
    assign_shards(df, shards, key).drop("law", "grown_shard").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = assign_shards(sized(docs).drop("text"), 8)
    return number_slots(rows, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
