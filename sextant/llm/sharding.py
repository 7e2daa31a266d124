"""Sharding by jump consistent hashing (DataFrame functions only).

A key's shard is the last step below ``n_shards`` of a pseudo-random walk of
growing jumps that depends on the key alone. Appending a shard therefore moves
just the keys whose walk lands on the new shard, and needs no ring table.

The walk's generator is the 64-bit linear congruential one of the published
algorithm. Its products leave 64 bits, so they are taken as decimal(38, 0),
whose range holds (2^64 - 1) * multiplier + 1 exactly.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S
from .shared import gapless_rank, table

# Fixed values of the published algorithm.
MULTIPLIER = Decimal(2862933555777941757)
TWO_31 = 2147483648.0
TWO_33 = Decimal(8589934592)
TWO_64 = Decimal(18446744073709551616)


def jump_shards(key: Column, n_shards: int) -> Column:
    """struct(shard, grown): the shard of ``key`` among ``n_shards`` and among one more.

    Null keys count as 0. ``key`` is a long; negative ones wrap to unsigned. A walk takes about
    ln(n_shards) jumps; the few that take over twice as many and 4 go on in a second fold.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    unsigned = F.coalesce(key, F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(unsigned < 0, unsigned + F.lit(TWO_64)).otherwise(unsigned).cast("decimal(20,0)")
    start = F.struct(
        unsigned.alias("state"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(-1).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("next"),
    )

    def jump(acc: Column, _: Column) -> Column:
        state = ((acc.state * F.lit(MULTIPLIER) + F.lit(1)) % F.lit(TWO_64)).cast("decimal(20,0)")
        high = F.floor(state / F.lit(TWO_33)).cast("long")
        leap = F.floor((acc.next + 1) * (F.lit(TWO_31) / (high + 1).cast("double"))).cast("long")
        walked = F.struct(
            state.alias("state"),
            F.when(acc.next < n_shards, acc.next).otherwise(acc.shard).alias("shard"),
            acc.next.alias("grown"),
            leap.alias("next"),
        )
        return F.when(acc.next < n_shards + 1, walked).otherwise(acc)

    first = min(n_shards + 1, 2 * math.ceil(math.log(n_shards + 1)) + 4)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, jump)
    if first < n_shards + 1:
        rest = F.sequence(F.lit(first + 1), F.lit(n_shards + 1))
        walk = S.let(walk, lambda w: F.when(w.next < n_shards + 1, F.aggregate(rest, w, jump)).otherwise(w))
    return S.let(walk, lambda w: F.struct(w.shard.cast("int").alias("shard"), w.grown.cast("int").alias("grown")))


def shard_key(docs: DataFrame, id_col: str) -> Column:
    """The long that an id is sharded by: whole numbers of up to 64 bits themselves, others by a hash
    of their text. A null id stays null."""
    key = F.col(id_col)
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return key.cast("long")
    return F.when(key.isNotNull(), F.xxhash64(key.cast("string")))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and its place in it.

    Output: id, size (UTF-8 bytes of the text plus 8), text_crc32, law (`key`),
    shard, slot (gapless from 0 in the shard), grown_shard (with one shard more).
    A null text has size 8 and the crc32 of no bytes; a null id hashes as 0, ids that aren't whole
    numbers go by a hash of their text.
    Repeated rows share a shard and get slots of their own. Extra columns of
    ``docs`` are left out. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shards(shard_key(docs, id_col), n_shards).alias("_s"),
    ).select(id_col, "size", "text_crc32", "law", F.col("_s.shard").alias("shard"), F.col("_s.grown").alias("grown_shard"))
    order = [F.col(id_col), F.col("text_crc32"), F.col("size")]
    return gapless_rank(rows, ["shard"], order, F.concat_ws(":", F.col(id_col).cast("string"), F.col("text_crc32").cast("string")), "slot").select(
        id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet under ``path``, one folder ``shard=k`` per shard."""
    shard = jump_shards(shard_key(docs, id_col), n_shards).shard
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)


N_SHARDS = 24


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), N_SHARDS)

