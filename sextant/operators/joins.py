"""Joins of series by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.blocks import block_size, in_blocks, placed


def as_of_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], value: str, right_value: str, order: str = "date", long: bool = False) -> DataFrame:
    """Each left row with the right value at the latest ``order`` at or before; NULL without one.

    Both sides go through one sorted pass: right rows sort first on equal dates, and the last right value
    seen is carried to left rows. No product of the sides arises. A pass covers a key, or with ``long``, where a
    key may hold any share of the rows, a block of rows in a range of time.
    """
    l = left.select(*keys, order, F.col(value).alias("_left"), F.lit(None).cast(right.schema[right_value].dataType).alias("_right"), F.lit(1).alias("_side"))
    r = right.select(*keys, order, F.lit(None).cast(left.schema[value].dataType).alias("_left"), F.col(right_value).alias("_right"), F.lit(0).alias("_side"))
    both = l.unionByName(r)
    if long:
        joined = _carried_over_blocks(both, keys, order)
    else:
        w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
        joined = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(w))
    return joined.where("_side = 1").select(*keys, order, F.col("_left").alias(value), F.col("_seen").alias(right_value))


def _carried_over_blocks(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """``rows`` with ``_seen``, the last known ``_right`` of their key so far.

    Rows have places by (keys, order, side), and equal blocks of places are windows of their own. What a block's first
    key carries in is the last value of that key in the blocks before; those values, one a block, are
    scanned on the driver.
    """
    spark = rows.sparkSession
    numbered, count = placed(rows, [*keys, order, "_side"], "_place")
    blocks = in_blocks(numbered, "_place", block_size(count), count)
    key = F.struct(*keys) if keys else F.lit(0)
    by_key = blocks.groupBy("_block", key.alias("_key")).agg(
        F.min("_place").alias("low"), F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_place"))).alias("v")
    )
    ends = by_key.groupBy("_block").agg(F.min_by("_key", "low").alias("first"), F.max_by(F.struct("_key", "v"), "low").alias("last"))
    carried, before = [], None
    for b in sorted(ends.collect(), key=lambda b: b._block):  # MOST_BLOCKS rows at most
        into = before[1] if before is not None and before[0] == b.first else None
        carried.append((b._block, into))
        own = b.last.v
        before = (b.last._key, into if own is None and b.first == b.last._key else own)
    schema = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_into", rows.schema["_right"].dataType)])
    table = F.broadcast(spark.createDataFrame(carried, schema))
    w = Window.partitionBy("_block", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("_place").over(Window.partitionBy("_block", *keys)) == F.col("_block") * block_size(count)
    seen = F.coalesce(F.last("_right", ignorenulls=True).over(w), F.when(first, F.col("_into")))
    return blocks.join(table, "_block").withColumn("_seen", seen)


def same_day_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Inner join on exact dates, nothing carried forward."""
    return left.join(right, [*keys, "date"], "inner")
