"""Market series derived from the driver's tables, which hold no market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close, high, low, volume): trades of lineitem by return flag and day."""
    rank = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    trades = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"), px.alias("px"), "l_quantity", F.struct(*rank).alias("r"))
    return trades.groupBy("symbol", "date").agg(
        F.max_by("px", "r").alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").alias("volume"), F.lit(0).alias("_ord")
    )


def cycle_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close, high): orders by day, moved 20 years on."""
    orders = read(spark, sf_dir, "orders")
    day = F.date_add(F.to_date("o_orderdate"), 7305)
    return orders.groupBy(day.alias("date")).agg(
        F.lit("BTC-USD").alias("symbol"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.lit(0).alias("_ord")
    )


def daily_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"))
    return rows.agg(F.max("l_extendedprice").alias("value"), F.lit("m").alias("series"), F.lit(0).alias("_ord"))


def monthly_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date"))
    return rows.agg(F.max("o_totalprice").alias("value"), F.lit("m").alias("series"), F.lit(0).alias("_ord"))


def status_metric(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy(F.to_date("o_orderdate").alias("date"))
    return rows.agg(F.max("o_totalprice").alias("value"), F.lit("p").alias("series"), F.lit(0).alias("_ord"))


def dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, close, _ord) as text, with bad dates, missing and negative closes."""
    e = F.col("event_id")
    date = F.when(e % 97 == 0, "bad-date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    close = F.when(e % 89 == 0, ".").when(e % 83 == 0, "-1.0").otherwise(F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), date.alias("date"), close.alias("close"), e.alias("_ord"))


def _spread(e):
    return F.date_add(F.lit("2020-01-01").cast("date"), (e * 3 % 4001).cast("int"))


def uneven_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events on days that squares of their ids spread unevenly."""
    e = F.col("event_id")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (e * e % 9973).cast("int"))
    return read(spark, sf_dir, "events").select(F.lit("e").alias("series"), day.alias("date"), F.col("value").alias("close"), e.alias("_ord"))


def sparse_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").where(e % 7 < 3).select(F.lit("g").alias("series"), _spread(e).alias("date"), F.col("value").alias("close"), e.alias("_ord"))


def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context rows with missing and out-of-range values and point-in-time columns."""
    e = F.col("event_id")
    part = lambda n: F.when(e % 31 != 0, (e % n) / 100)
    stamp = F.when(e % 53 == 0, "never").otherwise(F.date_format(F.date_add(_spread(e), F.when(e % 59 == 0, 2).otherwise(0)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, sf_dir, "events").select(
        F.lit("c").alias("series"),
        _spread(e).alias("date"),
        part(113).alias("cape_percentile"),
        part(101).alias("vix_percentile"),
        part(97).alias("breadth_above_sma200_pct"),
        stamp.alias("provider_timestamp"),
        F.when(e % 61 == 0, " ").otherwise("snap").alias("breadth_universe_snapshot_id"),
        F.date_format(F.date_add(_spread(e), F.when(e % 67 == 0, 1).otherwise(0)), "yyyy-MM-dd").alias("breadth_universe_as_of"),
        e.alias("_ord"),
    )
