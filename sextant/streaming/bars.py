"""Daily bars from a stream of trades, and their upkeep in a table.

An extension: batch queries don't need it. Late trades within the watermark still change their
day's bar; a bar is emitted once the watermark has passed its day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_bars(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """(symbol, date, close, high, low, volume) of a stream of (symbol, ts, price, quantity).

    The close is the price of the last trade, the higher price on equal times.
    """
    day = F.window("ts", "1 day")
    bars = trades.withWatermark("ts", late).groupBy(day.alias("w"), "symbol").agg(
        F.max_by("price", F.struct("ts", "price")).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume")
    )
    return bars.select("symbol", F.to_date("w.start").alias("date"), "close", "high", "low", "volume")


def append_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed bars to Parquet partitioned by symbol, exactly once, until nothing is left."""
    writer = bars.writeStream.outputMode("append").format("parquet").partitionBy("symbol")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
