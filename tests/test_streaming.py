"""Streamed bars equal batch bars of the days that the watermark has passed."""

from pyspark.sql import functions as F

from sextant.streaming.bars import append_bars, daily_bars


def test_streamed_bars(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    trades = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"))
    trades.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    append_bars(daily_bars(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.symbol, str(r.date)): (r.close, r.high, r.low, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    day = F.to_date("ts")
    want = trades.groupBy("symbol", day.alias("date")).agg(F.max_by("price", F.struct("ts", "price")), F.max("price"), F.min("price"), F.sum("quantity")).collect()
    want = {(r[0], str(r[1])): tuple(r[2:]) for r in want}
    last = max(d for _, d in want)
    assert got and all(want[k] == v for k, v in got.items())
    assert {k for k in want if k[1] < last} - set(got) <= {k for k in want if k[1] >= sorted({d for _, d in want})[-3]}
