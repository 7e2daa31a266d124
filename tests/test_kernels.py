"""Kernels on series with known values, and the rules for missing and dirty input."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.functions import columns as C
from sextant.functions.kernels import Recursive, Series, with_recursive, with_rsi
from sextant.operators import indicators as I
from sextant.operators import normalize as N
from sextant.operators import quality as Q
from sextant.operators.joins import as_of_join

S = Series(("symbol",))


def bars(spark, closes, symbol="X", start="2025-01-01", spread=0.01):
    days = pd.date_range(start, periods=len(closes)).strftime("%Y-%m-%d")
    rows = [(symbol, d, str(c), str(c * (1 + spread)), str(c * (1 - spread)), i) for i, (d, c) in enumerate(zip(days, closes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, date string, close string, high string, low string, _ord long")


def test_flat_price_gives_neutral_cycle(spark):
    row = I.latest(I.cycle_frame(N.cycle(bars(spark, [250000.0] * 260)))).first()
    assert row.mayer_multiple == pytest.approx(1) and row.rsi14 == 50 and row.realized_volatility_30d == 0
    assert row.ahr999 == pytest.approx(250000 / row.ahr999_estimate_price)


def test_cycle_emits_from_minimum_history_and_slope_after_30(spark):
    rows = I.cycle_frame(N.cycle(bars(spark, [100.0 + i for i in range(205)])), 200).orderBy("date").collect()
    assert len(rows) == 6 and all(r["ahr999_30d_slope"] is None for r in rows)


def test_ramp_gives_rsi_100_and_drawdown_of_the_spread(spark):
    row = I.latest(I.technical_frame(N.technical(bars(spark, [100 + 0.2 * i for i in range(270)])))).first()
    assert row.rsi14 == 100 and row.drawdown_252d == pytest.approx(1 - 1 / 1.01)


def test_too_short_a_history_gives_no_rows(spark):
    assert I.technical_frame(N.technical(bars(spark, [100.0] * 251))).count() == 0


def test_symbols_stay_apart(spark):
    a, b = [100 + math.sin(i) * 5 for i in range(300)], [50 + math.cos(i) * 9 for i in range(300)]
    both = I.technical_frame(N.technical(bars(spark, a, "A").union(bars(spark, b, "B"))))
    alone = I.technical_frame(N.technical(bars(spark, b, "B")))
    assert sorted(both.where("symbol = 'B'").collect()) == sorted(alone.collect())


def test_ema_and_wilder_against_plain_loops(spark):
    x = [100 + math.sin(i / 3) * 10 + i * 0.1 for i in range(60)]
    rows = with_recursive(N.technical(bars(spark, x)), S, [Recursive("e", "ema", "close", 20), Recursive("w", "wilder_rsi", "close", 14)]).orderBy("date").collect()
    y, means = x[0], []
    for v in x:
        y = y + (v - y) * 2 / 21
        means.append(y)
    assert [r.e for r in rows[:19]] == [None] * 19
    assert [r.e for r in rows[19:]] == pytest.approx(means[19:])
    step = [b - a for a, b in zip(x, x[1:])]
    g, l = sum(max(s, 0) for s in step[:14]) / 14, sum(max(-s, 0) for s in step[:14]) / 14
    wanted = [50.0] * 14 + [100 - 100 / (1 + g / l)]
    for s in step[14:]:
        g, l = g * 13 / 14 + max(s, 0) / 14, l * 13 / 14 + max(-s, 0) / 14
        wanted.append(100 - 100 / (1 + g / l))
    assert [r.w for r in rows] == pytest.approx(wanted)


def test_simple_rsi_starts_at_row_15(spark):
    rows = with_rsi(N.technical(bars(spark, [100 + i % 3 for i in range(20)])), S, "close", 14, "r").orderBy("date").collect()
    assert [r.r is None for r in rows] == [True] * 14 + [False] * 6


def test_rotation_bounds_and_history(spark):
    x = [25 + 0.15 * i + 2 * math.sin(i / 7) for i in range(430)]
    row = I.rotation_latest(N.cycle(bars(spark, x, "SOXX"))).first()
    assert row.rsi14_dynamic_threshold >= 70 and 0.5 <= row.realized_volatility_10_dynamic_threshold <= 0.75
    assert row.bb_lower < row.bb_mid < row.bb_upper and row.ma20_slope == pytest.approx((x[-1] - x[-21]) / 20)
    assert I.rotation_latest(N.cycle(bars(spark, x[:419], "SOXX"))).count() == 0


def test_dirty_rows_are_counted(spark):
    rows = [("x", "2025-01-01", "100", 0), ("x", "2025-01-01", "101", 1), ("x", "2025-01-05", "102", 2), ("x", "bad-date", "103", 3), ("x", "2025-01-06", "0", 4)]
    r = Q.ohlcv_report(spark.createDataFrame(rows, "series string, date string, close string, _ord long"), None, 200, 1).first()
    assert (r.raw_row_count, r.normalized_row_count, r.duplicate_date_count, r.invalid_date_count, r.non_positive_close_count, r.max_gap_days) == (5, 2, 1, 1, 1, 4)
    assert r.quality_status == "fail" and r.failure_reasons == ["insufficient_history_rows"]


def test_context_frame_dedupes_before_the_range_and_its_report_after(spark):
    rows = [("c", "2025-01-01", "0.5", "0.5", "0.5", 0), ("c", "2025-01-01", "1.5", "0.5", "0.5", 1)]
    df = spark.createDataFrame(rows, "series string, date string, cape_percentile string, vix_percentile string, breadth_above_sma200_pct string, _ord long")
    assert N.context(df).count() == 0
    assert Q.context_report(df).first().normalized_row_count == 1


def test_look_ahead_always_fails(spark):
    rows = [("c", "2025-01-01", "0.5", "0.5", "0.5", "2025-02-01T00:00:00Z", 0)]
    df = spark.createDataFrame(rows, "series string, date string, cape_percentile string, vix_percentile string, breadth_above_sma200_pct string, provider_timestamp string, _ord long")
    r = Q.context_report(df, "2025-01-31").first()
    assert r.failure_reasons == ["provider_timestamp_after_as_of"] and r.quality_status == "fail"
    assert "missing_breadth_universe_snapshot_column" in Q.context_report(df, strict=True).first().failure_reasons


def test_as_of_join_takes_equal_dates_and_keeps_left_rows(spark):
    l = spark.createDataFrame([("s", "2025-01-01", 1.0), ("s", "2025-01-03", 2.0)], "series string, date string, v double")
    r = spark.createDataFrame([("s", "2025-01-03", 9.0), ("s", "2025-01-04", 8.0)], "series string, date string, c double")
    assert [(x.v, x.c) for x in as_of_join(l, r, ("series",), "v", "c").orderBy("date").collect()] == [(1.0, None), (2.0, 9.0)]


def test_scalars_keep_null(spark):
    df = spark.createDataFrame([(None, 1.0), (5.0, 0.0)], "x double, y double")
    rows = df.select(C.clamp(F.col("x"), 0, 1).alias("c"), C.ratio_gap(F.col("x"), F.col("y")).alias("g"), C.drawdown_or_zero(F.col("x"), F.lit(None).cast("double")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(None, None, 0.0), (1.0, None, 0.0)]


def test_text_numbers(spark):
    rows = spark.createDataFrame([(".",), ("NaN",), ("1e3",), ("inf",)], "x string").select(C.number(F.col("x")).alias("n")).collect()
    assert [r.n for r in rows] == [None, None, 1000.0, math.inf]


def test_expanding_percentile_counts_ties(spark):
    rows = [("m", f"2025-01-0{i + 1}", v) for i, v in enumerate((20.0, 10.0, 30.0, 20.0))]
    df = I.expanding_percentile(spark.createDataFrame(rows, "series string, date string, value double"))
    assert [r.percentile for r in df.orderBy("date").collect()] == [1.0, 0.5, 1.0, 0.75]
