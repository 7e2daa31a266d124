"""Scalar rules as functions of columns. NULL is the only missing value: NaN never enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "2009-01-03"  # fixed value: first day of the age estimate


def number(c: Column) -> Column:
    """Text or number to double; what can't be parsed, and NaN, is NULL; infinities stay."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def day(c: Column) -> Column:
    """Calendar date of a text or timestamp, NULL if it has none."""
    return c.try_cast("date")


def strict_day(c: Column) -> Column:
    """As ``day``, but a value without a date raises (ANSI cast)."""
    return c.cast("date")


def utc_day(c: Column) -> Column:
    """Date of a timestamp text after conversion to UTC (the session's time zone)."""
    return F.to_date(c.try_cast("timestamp"))


def ratio_gap(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d - 1)


def drawdown(close: Column, high: Column) -> Column:
    """1 - close / high, not under 0; NULL unless high is positive."""
    x = 1 - close / high
    return F.when((high > 0) & close.isNotNull(), F.greatest(F.lit(0.0), x))


def drawdown_or_zero(close: Column, high: Column) -> Column:
    """As ``drawdown``, but 0 without a positive high."""
    return F.coalesce(drawdown(close, high), F.lit(0.0))


def gap_or_zero(close: Column, mean: Column) -> Column:
    return F.coalesce(ratio_gap(close, mean), F.lit(0.0))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Floor first, then cap; NULL stays NULL (greatest and least alone would skip it)."""
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def signed_component(x: Column) -> Column:
    return clamp(x / 0.10, -1.0, 1.0)


def trend_score(close: Column, sma50: Column, sma200: Column, rsi14: Column) -> Column:
    """Weighted components in [-1, 1]; NULL if any input is."""
    return (
        signed_component(ratio_gap(close, sma200)) * 0.40
        + signed_component(ratio_gap(sma50, sma200)) * 0.35
        + clamp((rsi14 - 50.0) / 50.0, -1.0, 1.0) * 0.25
    )


def age_price(date: Column) -> Column:
    """Price estimate from the age in days since GENESIS, one day at least."""
    days = F.greatest(F.datediff(date, F.lit(GENESIS).cast("date")), F.lit(1))
    return F.pow(F.lit(10.0), F.log10(days.cast("double")) * 5.84 - 17.01)


def finite(x: Column) -> Column:
    """NULL for infinities and NaN, as JSON needs it."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def midnight(c: Column) -> Column:
    """Timestamp text of a date's midnight in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'00:00:00'Z'")


def symbol(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), r"\.US$", "")


def combined_hash(symbol_: Column, sha: Column) -> Column:
    """Aggregate: SHA-256 over the sorted lines `SYMBOL:sha`, each ended by a line feed."""
    lines = F.sort_array(F.collect_list(F.concat_ws(":", symbol_, sha)))
    return F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")).cast("binary"), 256)
