"""Normalisation of daily series: one template for all variants.

Every variant casts, filters, keeps the last row per (keys, date) in input order ``_ord``, and
cuts at an as-of date. They differ in the order of these steps and in what a bad value does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C

ORDER = "_ord"


def last_per_day(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = ORDER) -> DataFrame:
    """The last row of each (keys, date) by ``order``."""
    w = Window.partitionBy(*keys, "date").orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of_cut(df: DataFrame, as_of: str | None) -> DataFrame:
    """Rows up to and including ``as_of``. The key of the deduplication holds the date, so the cut
    commutes with it and can reach the scan."""
    return df if as_of is None else df.where(F.col("date") <= F.lit(as_of).cast("date"))


def _or_close(df: DataFrame, name: str) -> Column:
    return C.number(F.col(name)) if name in df.columns else C.number(F.col("close"))


def ohlcv(df: DataFrame, as_of: str | None = None, strict: bool = False, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Loader variant: (keys, date, close, high, low[, volume]). High and low default to close only
    where the column is absent; bad values in them stay NULL. ``strict`` raises on bad dates."""
    volume = [C.number(F.col("volume")).alias("volume")] if "volume" in df.columns else []
    date = C.strict_day(F.col("date")) if strict else C.day(F.col("date"))
    rows = df.select(*keys, date.alias("date"), C.number(F.col("close")).alias("close"), _or_close(df, "high").alias("high"), _or_close(df, "low").alias("low"), *volume, ORDER)
    rows = as_of_cut(rows.where(F.col("date").isNotNull() & (F.col("close") > 0)), as_of)
    return last_per_day(rows, keys).drop(ORDER)


def technical(df: DataFrame, as_of: str | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Indicator variant: a NULL or non-positive close, high or low drops the row."""
    rows = df.select(*keys, C.day(F.col("date")).alias("date"), C.number(F.col("close")).alias("close"), _or_close(df, "high").alias("high"), _or_close(df, "low").alias("low"), ORDER)
    rows = as_of_cut(rows.where("date is not null and close > 0 and high > 0 and low > 0"), as_of)
    return last_per_day(rows, keys).drop(ORDER)


def cycle(df: DataFrame, as_of: str | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Cycle variant: close and high; a NULL high stays."""
    rows = df.select(*keys, C.day(F.col("date")).alias("date"), C.number(F.col("close")).alias("close"), _or_close(df, "high").alias("high"), ORDER)
    return last_per_day(as_of_cut(rows.where("date is not null and close > 0"), as_of), keys).drop(ORDER)


def metric(df: DataFrame, value: str, as_of: str | None = None, date: str = "date", keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Source-metric variant: (keys, date, value), positive values, bad dates and values dropped."""
    rows = df.select(*keys, C.day(F.col(date)).alias("date"), C.number(F.col(value)).alias("value"), ORDER)
    return last_per_day(as_of_cut(rows.where("date is not null and value > 0"), as_of), keys).drop(ORDER)


CONTEXT_FIELDS = ("cape_percentile", "vix_percentile", "breadth_above_sma200_pct")


def context(
    df: DataFrame,
    as_of: str | None = None,
    passthrough: tuple[str, ...] = ("QQQ", "SPY"),
    keys: tuple[str, ...] = ("series",),
) -> DataFrame:
    """Context variant: keep last per day first, then the fields' range [0, 1]. So a day whose last
    row is out of range is lost. Missing provider timestamps stay NULL."""
    extra = [c for c in passthrough if c in df.columns]
    stamp = F.col("provider_timestamp").cast("string") if "provider_timestamp" in df.columns else C.midnight(C.day(F.col("date")))
    rows = df.select(
        *keys, C.day(F.col("date")).alias("date"), *(C.number(F.col(c)).alias(c) for c in (*extra, *CONTEXT_FIELDS)), stamp.alias("provider_timestamp"), ORDER
    )
    rows = last_per_day(as_of_cut(rows.dropna(subset=["date", *CONTEXT_FIELDS]), as_of), keys)
    for c in CONTEXT_FIELDS:
        rows = rows.where(F.col(c).between(0.0, 1.0))
    return rows.drop(ORDER)
