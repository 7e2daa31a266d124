"""Rolling, expanding and recursive kernels over one series per ``keys``, by date.

Frames count rows, not calendar days. ``full`` gives pandas-like min_periods: a value only
where the frame holds enough non-null inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from .blocks import Step, earlier_smaller, with_expanding_percentile, with_steps


@dataclass(frozen=True)
class Series:
    """How rows form series: partition keys and the order within."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "date"
    long: bool = False  #: a series may exceed what a task holds: sequential kernels and as-of joins then work on blocks

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, n: int) -> WindowSpec:
        """The current and the n - 1 rows before."""
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def full(self, x: Column, n: int, value: Column, least: int | None = None) -> Column:
        return F.when(F.count(x).over(self.last(n)) >= (n if least is None else least), value)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.ordered)

    def row(self) -> Column:
        return F.row_number().over(self.ordered)

    def mean(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.avg(x).over(self.last(n)))

    def highest(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.max(x).over(self.last(n)))

    def std_pop(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.stddev_pop(x).over(self.last(n)))

    def std_samp(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.stddev_samp(x).over(self.last(n)))

    def geometric_mean(self, x: Column, n: int) -> Column:
        """Of up to n rows, positive values only."""
        return F.exp(F.avg(F.ln(F.when(x > 0, x))).over(self.last(n)))

    def momentum(self, x: Column, n: int) -> Column:
        before = self.lag(x, n)
        return F.when(before > 0, x / before - 1)

    def slope(self, x: Column, n: int) -> Column:
        return (x - self.lag(x, n)) / n

    def gap_days(self) -> Column:
        return F.datediff(F.col(self.order), self.lag(F.col(self.order)))


def with_rsi(df: DataFrame, series: Series, x: str, n: int, out: str) -> DataFrame:
    """RSI of simple means of the last n gains and losses, NULL before n differences."""
    step = F.col("_step")
    stepped = df.withColumn("_step", F.col(x) - series.lag(F.col(x)))
    gain = series.mean(F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), n)
    loss = series.mean(F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))), n)
    known = stepped.withColumns({"_gain": gain, "_loss": loss})
    g, l = F.col("_gain"), F.col("_loss")
    rsi = F.when(l > 0, 100.0 - 100.0 / (1.0 + g / l)).when(g > 0, 100.0).when(g.isNotNull(), 50.0)
    return known.withColumn(out, rsi).drop("_step", "_gain", "_loss")


def with_atr(df: DataFrame, series: Series, n: int, out: str) -> DataFrame:
    """Mean true range; the first row's range is high - low."""
    before = series.lag(F.col("close"))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("_range", true_range).withColumn(out, series.mean(F.col("_range"), n)).drop("_range")


def with_log_volatility(df: DataFrame, series: Series, x: str, windows: dict[str, int], year: int) -> DataFrame:
    """Population deviation of log returns times sqrt(year), one column for each window."""
    before = series.lag(F.col(x))
    returns = df.withColumn("_r", F.when((before > 0) & (F.col(x) > 0), F.ln(F.col(x) / before)))
    return returns.withColumns({name: series.std_pop(F.col("_r"), n) * float(np.sqrt(year)) for name, n in windows.items()}).drop("_r")


def with_simple_volatility(df: DataFrame, series: Series, x: str, n: int, out: str, year: int = 252) -> DataFrame:
    """Sample deviation of simple returns times sqrt(year), NULL for the first n rows."""
    returns = df.withColumn("_r", F.col(x) / series.lag(F.col(x)) - 1)
    return returns.withColumn(out, series.std_samp(F.col("_r"), n) * float(np.sqrt(year))).drop("_r")


# ---- sequential kernels: no window function expresses them, or only at a frame's cost for each row


def _object(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), None, x)


def _smoothed(x: np.ndarray, alpha: float) -> np.ndarray:
    """y = (1 - alpha) * y + alpha * x from the first value on."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _ema(x: np.ndarray, w: Recursive) -> np.ndarray:
    """Exponential mean with weight 2 / (n + 1), started at the first value; NULL before n values."""
    out = _smoothed(x, 2 / (w.n + 1)).copy() if len(x) else np.zeros(0)
    out[: w.n - 1] = np.nan
    return out


def _rsi(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss > 0, 100.0 - 100.0 / (1.0 + gain / loss), np.where(gain > 0, 100.0, 50.0))


def _moves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(x)
    return np.maximum(step, 0.0), np.maximum(-step, 0.0)


def _wilder_means(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Wilder's means of gains and losses from row n on, seeded by the first n steps."""
    return [_smoothed(np.concatenate([[part[:n].mean()], part[n:]]), 1 / n) for part in _moves(x)]


def _wilder(x: np.ndarray, w: Recursive) -> np.ndarray:
    """RSI of Wilder's means: seeded by the first n steps, before that the constant 50."""
    out = np.full(len(x), 50.0)
    if len(x) > w.n:
        out[w.n :] = _rsi(*_wilder_means(x, w.n))
    return out


def prefix_ranks(x: np.ndarray) -> np.ndarray:
    """For each value how many of those up to and with it don't exceed it."""
    order = np.argsort(x, kind="stable")
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    return earlier_smaller(place) + 1


def _expanding_percentile(x: np.ndarray, w: Recursive) -> np.ndarray:
    """Share of the values so far that don't exceed the current one; nulls have none and don't count."""
    out, known = np.full(len(x), np.nan), ~np.isnan(x)
    found = x[known]
    out[known] = prefix_ranks(found) / np.arange(1, len(found) + 1)
    return out


def _rolling_quantile(x: np.ndarray, w: Recursive) -> np.ndarray:
    """Linear interpolation at (count - 1) * q over the non-null values of the last n rows, kept in an indexed skip
    list; NULL under ``least`` of them."""
    return pd.Series(x).rolling(w.n, min_periods=w.n if w.least is None else w.least).quantile(w.q).to_numpy()


def _trailing_percentile(x: np.ndarray, w: Recursive) -> np.ndarray:
    """Share of the last n rows' values that don't exceed the current one, by the same list."""
    return pd.Series(x).rolling(w.n, min_periods=1).rank(method="max", pct=True).to_numpy()


@dataclass(frozen=True)
class Recursive:
    out: str
    kind: Literal["ema", "wilder_rsi", "expanding_percentile", "rolling_quantile", "trailing_percentile"]
    column: str
    n: int = 0
    q: float = 0.5
    least: int | None = None
    lag: int = 0  #: rows by which the result is moved on


_KERNELS = {
    "ema": _ema, "wilder_rsi": _wilder, "expanding_percentile": _expanding_percentile,
    "rolling_quantile": _rolling_quantile, "trailing_percentile": _trailing_percentile,
}


def _values(x: np.ndarray, w: Recursive) -> np.ndarray:
    found = _KERNELS[w.kind](x, w)
    return found if not w.lag else np.concatenate([np.full(min(w.lag, len(x)), np.nan), found[: -w.lag]])


def _step(w: Recursive) -> Step:
    """The kernel over blocks, see ``blocks``."""
    direct = lambda x: _values(x, w)
    if w.kind == "ema":
        alpha = 2 / (w.n + 1)
        return Step(
            w.column, w.out, w.n, direct,
            last=lambda x, own: ((1 - alpha) ** (len(x) - own), [float(_smoothed(np.concatenate([[0.0], x[own:]]), alpha)[-1])]),
            after=lambda x, own, state: _smoothed(np.concatenate([state, x[own:]]), alpha)[1:],
            state=lambda x: [float(_smoothed(x, alpha)[-1])], width=1,
        )
    if w.kind == "wilder_rsi":
        smoothed = lambda x, own, starts: [_smoothed(np.concatenate([[s], m[own - 1 :]]), 1 / w.n)[1:] for s, m in zip(starts, _moves(x), strict=True)]
        return Step(
            w.column, w.out, w.n + 1, direct,
            last=lambda x, own: ((1 - 1 / w.n) ** (len(x) - own), [float(m[-1]) for m in smoothed(x, own, (0.0, 0.0))]),
            after=lambda x, own, state: _rsi(*smoothed(x, own, state)),
            state=lambda x: [float(m[-1]) for m in _wilder_means(x, w.n)] if len(x) > w.n else [0.0, 0.0], width=2,
        )
    return Step(w.column, w.out, w.n - 1 + w.lag, direct)


def with_recursive(df: DataFrame, series: Series, wanted: list[Recursive]) -> DataFrame:
    """``df`` with sequential kernels over its columns, all in one pass; a kernel may read a column that one before it made.

    Where ``series.long`` isn't set, a series is one group: days of one symbol, thousands of rows however many symbols
    there are; windows on the same keys before and after share the one shuffle. Where it is, rows go to equal blocks whatever
    their series (``blocks``), and kernels read columns of ``df`` only.
    """
    if series.long:
        if any(w.lag and w.kind in ("ema", "wilder_rsi", "expanding_percentile") for w in wanted):
            raise ValueError("over blocks only frames can be moved on")
        steps = [_step(w) for w in wanted if w.kind != "expanding_percentile"]
        df = with_steps(df, series.keys, series.order, steps) if steps else df
        for w in wanted:
            if w.kind == "expanding_percentile":
                df = with_expanding_percentile(df, series.keys, series.order, w.column, w.out)
        return df
    schema = T.StructType([*df.schema.fields, *(T.StructField(w.out, T.DoubleType()) for w in wanted)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(series.order, kind="stable")
        for w in wanted:
            part[w.out] = _object(_values(part[w.column].to_numpy(float), w))
        return part

    return df.groupBy(*series.keys).applyInPandas(run, schema)
