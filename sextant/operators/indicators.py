"""The indicator families: technical, cycle, rotation and valuation context.

Each function takes normalised rows of many series and returns rows of all of them; the
``latest`` of a frame is its last row per series. Minimum histories are filters here; the API
functions in ``artifacts`` raise instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions.kernels import Recursive, Series, with_atr, with_log_volatility, with_recursive, with_rsi, with_simple_volatility
from ..storage import stored
from .joins import as_of_join, same_day_join

SYMBOLS = Series(("symbol",))
METRICS = Series(("series",))

# The fields of each family, in output order.
TECHNICAL_FIELDS = (
    "close", "sma20", "sma50", "sma100", "sma200", "ema20", "ema50", "high252", "drawdown_252d", "sma200_gap",
    "rsi14", "atr14", "realized_volatility_20d", "realized_volatility_63d", "momentum_90d", "trend_score",
)
CYCLE_FIELDS = (
    "close", "sma200", "gma200", "high252", "drawdown_252d", "sma200_gap", "rsi14", "mayer_multiple", "ahr999", "ahr999_sma",
    "ahr999_estimate_price", "ahr999_365d_percentile", "ahr999_30d_slope", "mayer_multiple_365d_percentile",
    "realized_volatility_30d", "momentum_90d", "cycle_indicator_source",
)


def latest(frame: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_enough(rows: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows of the series that have ``n`` rows or more."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= n).drop("_n")


def technical_frame(rows: DataFrame, min_history: int = 252, series: Series = SYMBOLS) -> DataFrame:
    """(keys, date, TECHNICAL_FIELDS) wherever close, sma200 and high252 are known."""
    close = F.col("close")
    rows = with_enough(rows, min_history, series.keys)
    rows = rows.withColumns({f"sma{n}": series.mean(close, n) for n in (20, 50, 100, 200)} | {
        "high252": series.highest(F.col("high"), 252),
        "momentum_90d": series.momentum(close, 90),
    })
    rows = with_rsi(rows, series, "close", 14, "rsi14")
    rows = with_atr(rows, series, 14, "atr14")
    rows = with_log_volatility(rows, series, "close", {"realized_volatility_20d": 20, "realized_volatility_63d": 63}, 252)
    # After the windows: the fold then finds rows by symbol already, and nothing is shuffled again.
    rows = with_recursive(rows, series, [Recursive("ema20", "ema", "close", 20), Recursive("ema50", "ema", "close", 50)])
    rows = rows.where("sma200 is not null and high252 is not null").withColumns({
        "drawdown_252d": C.drawdown(close, F.col("high252")),
        "sma200_gap": C.ratio_gap(close, F.col("sma200")),
        "trend_score": C.trend_score(close, F.col("sma50"), F.col("sma200"), F.col("rsi14")),
    })
    return rows.select(*series.keys, "date", *TECHNICAL_FIELDS)


def cycle_base(rows: DataFrame, min_history: int = 200, series: Series = SYMBOLS) -> DataFrame:
    """First stage of the cycle family: one row per date with ``min_history`` rows so far."""
    close, high = F.col("close"), F.col("high")
    rows = rows.withColumns({
        "row": series.row(),
        "sma200": F.avg(close).over(series.last(200)),
        "gma200": series.geometric_mean(close, 200),
        "high252": F.max(high).over(series.last(252)),
        "momentum_90d": series.momentum(close, 90),
        "ahr999_estimate_price": C.age_price(F.col("date")),
    })
    rows = with_rsi(rows, series, "close", 14, "rsi14")
    before = series.lag(close)
    rows = rows.withColumn("_r", F.when((before > 0) & (close > 0), F.ln(close / before)))
    enough = F.count("_r").over(series.last(30)) >= 2
    volatility = F.when((F.col("row") > 30) & enough, F.stddev_pop("_r").over(series.last(30)) * F.sqrt(F.lit(365.0)))
    rows = rows.withColumn("realized_volatility_30d", volatility).where(F.col("row") >= min_history)
    to_age = close / F.col("ahr999_estimate_price")
    return rows.withColumns({
        "mayer_multiple": F.when(F.col("sma200") > 0, close / F.col("sma200")),
        "ahr999": F.when(F.col("gma200") > 0, close / F.col("gma200") * to_age),
        "ahr999_sma": F.when(F.col("sma200") > 0, close / F.col("sma200") * to_age),
        "drawdown_252d": C.drawdown_or_zero(close, F.col("high252")),
        "sma200_gap": C.gap_or_zero(close, F.col("sma200")),
        "cycle_indicator_source": F.lit("price_derived"),
    }).drop("_r", "row", "high")


def cycle_frame(rows: DataFrame, min_history: int = 200, series: Series = SYMBOLS) -> DataFrame:
    """(keys, date, CYCLE_FIELDS): percentiles and slope run over the emitted rows of the first stage."""
    base = cycle_base(rows, min_history, series).withColumn("ahr999_30d_slope", series.slope(F.col("ahr999"), 30))
    percentiles = [Recursive(f"{x}_365d_percentile", "trailing_percentile", x, 365) for x in ("ahr999", "mayer_multiple")]
    return with_recursive(base, series, percentiles).select(*series.keys, "date", *CYCLE_FIELDS)


def tail(rows: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last ``n`` days of each series; Spark cuts each partition to them before the exchange."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cycle_latest(rows: DataFrame, min_history: int = 200, series: Series = SYMBOLS) -> DataFrame:
    """Last row of ``cycle_frame``, from the days it depends on: the first stage looks back 252 days
    or the minimum history, the second over 365 rows of the first."""
    return latest(cycle_frame(tail(rows, max(min_history, 252) + 364, series.keys), min_history, series), series.keys)


@dataclass(frozen=True)
class RotationParams:
    trend_window: int = 140
    rsi_window: int = 252
    rsi_quantile: float = 0.9
    rsi_floor: float = 70.0
    volatility_window: int = 10
    volatility_quantile_window: int = 252
    volatility_quantile: float = 0.95
    volatility_min_periods: int = 126
    volatility_floor: float = 0.5
    volatility_cap: float = 0.75
    min_history: int | None = None

    def __post_init__(self) -> None:
        windows = (self.trend_window, self.rsi_window, self.volatility_window, self.volatility_quantile_window)
        if min(windows) <= 0:
            raise ValueError("windows must be positive")
        if not all(0 < q < 1 for q in (self.rsi_quantile, self.volatility_quantile)):
            raise ValueError("quantiles must lie in (0, 1)")

    @property
    def look_back(self) -> int:
        """Rows that every window needs together, 420 at least."""
        needed = (self.trend_window + 20, self.rsi_window + 28, self.volatility_quantile_window + self.volatility_window + 1)
        return max(420, *needed) if self.min_history is None else self.min_history


def rotation_frame(rows: DataFrame, params: RotationParams = RotationParams(), series: Series = SYMBOLS) -> DataFrame:
    """All rotation fields at every date of every symbol; the volatility columns carry their window."""
    p, close = params, F.col("close")
    vol = f"realized_volatility_{p.volatility_window}"
    rows = with_simple_volatility(rows.select(*series.keys, "date", "close"), series, "close", p.volatility_window, vol)
    rows = with_simple_volatility(rows, series, "close", 20, "_vol20")
    least = max(1, min(p.volatility_quantile_window, p.volatility_min_periods))
    rows = rows.withColumns({
        "ma_trend": series.mean(close, p.trend_window),
        "ma20": series.mean(close, 20),
        "std20": series.std_pop(close, 20),
        "_vol_n": F.count(vol).over(series.last(p.volatility_quantile_window)),
    })
    rows = rows.withColumn("ma20_slope", F.col("ma20") - series.lag(F.col("ma20")))
    # After the windows, as in the technical family.
    rows = with_recursive(rows, series, [
        Recursive("rsi14", "wilder_rsi", "close", 14),
        Recursive("_rsi_q", "rolling_quantile", "rsi14", p.rsi_window, p.rsi_quantile, lag=1),
        Recursive("_vol_q", "rolling_quantile", vol, p.volatility_quantile_window, p.volatility_quantile, least),
    ])
    threshold = C.clamp(F.col("_vol_q"), p.volatility_floor, p.volatility_cap)
    fixed = {"lookback": p.volatility_quantile_window, "percentile": p.volatility_quantile, "min_periods": least, "floor": p.volatility_floor, "cap": p.volatility_cap}

    def dynamic(name: str) -> list[Column]:
        first = [threshold.alias(f"{name}_dynamic_threshold"), F.col("_vol_n").cast("double").alias(f"{name}_dynamic_sample_count")]
        return first + [F.lit(float(v)).alias(f"{name}_dynamic_{k}") for k, v in fixed.items()]

    return rows.select(
        *series.keys,
        "date",
        close.alias("price"),
        "ma_trend",
        "ma20",
        "ma20_slope",
        "rsi14",
        F.greatest(F.lit(p.rsi_floor), F.coalesce("_rsi_q", F.lit(p.rsi_floor))).alias("rsi14_dynamic_threshold"),
        (F.col("ma20") + 2 * F.col("std20")).alias("bb_upper"),
        F.col("ma20").alias("bb_mid"),
        (F.col("ma20") - 2 * F.col("std20")).alias("bb_lower"),
        F.col("_vol20").alias("realized_volatility"),
        vol,
        *([] if p.volatility_window == 20 else [F.col("_vol20").alias("realized_volatility_20")]),
        *(c for name in (vol, "realized_volatility") for c in dynamic(name)),
    )


def rotation_latest(rows: DataFrame, params: RotationParams = RotationParams(), series: Series = SYMBOLS) -> DataFrame:
    """Last row of each symbol with enough history; symbols may end on different dates."""
    return latest(rotation_frame(with_enough(rows, params.look_back, series.keys), params, series), series.keys)


def expanding_percentile(rows: DataFrame, value: str = "value", series: Series = METRICS) -> DataFrame:
    """``rows`` with ``percentile``: share of the values so far that don't exceed the current one."""
    return with_recursive(rows, series, [Recursive("percentile", "expanding_percentile", value, 0)])


def public_context(vix: DataFrame, cape: DataFrame, stamp: Column | None = None, keys: tuple[str, ...] = ("series",), long: bool = False) -> DataFrame:
    """(keys, date, cape_percentile, vix_percentile, provider_timestamp) on the dates of ``vix``.

    Both are normalised metrics; percentiles are taken at each source's own frequency, then the
    last one of ``cape`` is carried to each date of ``vix``. ``long``: see ``Series``.
    """
    series = Series(keys, long=long)
    left = expanding_percentile(vix, series=series).select(*keys, "date", F.col("percentile").alias("vix_percentile"))
    right = expanding_percentile(cape, series=series).select(*keys, "date", F.col("percentile").alias("cape_percentile"))
    if long:  # ordering by range reads its rows twice
        left, right = stored(left, "percentiles"), stored(right, "percentiles")
    joined = as_of_join(left, right, keys, "vix_percentile", "cape_percentile", long=long).dropna(subset=["vix_percentile", "cape_percentile"])
    inside = F.col("vix_percentile").between(0.0, 1.0) & F.col("cape_percentile").between(0.0, 1.0)
    at = C.midnight(F.col("date")) if stamp is None else stamp
    return joined.where(inside).select(*keys, "date", "cape_percentile", "vix_percentile", at.alias("provider_timestamp"))


def price_proxy(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("QQQ", "SPY"), stamp: Column | None = None, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, date, both values, provider_timestamp) on the dates that both metrics have."""
    a = first.select(*keys, "date", F.col("value").alias(names[0]))
    b = second.select(*keys, "date", F.col("value").alias(names[1]))
    at = C.midnight(F.col("date")) if stamp is None else stamp
    return same_day_join(a, b, keys).select(*keys, "date", *names, at.alias("provider_timestamp"))
