"""Quality and availability reports as aggregations over raw text rows.

Reports come as one row per series; counters are longs and reasons are arrays in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from .normalize import CONTEXT_FIELDS, ORDER, last_per_day

# Reasons in report order.
OHLCV_WARNINGS = (
    ("invalid_date_count", "invalid_dates_dropped"),
    ("null_close_count", "null_closes_dropped"),
    ("non_positive_close_count", "non_positive_closes_dropped"),
    ("duplicate_date_count", "duplicate_dates_collapsed"),
    ("filtered_after_as_of_count", "rows_after_as_of_filtered"),
    ("gap_count_above_threshold", "date_gaps_above_threshold"),
)
CONTEXT_WARNINGS = (
    ("invalid_date_count", "invalid_dates_dropped"),
    ("null_indicator_count", "null_indicators_dropped"),
    ("out_of_range_count", "out_of_range_indicators_dropped"),
    ("duplicate_date_count", "duplicate_dates_collapsed"),
    ("filtered_after_as_of_count", "rows_after_as_of_filtered"),
    ("gap_count_above_threshold", "date_gaps_above_threshold"),
)
#: (counter, reason, fails without strict mode too)
POINT_IN_TIME = (
    ("provider_timestamp_missing_column", "missing_provider_timestamp_column", False),
    ("provider_timestamp_missing_count", "provider_timestamps_missing_or_invalid", False),
    ("provider_timestamp_after_as_of_count", "provider_timestamp_after_as_of", True),
    ("breadth_universe_snapshot_missing_column", "missing_breadth_universe_snapshot_column", False),
    ("breadth_universe_snapshot_missing_count", "breadth_universe_snapshot_missing", False),
    ("breadth_universe_as_of_missing_column", "missing_breadth_universe_as_of_column", False),
    ("breadth_universe_as_of_invalid_count", "breadth_universe_as_of_invalid", False),
    ("breadth_universe_as_of_after_observation_count", "breadth_universe_as_of_after_observation", True),
)


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in pairs))).cast("array<string>")


def status(failures: Column, warnings: Column) -> Column:
    return F.when(F.size(failures) > 0, "fail").when(F.size(warnings) > 0, "warn").otherwise("pass")


def gap_stats(days: DataFrame, keys: tuple[str, ...], threshold: int) -> DataFrame:
    """(keys, first_date, last_date, normalized_row_count, max_gap_days, gap_count_above_threshold) of
    deduplicated days; the largest gap is 0 below two rows."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date")))
    return days.withColumn("_gap", gap).groupBy(*keys).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("normalized_row_count"),
        F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("max_gap_days"),
        _count(F.col("_gap") > threshold).alias("gap_count_above_threshold"),
    )


def ohlcv_report(raw: DataFrame, as_of: str | None = None, min_history: int = 200, max_gap: int = 1, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Quality report of raw (keys, date, close, _ord) text rows."""
    rows = raw.select(*keys, C.day(F.col("date")).alias("date"), C.number(F.col("close")).alias("close"), ORDER)
    after = F.lit(False) if as_of is None else F.col("date") > F.lit(as_of).cast("date")
    usable = F.col("date").isNotNull() & (F.col("close") > 0) & ~after
    counters = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        _count(F.col("date").isNull()).alias("invalid_date_count"),
        _count(F.col("close").isNull()).alias("null_close_count"),
        _count(F.col("close") <= 0).alias("non_positive_close_count"),
        _count(F.col("date").isNotNull() & (F.col("close") > 0) & after).alias("filtered_after_as_of_count"),
        _count(usable).alias("_usable"),
    )
    days = gap_stats(last_per_day(rows.where(usable), keys), keys, max_gap)
    both = counters.join(days, list(keys), "left").fillna(0, ["normalized_row_count", "max_gap_days", "gap_count_above_threshold"])
    n = F.col("normalized_row_count")
    both = both.withColumns({"duplicate_date_count": F.col("_usable") - n, "dropped_row_count": F.col("raw_row_count") - n}).drop("_usable")
    both = both.withColumns({
        "failure_reasons": reasons([(n <= 0, "no_usable_rows"), (n < min_history, "insufficient_history_rows")]),
        "warning_reasons": reasons([(F.col(c) > 0, text) for c, text in OHLCV_WARNINGS]),
    })
    return both.withColumn("quality_status", status(F.col("failure_reasons"), F.col("warning_reasons")))


def context_report(
    raw: DataFrame, as_of: str | None = None, strict: bool = False, min_history: int = 1, max_gap: int = 7, keys: tuple[str, ...] = ("series",)
) -> DataFrame:
    """Availability report of raw context rows, with the point-in-time audit over all of them.

    A field's out-of-range counter also counts its missing values, and the range filter comes before
    deduplication here: both as in the frame's counterpart report.
    """
    text = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        *keys,
        C.day(F.col("date")).alias("date"),
        *(C.number(F.col(c)).alias(c) for c in CONTEXT_FIELDS),
        C.utc_day(text("provider_timestamp")).alias("_provided"),
        text("breadth_universe_snapshot_id").alias("_snapshot"),
        C.utc_day(text("breadth_universe_as_of")).alias("_universe"),
        ORDER,
    )
    has = {c: c in raw.columns for c in ("provider_timestamp", "breadth_universe_snapshot_id", "breadth_universe_as_of")}
    end = F.lit(as_of).cast("date")
    after = F.lit(False) if as_of is None else F.col("date") > end
    known = F.col("date").isNotNull()
    for c in CONTEXT_FIELDS:
        known = known & F.col(c).isNotNull()
    inside = F.lit(True)
    for c in CONTEXT_FIELDS:
        inside = inside & F.col(c).between(0.0, 1.0)
    usable = F.coalesce(known & inside & ~after, F.lit(False))
    held = lambda name, condition: (_count(condition) if has[name] else F.lit(0).cast("long"))
    counters = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        _count(F.col("date").isNull()).alias("invalid_date_count"),
        *(_count(F.col(c).isNull()).alias(f"null_{c}") for c in CONTEXT_FIELDS),
        *(_count(F.col(c).isNull() | ~F.col(c).between(0.0, 1.0)).alias(f"out_of_range_{c}") for c in CONTEXT_FIELDS),
        _count(known & after).alias("filtered_after_as_of_count"),
        _count(usable).alias("_usable"),
        held("provider_timestamp", F.col("_provided").isNull()).alias("provider_timestamp_missing_count"),
        (held("provider_timestamp", F.col("_provided") > end) if as_of else F.lit(0).cast("long")).alias("provider_timestamp_after_as_of_count"),
        held("breadth_universe_snapshot_id", F.trim(F.coalesce("_snapshot", F.lit(""))) == "").alias("breadth_universe_snapshot_missing_count"),
        held("breadth_universe_as_of", F.col("_universe").isNull()).alias("breadth_universe_as_of_invalid_count"),
        held("breadth_universe_as_of", F.col("_universe") > F.col("date")).alias("breadth_universe_as_of_after_observation_count"),
    )
    days = gap_stats(last_per_day(rows.where(usable), keys), keys, max_gap)
    both = counters.join(days, list(keys), "left").fillna(0, ["normalized_row_count", "max_gap_days", "gap_count_above_threshold"])
    n = F.col("normalized_row_count")
    both = both.withColumns({
        "duplicate_date_count": F.col("_usable") - n,
        "null_indicator_count": sum((F.col(f"null_{c}") for c in CONTEXT_FIELDS), F.lit(0)),
        "out_of_range_count": sum((F.col(f"out_of_range_{c}") for c in CONTEXT_FIELDS), F.lit(0)),
        "provider_timestamp_missing_column": F.lit(int(not has["provider_timestamp"])),
        "breadth_universe_snapshot_missing_column": F.lit(int(not has["breadth_universe_snapshot_id"])),
        "breadth_universe_as_of_missing_column": F.lit(int(not has["breadth_universe_as_of"])),
    }).drop("_usable")
    failures = reasons([(n <= 0, "no_usable_rows"), (n < min_history, "insufficient_history_rows")] + [(F.col(c) > 0, text_) for c, text_, always in POINT_IN_TIME if always or strict])
    warned = reasons([(F.col(c) > 0, text_) for c, text_ in CONTEXT_WARNINGS] + [(F.col(c) > 0, text_) for c, text_, _ in POINT_IN_TIME])
    both = both.withColumn("failure_reasons", failures).withColumn("warning_reasons", F.array_except(warned, "failure_reasons"))
    return both.withColumn("quality_status", status(F.col("failure_reasons"), F.col("warning_reasons")))


def staleness(days: DataFrame, as_of: str, max_lag: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, last_date, lag_days, failure_reasons): days from the last observation to ``as_of``, not under 0."""
    lag = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.max("date")))
    found = days.groupBy(*keys).agg(F.max("date").alias("last_date"), lag.cast("long").alias("lag_days"))
    stale = F.when(F.col("lag_days") > max_lag, F.array(F.concat_ws(":", *keys, F.lit("latest_observation_stale")))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("failure_reasons", stale)


def source_audit(raw: DataFrame, as_of: str | None, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, counters, first_date, last_date) of raw rows (date, value) of public series: what is invalid, null, not
    positive, after ``as_of`` or repeated, and the span of what stays. One aggregation."""
    rows = raw.select(*keys, C.day(F.col("date")).alias("date"), C.number(F.col("value")).alias("value"))
    usable = F.coalesce(F.col("date").isNotNull() & (F.col("value") > 0), F.lit(False))
    after = F.lit(False) if as_of is None else F.coalesce(F.col("date") > F.lit(as_of).cast("date"), F.lit(False))
    kept = usable & ~after
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        F.countDistinct(F.when(kept, F.col("date"))).alias("normalized_row_count"),
        _count(usable & after).alias("filtered_after_as_of_count"),
        _count(F.col("date").isNull()).alias("invalid_date_count"),
        _count(F.col("value").isNull()).alias("null_value_count"),
        _count(F.col("value") <= 0).alias("non_positive_value_count"),
        _count(kept).alias("_kept"),
        F.min(F.when(kept, F.col("date"))).alias("first_date"),
        F.max(F.when(kept, F.col("date"))).alias("last_date"),
    )
    return found.withColumn("duplicate_date_count", F.col("_kept") - F.col("normalized_row_count")).drop("_kept")
