"""The queries of the engine over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import Recursive, with_atr, with_log_volatility, with_recursive, with_rsi, with_simple_volatility
from ..operators import indicators as I
from ..operators import normalize as N
from ..operators import quality as Q
from ..operators.joins import as_of_join, same_day_join
from ..sources import fixtures as X
from . import contracts as K

Query = Callable[[SparkSession, str], DataFrame]
S, M = I.SYMBOLS, I.METRICS
TIE = 3.7e-8
#: Cut-offs of the report queries.
DIRTY_AS_OF, CONTEXT_AS_OF, STALE_AS_OF = "2024-01-20", "2029-01-01", "1999-06-30"


def _round(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that last bits of sums don't count. TIE moves means of round
    numbers, which often lie on a tie, off it."""
    return df.select(*(F.round(F.col(c) + TIE, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", C.iso_day(F.col("date")))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return N.technical(X.daily_bars(spark, d))


def _kernel(**wanted: Column) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _dated(_round(_bars(spark, d).select("symbol", "date", *(c.alias(n) for n, c in wanted.items()))))

    return run


def ohlcv_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = X.dirty_rows(spark, d).withColumnRenamed("series", "symbol")
    return _dated(N.ohlcv(rows, DIRTY_AS_OF))


def ema(spark: SparkSession, d: str) -> DataFrame:
    rows = with_recursive(_bars(spark, d).select("symbol", "date", "close"), S, [Recursive("ema20", "ema", "close", 20), Recursive("ema50", "ema", "close", 50)])
    return _dated(_round(rows.select("symbol", "date", "ema20", "ema50")))


def high_drawdown(spark: SparkSession, d: str) -> DataFrame:
    rows = _bars(spark, d).withColumn("high252", S.highest(F.col("high"), 252))
    return _dated(_round(rows.select("symbol", "date", "high252", C.drawdown(F.col("close"), F.col("high252")).alias("drawdown_252d"))))


def rsi_simple(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(with_rsi(_bars(spark, d), S, "close", 14, "rsi14").select("symbol", "date", "rsi14"), 4))


def rsi_wilder(spark: SparkSession, d: str) -> DataFrame:
    rows = with_recursive(_bars(spark, d).select("symbol", "date", "close"), S, [Recursive("rsi14", "wilder_rsi", "close", 14)])
    return _dated(_round(rows.select("symbol", "date", "rsi14"), 4))


def atr14(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(with_atr(_bars(spark, d), S, 14, "atr14").select("symbol", "date", "atr14")))


def realized_vol_log_pop(spark: SparkSession, d: str) -> DataFrame:
    rows = with_log_volatility(_bars(spark, d), S, "close", {"volatility_20d": 20, "volatility_63d": 63}, 252)
    return _dated(_round(rows.select("symbol", "date", "volatility_20d", "volatility_63d")))


def realized_vol_simple_samp(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(with_simple_volatility(_bars(spark, d), S, "close", 10, "volatility_10").select("symbol", "date", "volatility_10")))


def trend_score(spark: SparkSession, d: str) -> DataFrame:
    close = F.col("close")
    rows = with_rsi(_bars(spark, d).withColumns({"sma50": S.mean(close, 50), "sma200": S.mean(close, 200)}), S, "close", 14, "rsi14")
    return _dated(_round(rows.select("symbol", "date", C.trend_score(close, F.col("sma50"), F.col("sma200"), F.col("rsi14")).alias("trend_score")), 4))


def technical_frame(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(I.technical_frame(_bars(spark, d)), 5))


def technical_latest(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(I.latest(I.technical_frame(_bars(spark, d))), 4))


def _cycle(spark: SparkSession, d: str) -> DataFrame:
    return N.cycle(X.cycle_bars(spark, d))


def btc_base(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(I.cycle_base(_cycle(spark, d)), 3))


def btc_research_percentiles(spark: SparkSession, d: str) -> DataFrame:
    frame = I.cycle_frame(_cycle(spark, d))
    return _dated(_round(frame.select("symbol", "date", "ahr999_365d_percentile", "mayer_multiple_365d_percentile")))


def btc_slope30(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(I.cycle_frame(_cycle(spark, d)).select("symbol", "date", "ahr999_30d_slope")))


def btc_latest(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(I.cycle_latest(_cycle(spark, d)), 4))


def _rotation(spark: SparkSession, d: str) -> DataFrame:
    return I.rotation_frame(_bars(spark, d))


def _whole_counts(frame: DataFrame) -> DataFrame:
    """Sample counts as whole numbers, as the twins have them."""
    return frame.withColumns({c: F.col(c).cast("long") for c in frame.columns if c.endswith("_sample_count")})


def rotation_bands(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(_rotation(spark, d).select("symbol", "date", "ma_trend", "ma20", "ma20_slope", "bb_upper", "bb_mid", "bb_lower"), 5))


def rotation_dynamic_rsi(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(_rotation(spark, d).select("symbol", "date", "rsi14", "rsi14_dynamic_threshold"), 4))


def rotation_dynamic_vol(spark: SparkSession, d: str) -> DataFrame:
    v = "realized_volatility_10"
    return _dated(_round(_whole_counts(_rotation(spark, d).select("symbol", "date", v, f"{v}_dynamic_threshold", f"{v}_dynamic_sample_count"))))


def rotation_latest(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(_whole_counts(I.rotation_latest(_bars(spark, d))), 4))


def expanding_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = I.expanding_percentile(N.metric(X.daily_metric(spark, d), "value"))
    return _dated(_round(rows.select("series", "date", "percentile")))


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    left = N.metric(X.daily_metric(spark, d), "value").withColumnRenamed("value", "vix")
    right = N.metric(X.monthly_metric(spark, d), "value").withColumnRenamed("value", "cape")
    return _dated(as_of_join(left, right, ("series",), "vix", "cape"))


def asof_context(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_round(I.public_context(N.metric(X.daily_metric(spark, d), "value"), N.metric(X.monthly_metric(spark, d), "value"))))


def price_proxy_inner_join(spark: SparkSession, d: str) -> DataFrame:
    return _dated(I.price_proxy(N.metric(X.status_metric(spark, d, "F"), "value"), N.metric(X.status_metric(spark, d, "O"), "value")))


def context_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _dated(N.context(X.context_rows(spark, d), CONTEXT_AS_OF).drop("series"))


def _report(df: DataFrame) -> DataFrame:
    days = {c: C.iso_day(F.col(c)) for c in ("first_date", "last_date")}
    return df.withColumns(days | {c: F.array_join(c, ",") for c in ("failure_reasons", "warning_reasons")})


def ohlcv_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(Q.ohlcv_report(X.dirty_rows(spark, d), DIRTY_AS_OF, 20, 1))


def context_availability_report(spark: SparkSession, d: str) -> DataFrame:
    report = Q.context_report(X.context_rows(spark, d), CONTEXT_AS_OF)
    return _report(report.drop(*(c for c in report.columns if c.endswith("missing_column"))))


def source_staleness(spark: SparkSession, d: str) -> DataFrame:
    vix = N.metric(X.daily_metric(spark, d), "value").withColumn("series", F.lit("daily"))
    cape = N.metric(X.monthly_metric(spark, d), "value").withColumn("series", F.lit("monthly"))
    found = Q.staleness(vix.unionByName(cape), STALE_AS_OF, 120)
    return found.select("series", C.iso_day(F.col("last_date")).alias("last_date"), "lag_days", F.array_join("failure_reasons", ",").alias("failure_reasons"))


def gap_stats(spark: SparkSession, d: str) -> DataFrame:
    days = Q.gap_stats(N.last_per_day(X.sparse_days(spark, d), ("series",)), ("series",), 1)
    return days.withColumns({c: C.iso_day(F.col(c)) for c in ("first_date", "last_date")})


def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    days = Q.gap_stats(N.last_per_day(X.uneven_days(spark, d), ("series",)), ("series",), 1)
    return days.withColumns({c: C.iso_day(F.col(c)) for c in ("first_date", "last_date")})


# ---- contracts


def contract_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.coverage(K.requirements(spark), K.catalog(spark))


def missing_fields_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Required (symbol, field) of every consumer that parts of the table don't offer: the offer is
    the lower-cased field of requirement number p_partkey."""
    need = K.requirements(spark).withColumn("n", F.row_number().over(_requirement_order()))
    parts = X.read(spark, d, "part").select(F.col("p_partkey").cast("int").alias("n")).where("n % 2 = 1")
    offer = need.join(parts, "n").select("consumer", F.lower(F.col("symbol")).alias("symbol"), F.upper("field").alias("field"))
    return K.missing_fields(need, offer, ("consumer", "symbol"))


def missing_fields_by_size(spark: SparkSession, d: str) -> DataFrame:
    """As ``missing_fields_antijoin``, every part offering the requirement that its size picks."""
    need = K.requirements(spark).withColumn("n", F.row_number().over(_requirement_order()))
    parts = X.read(spark, d, "part").select((F.col("p_size") * F.col("p_size") % 53).alias("n"))
    offer = need.join(parts, "n").select("consumer", F.lower(F.col("symbol")).alias("symbol"), F.upper("field").alias("field"))
    return K.missing_fields(need, offer, ("consumer", "symbol"))


def _requirement_order():
    from pyspark.sql.window import Window

    # One task for the registry's few dozen rows.
    return Window.partitionBy(F.lit(0)).orderBy("consumer", "symbol", "ord")


def ownership_matrix(spark: SparkSession, d: str) -> DataFrame:
    return K.ownership(K.requirements(spark), K.catalog(spark))


def runtime_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.runtime_coverage(K.catalog(spark), K.requirements(spark))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Publication index entries from orders: bundles by customer."""
    o = X.read(spark, d, "orders")
    return o.select(
        F.concat(F.lit("bundle."), F.col("o_custkey").cast("string")).alias("bundle_id"),
        F.to_date("o_orderdate").alias("as_of"),
        F.when(F.col("o_orderstatus") == "P", "stale").otherwise("FRESH").alias("freshness_status"),
        F.array(F.col("o_orderpriority")).alias("compatible_profiles"),
        F.col("o_orderkey").alias("position"),
    )


def index_top1_as_of(spark: SparkSession, d: str) -> DataFrame:
    found = K.newest(_entries(spark, d), "1997-01-01", "1-URGENT", keys=("bundle_id",))
    return found.select("bundle_id", C.iso_day(F.col("as_of")).alias("as_of"), "position")


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).select("bundle_id", "as_of", "freshness_status", "position")
    old, new = rows.where("position % 3 <> 0"), rows.where("position % 3 = 0")
    merged = K.upsert(N.last_per_day(old.withColumnRenamed("as_of", "date"), ("bundle_id",), "position").withColumnRenamed("date", "as_of"), new, ("bundle_id", "as_of"))
    return merged.select("bundle_id", C.iso_day(F.col("as_of")).alias("as_of"), "freshness_status", "position")


def set_difference_known(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order: known minus present."""
    known = X.read(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return known.join(X.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")), "custkey", "left_anti").distinct()


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Days with both an order and a shipment."""
    a = X.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return _dated(a.intersect(X.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))))


def same_day_inner_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = (N.metric(X.status_metric(spark, d, s), "value").withColumnRenamed("value", s.lower()) for s in ("F", "O"))
    return _dated(same_day_join(a, b, ("series",)))


QUERIES: dict[str, Query] = {
    "ohlcv_normalize": ohlcv_normalize,
    "sma": lambda spark, d: _kernel(**{f"sma{n}": S.mean(F.col("close"), n) for n in (20, 50, 100, 200)})(spark, d),
    "ema": ema,
    "high_drawdown": high_drawdown,
    "rsi_simple": rsi_simple,
    "rsi_wilder": rsi_wilder,
    "atr14": atr14,
    "realized_vol_log_pop": realized_vol_log_pop,
    "realized_vol_simple_samp": realized_vol_simple_samp,
    "momentum_90": lambda spark, d: _kernel(momentum_90d=S.momentum(F.col("close"), 90))(spark, d),
    "trend_score": trend_score,
    "technical_frame": technical_frame,
    "technical_latest": technical_latest,
    "btc_base": btc_base,
    "btc_research_percentiles": btc_research_percentiles,
    "btc_slope30": btc_slope30,
    "btc_latest": btc_latest,
    "rotation_bands": rotation_bands,
    "rotation_dynamic_rsi": rotation_dynamic_rsi,
    "rotation_dynamic_vol": rotation_dynamic_vol,
    "rotation_latest": rotation_latest,
    "expanding_percentile": expanding_percentile,
    "asof_join": asof_join,
    "asof_context": asof_context,
    "price_proxy_inner_join": price_proxy_inner_join,
    "same_day_inner_join": same_day_inner_join,
    "context_normalize": context_normalize,
    "ohlcv_quality_report": ohlcv_quality_report,
    "context_availability_report": context_availability_report,
    "source_staleness": source_staleness,
    "gap_stats": gap_stats,
    "event_gaps": event_gaps,
    "contract_coverage": contract_coverage,
    "missing_fields_antijoin": missing_fields_antijoin,
    "missing_fields_by_size": missing_fields_by_size,
    "ownership_matrix": ownership_matrix,
    "runtime_coverage": runtime_coverage,
    "index_top1_as_of": index_top1_as_of,
    "index_upsert": index_upsert,
    "set_difference_known": set_difference_known,
    "set_intersection": set_intersection,
}
