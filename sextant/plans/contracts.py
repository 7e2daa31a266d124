"""Consumers, source families and their relations.

The registry and the catalog are small constants; the relational operators over them (coverage,
ownership, missing fields) are DataFrames, so that larger registries run the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: what each consumer requires, by symbol

_EQUITY = ("close", "sma50", "sma200", "high252", "drawdown_252d", "sma200_gap", "rsi14")
CONSUMERS: dict[str, dict[str, tuple[str, ...]]] = {
    "us_equity:ibit_smart_dca": {"BTC-USD": ("close", "sma200", "sma200_gap", "rsi14", "ahr999", "ahr999_sma", "mayer_multiple")},
    "us_equity:nasdaq_sp500_smart_dca": {"QQQ": _EQUITY, "SPY": _EQUITY},
    "us_equity:soxl_soxx_trend_income": {
        "SOXL": ("price", "ma_trend"),
        "SOXX": (
            "price", "ma_trend", "ma20", "ma20_slope", "rsi14", "rsi14_dynamic_threshold", "bb_upper", "realized_volatility_10",
            "realized_volatility_10_dynamic_threshold", "realized_volatility_10_dynamic_sample_count",
        ),
    },
    "research:nasdaq_sp500_external_context_precomputed": {"US-EQUITY-CONTEXT": ("breadth_above_sma200_pct", "cape_percentile", "vix_percentile")},
    "research:nasdaq_sp500_cape_vix_external_context_precomputed": {"US-EQUITY-CONTEXT": ("cape_percentile", "vix_percentile")},
    "research:nasdaq_sp500_price_proxy": {"US-EQUITY-PRICE-PROXY": ("QQQ", "SPY")},
    "research:ibit_btc_ahr999_precomputed": {"BTC-USD": ("ahr999",)},
    "research:ibit_btc_ahr999_helper_precomputed_variants": {"BTC-USD": ("ahr999", "ahr999_365d_percentile", "ahr999_30d_slope")},
    "research:ibit_btc_ahr999_mayer_precomputed": {"BTC-USD": ("ahr999", "mayer_multiple")},
    "research:ibit_btc_ahr999_mayer_precomputed_variants": {"BTC-USD": ("ahr999", "ahr999_sma", "mayer_multiple")},
}

# ---- fixed values: what each source family produces


def _family(
    family: str, prefix: str, transform: str, dataset: str, policy: str, rows: int, symbols: tuple[str, ...], fields: tuple[str, ...],
    runtime: tuple[str, ...], research: tuple[str, ...], profiles: tuple[dict, ...], bundle_type: str = "derived_indicators",
) -> dict:
    return {
        "family": family,
        "domain": family.split(".")[0],
        "bundle_type": bundle_type,
        "bundle_id_prefix": prefix,
        "canonical_input": "derived_indicators",
        "transform": transform,
        "provider_dataset": dataset,
        "freshness_policy": policy,
        "minimum_history_rows": rows,
        "symbols": list(symbols),
        "derived_indicator_fields": list(fields),
        "source_profiles": [dict(p) for p in profiles],
        "compatible_profiles": [*runtime, *research],
        "runtime_consumers": list(runtime),
        "research_consumers": list(research),
    }


def _profile(
    source_id: str, name: str, dataset: str, fields: tuple[str, ...], frequency: str, status: str, lag_policy: str, use: str, url: str = "", max_lag: int | None = None
) -> dict:
    limit = {} if max_lag is None else {"max_allowed_lag_days": max_lag}
    return {
        "source_id": source_id,
        "source_name": name,
        "provider_dataset": dataset,
        "produced_fields": list(fields),
        "history_frequency": frequency,
        "point_in_time_status": status,
        "publication_lag_policy": lag_policy,
        "research_use_policy": use,
        "source_url": url,
    } | limit


_CYCLE = (
    "ahr999", "ahr999_30d_slope", "ahr999_365d_percentile", "ahr999_estimate_price", "ahr999_sma", "close", "cycle_indicator_source",
    "drawdown_252d", "gma200", "high252", "mayer_multiple", "mayer_multiple_365d_percentile", "momentum_90d", "provider_timestamp",
    "realized_volatility_30d", "rsi14", "sma200", "sma200_gap",
)
_TECHNICAL = (
    "atr14", "close", "drawdown_252d", "ema20", "ema50", "high252", "momentum_90d", "provider_timestamp", "realized_volatility_20d",
    "realized_volatility_63d", "rsi14", "sma20", "sma50", "sma100", "sma200", "sma200_gap", "trend_score",
)
_DYNAMIC = ("cap", "floor", "lookback", "min_periods", "percentile", "sample_count", "threshold")
_ROTATION = (
    "bb_lower", "bb_mid", "bb_upper", "ma20", "ma20_slope", "ma_trend", "price", "provider_timestamp", "realized_volatility", "realized_volatility_10",
    *(f"realized_volatility_10_dynamic_{x}" for x in _DYNAMIC), "realized_volatility_20", *(f"realized_volatility_dynamic_{x}" for x in _DYNAMIC),
    "rsi14", "rsi14_dynamic_threshold",
)
_CONTEXT = ("breadth_above_sma200_pct", "cape_percentile", "provider_timestamp", "vix_percentile")
_T1 = "use at least T+1 before same-day DCA decisions"
_HISTORY = "public_history_with_execution_lag"
_VIX = _profile(
    "fred.vixcls", "Federal Reserve Economic Data VIXCLS", "VIXCLS", ("vix_percentile",), "daily", _HISTORY, _T1,
    "accepted for research when the downloaded CSV, as_of, and percentile lookback are hash-pinned", "https://fred.stlouisfed.org/series/VIXCLS", 10,
)
_CAPE = _profile(
    "shiller.cape_monthly", "Robert Shiller online data CAPE", "ie_data.xls", ("cape_percentile",), "monthly", "public_revised_history_snapshot_required",
    "month-end or later; never same-day daily timing",
    "accepted for low-frequency valuation research only when the raw download snapshot and revision date are preserved", "https://www.econ.yale.edu/~shiller/data.htm", 120,
)
_BREADTH = _profile(
    "index_breadth.point_in_time_vendor", "Point-in-time index breadth history", "spx_ndx_members_above_sma200_daily", ("breadth_above_sma200_pct",), "daily",
    "requires_point_in_time_vendor_or_breadth_index", "vendor timestamp must be no later than DCA evaluation lag",
    "reject current-constituent backfills; use only point-in-time constituents or an auditable historical breadth index",
)
_NASDAQ = _profile(
    "fred.nasdaq100", "Federal Reserve Economic Data NASDAQ100", "NASDAQ100", ("QQQ",), "daily", _HISTORY, _T1,
    "accepted as a Nasdaq price proxy only when the downloaded CSV, as_of, and transform version are hash-pinned", "https://fred.stlouisfed.org/series/NASDAQ100", 10,
)
_SP500 = _profile(
    "fred.sp500", "Federal Reserve Economic Data SP500", "SP500", ("SPY",), "daily", _HISTORY, _T1,
    "accepted as an S&P 500 price proxy only when the downloaded CSV, as_of, and transform version are hash-pinned", "https://fred.stlouisfed.org/series/SP500", 10,
)


def _cache(dataset: str, name: str, fields: tuple[str, ...], policy: str, use: str) -> tuple[dict, ...]:
    return (_profile(f"local_csv.{dataset}", name, dataset, fields, "daily", "cache_snapshot_required", policy, use),)


_US_POLICY, _CRYPTO_POLICY = "us_equity_daily_close_t_plus_1", "crypto_daily_close_t_plus_1"
FAMILIES: dict[str, dict] = {
    f["family"]: f
    for f in (
        _family(
            "crypto.btc_cycle_daily", "crypto.btc.derived_indicators", "crypto.btc.ahr999.v1", "btc_usd_daily_ohlcv", _CRYPTO_POLICY, 200, ("BTC-USD",), _CYCLE,
            ("us_equity:ibit_smart_dca",),
            (
                "research:ibit_btc_ahr999_precomputed", "research:ibit_btc_ahr999_helper_precomputed_variants",
                "research:ibit_btc_ahr999_mayer_precomputed", "research:ibit_btc_ahr999_mayer_precomputed_variants",
            ),
            _cache(
                "btc_usd_daily_ohlcv", "Local BTC daily OHLCV cache", _CYCLE, _CRYPTO_POLICY,
                "accepted when raw OHLCV cache hash, provider timestamp, and transform version are pinned",
            ),
        ),
        _family(
            "us_equity.technical_daily", "us_equity.technical.daily", "technical.daily_ohlcv.v1", "us_equity_daily_ohlcv", _US_POLICY, 252, ("QQQ", "SPY"), _TECHNICAL,
            ("us_equity:nasdaq_sp500_smart_dca",), (), _cache(
                "us_equity_daily_ohlcv", "Local US equity daily OHLCV cache", _TECHNICAL, _US_POLICY,
                "accepted when raw OHLCV cache hash, provider timestamp, and technical transform version are pinned",
            ),
        ),
        _family(
            "us_equity.semiconductor_rotation_daily", "us_equity.semiconductor_rotation.daily", "us_equity.semiconductor_rotation.v1",
            "us_equity_semiconductor_daily_ohlcv", _US_POLICY, 420, ("SOXL", "SOXX"), _ROTATION,
            ("us_equity:soxl_soxx_trend_income",), (), _cache(
                "us_equity_semiconductor_daily_ohlcv", "Local SOXL/SOXX daily OHLCV cache", _ROTATION, _US_POLICY,
                "accepted when both SOXL and SOXX raw OHLCV cache hashes, provider timestamp, and semiconductor rotation transform version are pinned",
            ),
        ),
        _family(
            "us_equity.nasdaq_sp500_context_daily", "us_equity.nasdaq_sp500.context", "us_equity.nasdaq_sp500.context.v1", "nasdaq_sp500_external_context_daily",
            "us_equity_research_context_t_plus_1", 1, ("US-EQUITY-CONTEXT",), _CONTEXT, (), ("research:nasdaq_sp500_external_context_precomputed",), (_VIX, _CAPE, _BREADTH),
        ),
        _family(
            "us_equity.nasdaq_sp500_public_context_daily", "us_equity.nasdaq_sp500.public_context", "us_equity.nasdaq_sp500.context.v1", "nasdaq_sp500_public_context_daily",
            "us_equity_research_context_t_plus_1", 1, ("US-EQUITY-CONTEXT",), _CONTEXT[1:], (), ("research:nasdaq_sp500_cape_vix_external_context_precomputed",), (_VIX, _CAPE),
        ),
        _family(
            "us_equity.nasdaq_sp500_price_proxy_daily", "us_equity.nasdaq_sp500.price_proxy", "us_equity.nasdaq_sp500.price_proxy.v1", "fred_nasdaq100_sp500_daily",
            "us_equity_price_proxy_t_plus_1", 1, ("US-EQUITY-PRICE-PROXY",), ("QQQ", "SPY", "provider_timestamp"), (), ("research:nasdaq_sp500_price_proxy",),
            (_NASDAQ, _SP500),
            "research_export",
        ),
    )
}

DOMAINS: dict[str, dict[str, list[str]]] = {
    "crypto": {
        "implemented_families": ["crypto.btc_cycle_daily"],
        "planned_families": ["crypto.live_pool_feature_catalog", "crypto.market_structure_daily"],
        "canonical_inputs": ["derived_indicators", "market_prices", "benchmark_snapshot", "universe_snapshot"],
    },
    "us_equity": {
        "implemented_families": sorted(f for f in FAMILIES if f.startswith("us_equity.")),
        "planned_families": ["us_equity.index_breadth_daily", "us_equity.valuation_macro_context", "us_equity.volatility_rates_context"],
        "canonical_inputs": ["derived_indicators", "research_export"],
    },
    "hk_equity": {
        "implemented_families": [],
        "planned_families": ["hk_equity.index_breadth_daily", "hk_equity.fx_liquidity_context"],
        "canonical_inputs": ["derived_indicators", "research_export"],
    },
}


# ---- lookups


class ContractError(ValueError):
    """A consumer, family or contract that isn't known or doesn't fit."""


def known_consumers(runtime_only: bool = False) -> list[str]:
    return sorted(c for c in CONSUMERS if not (runtime_only and c.startswith("research:")))


def required_fields(consumer: str) -> dict[str, tuple[str, ...]]:
    if consumer not in CONSUMERS:
        raise ContractError(f"unknown consumer {consumer!r}; known: {', '.join(known_consumers())}")
    return CONSUMERS[consumer]


def family_record(family: str) -> dict:
    if family not in FAMILIES:
        raise ContractError(f"unknown source family {family!r}; known: {', '.join(sorted(FAMILIES))}")
    return FAMILIES[family]


def families_of_domain(domain: str) -> list[str]:
    if domain not in DOMAINS:
        raise ContractError(f"unknown domain {domain!r}; known: {', '.join(sorted(DOMAINS))}")
    return list(DOMAINS[domain]["implemented_families"])


# ---- relations


def requirements(spark: SparkSession) -> DataFrame:
    """(consumer, symbol, field, ord)."""
    rows = [(c, s, f, i) for c, by in CONSUMERS.items() for s, fields in by.items() for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "consumer string, symbol string, field string, ord int")


def catalog(spark: SparkSession) -> DataFrame:
    """(family, domain, transform, freshness_policy, symbols, fields, consumers, runtime, research)."""
    rows = [
        (f["family"], f["domain"], f["transform"], f["freshness_policy"], f["symbols"], f["derived_indicator_fields"], f["compatible_profiles"], f["runtime_consumers"], f["research_consumers"])
        for f in FAMILIES.values()
    ]
    lists = ", ".join(f"{c} array<string>" for c in ("symbols", "fields", "consumers", "runtime", "research"))
    return spark.createDataFrame(rows, f"family string, domain string, transform string, freshness_policy string, {lists}")


def coverage(required: DataFrame, families: DataFrame) -> DataFrame:
    """(consumer, family, symbol, field) that a family compatible with the consumer produces."""
    offered = families.select("family", F.explode("consumers").alias("consumer"), "symbols", "fields")
    offered = offered.select("family", "consumer", F.explode("symbols").alias("symbol"), "fields")
    offered = offered.select("family", "consumer", "symbol", F.explode("fields").alias("field"))
    return required.join(offered, ["consumer", "symbol", "field"]).select("consumer", "family", "symbol", "field")


def missing_fields(required: DataFrame, available: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Required rows that no available row meets: symbols normalised, fields in any case."""
    norm = lambda df: df.withColumns({
        "_s": F.regexp_replace(F.upper(F.trim("symbol")), r"\.US$", ""),
        "_f": F.lower("field"),
    })
    others = [k for k in keys if k != "symbol"]
    met = norm(available).select(*others, "_s", "_f").distinct()
    return norm(required).join(met, [*others, "_s", "_f"], "left_anti").select(*others, "symbol", "field")


def ownership(required: DataFrame, families: DataFrame) -> DataFrame:
    """One row per consumer: whether it is a research consumer, fields required and covered, families."""
    need = required.groupBy("consumer").agg(F.count(F.lit(1)).alias("required_count"))
    own = coverage(required, families).groupBy("consumer").agg(
        F.countDistinct("symbol", "field").alias("covered_count"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families")
    )
    return need.join(own, "consumer", "left").select(
        "consumer",
        F.when(F.col("consumer").startswith("research:"), "research").otherwise("runtime").alias("kind"),
        "required_count",
        F.coalesce("covered_count", F.lit(0)).alias("covered_count"),
        F.coalesce("families", F.lit("")).alias("families"),
        (F.coalesce("covered_count", F.lit(0)) == F.col("required_count")).alias("complete"),
    )


def runtime_coverage(families: DataFrame, consumers: DataFrame) -> DataFrame:
    """Runtime consumers with the families that list them; consumers without any are kept."""
    listed = families.select("family", F.explode("runtime").alias("consumer"))
    runtime = consumers.where(~F.col("consumer").startswith("research:")).select("consumer").distinct()
    joined = runtime.join(listed, "consumer", "left").groupBy("consumer")
    return joined.agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.count("family").alias("family_count"))


def matching_families(families: DataFrame, transform: str, policy: str, consumer: str, symbols: list[str], fields: list[str]) -> DataFrame:
    """Families that fit a bundle: same transform and policy, the consumer among the runtime
    ones, all symbols and all fields theirs."""
    every = lambda have, want: F.size(F.array_except(F.array(*map(F.lit, want)).cast("array<string>"), have)) == 0
    fits = (F.col("transform") == transform) & (F.col("freshness_policy") == policy) & F.array_contains("runtime", consumer)
    return families.where(fits & every(F.col("symbols"), symbols) & every(F.col("fields"), fields)).select("family")


# ---- index entries


def newest(entries: DataFrame, as_of: str | None, profile: str | None, statuses: tuple[str, ...] = ("fresh",), keys: tuple[str, ...] = ()) -> DataFrame:
    """The entry of greatest as_of (first position on ties) that is fresh enough, not after ``as_of``
    and compatible with ``profile``; per ``keys`` if given. One partial aggregation, no window over all entries."""
    ok = F.lower("freshness_status").isin(*statuses)
    ok = ok if as_of is None else ok & (F.col("as_of") <= F.lit(as_of).cast(entries.schema["as_of"].dataType))
    ok = ok if profile is None else ok & F.array_contains("compatible_profiles", profile)
    first = F.max_by(F.struct(*entries.columns), F.struct(F.col("as_of"), -F.col("position")))
    found = entries.where(ok).groupBy(*keys).agg(first.alias("_entry")).where("_entry is not null")
    return found.select("_entry.*")


def upsert(old: DataFrame, new: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``identity``; the last of ``new`` by position wins."""
    from pyspark.sql.window import Window

    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*identity).orderBy(F.col("_new").desc(), F.col("position").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")
