"""DuckDB twins of the queries, written on their own from the definitions."""

from __future__ import annotations

from .contracts import CONSUMERS, FAMILIES
from .queries import CONTEXT_AS_OF, DIRTY_AS_OF, STALE_AS_OF, TIE

BARS = """
trades AS (
  SELECT l_returnflag AS symbol, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS px, l_quantity,
    row_number() OVER (PARTITION BY l_returnflag, l_shipdate::DATE
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k
  FROM lineitem),
bars AS (
  SELECT symbol, date, max(px) FILTER (k = 1) AS close, max(px) AS high, min(px) AS low
  FROM trades GROUP BY symbol, date)"""

CYCLE = """
bars AS (
  SELECT 'BTC-USD' AS symbol, (o_orderdate::DATE + 7305)::DATE AS date,
    arg_max(o_totalprice, o_orderkey) AS close, max(o_totalprice) AS high FROM orders GROUP BY ALL)"""

RSI = """
steps AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS step FROM bars),
means AS (
  SELECT *, CASE WHEN count(step) OVER w >= 14 THEN avg(CASE WHEN step IS NOT NULL THEN greatest(step, 0) END) OVER w END AS gain,
    CASE WHEN count(step) OVER w >= 14 THEN avg(CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END) OVER w END AS loss
  FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)),
rsi AS (
  SELECT *, CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100.0::DOUBLE WHEN gain IS NOT NULL THEN 50.0::DOUBLE END AS rsi14
  FROM means)"""

WILDER = """
steps AS (
  SELECT *, row_number() OVER s AS i, close - lag(close) OVER s AS step
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
seeds AS (
  SELECT symbol, avg(greatest(step, 0)) AS g0, avg(greatest(-step, 0)) AS l0 FROM steps WHERE i BETWEEN 2 AND 15 GROUP BY symbol),
later AS (
  SELECT symbol, date, i, close, list(greatest(step, 0)) OVER w AS gs, list(greatest(-step, 0)) OVER w AS ls
  FROM steps WHERE i > 15 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
folded AS (
  SELECT symbol, date, i, close,
    list_reduce(list_prepend(g0, gs), lambda a, x: a * 13 / 14 + x / 14) AS g,
    list_reduce(list_prepend(l0, ls), lambda a, x: a * 13 / 14 + x / 14) AS l
  FROM later JOIN seeds USING (symbol)
  UNION ALL SELECT symbol, date, i, close, g0, l0 FROM steps JOIN seeds USING (symbol) WHERE i = 15
  UNION ALL SELECT symbol, date, i, close, NULL, NULL FROM steps WHERE i < 15),
rsi AS (
  SELECT symbol, date, close, CASE WHEN i < 15 THEN 50.0::DOUBLE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS rsi14
  FROM folded)"""

W = "(PARTITION BY symbol ORDER BY date ROWS {} PRECEDING)"


def _full(f: str, x: str, n: int, least: int | None = None, scale: str = "") -> str:
    w = W.format(n - 1)
    return f"CASE WHEN count({x}) OVER {w} >= {least or n} THEN {f} OVER {w}{scale} END"


def _mean(n: int) -> str:
    return _full("avg(close)", "close", n)


def _rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c} + {TIE}, {digits}) AS {c}" for c in columns.split())


DAY = "strftime(date, '%Y-%m-%d') AS date"


def _ema(n: int) -> str:
    fold = f"list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY date), lambda a, x: a * (1 - 2.0::DOUBLE / {n + 1}) + x * (2.0::DOUBLE / {n + 1}))"
    return f"CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) >= {n} THEN {fold} END"


SCORE = """greatest(-1, least(1, (close / sma200 - 1) / 0.1)) * 0.4 + greatest(-1, least(1, (sma50 / sma200 - 1) / 0.1)) * 0.35
  + greatest(-1, least(1, (rsi14 - 50) / 50)) * 0.25"""

TECHNICAL = f"""
{BARS}, {RSI},
ranges AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr,
    ln(close / lag(close) OVER s) AS r, close / lag(close, 90) OVER s - 1 AS momentum_90d
  FROM rsi WINDOW s AS (PARTITION BY symbol ORDER BY date)),
kernels AS (
  SELECT symbol, date, close, rsi14, momentum_90d, {', '.join(f'{_mean(n)} AS sma{n}' for n in (20, 50, 100, 200))},
    {_ema(20)} AS ema20, {_ema(50)} AS ema50, {_full('max(high)', 'high', 252)} AS high252, {_full('avg(tr)', 'tr', 14)} AS atr14,
    {_full('stddev_pop(r)', 'r', 20, scale=' * sqrt(252)')} AS realized_volatility_20d, {_full('stddev_pop(r)', 'r', 63, scale=' * sqrt(252)')} AS realized_volatility_63d
  FROM ranges),
frame AS (
  SELECT *, greatest(0, 1 - close / high252) AS drawdown_252d, close / sma200 - 1 AS sma200_gap,
    CASE WHEN rsi14 IS NOT NULL THEN {SCORE} END AS trend_score
  FROM kernels WHERE sma200 IS NOT NULL AND high252 IS NOT NULL
    AND symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 252))"""
TECHNICAL_COLUMNS = (
    "close sma20 sma50 sma100 sma200 ema20 ema50 high252 drawdown_252d sma200_gap rsi14 atr14 realized_volatility_20d realized_volatility_63d momentum_90d trend_score"
)

BTC = f"""
{CYCLE}, {RSI},
ranks AS (
  SELECT *, row_number() OVER s AS i, ln(close / lag(close) OVER s) AS r, lag(close, 90) OVER s AS c90,
    pow(10, 5.84 * log10(greatest(1, date_diff('day', DATE '2009-01-03', date))) - 17.01) AS ahr999_estimate_price
  FROM rsi WINDOW s AS (PARTITION BY symbol ORDER BY date)),
base AS (
  SELECT symbol, date, close, i, rsi14, ahr999_estimate_price, avg(close) OVER {W.format(199)} AS sma200, exp(avg(ln(close)) OVER {W.format(199)}) AS gma200,
    max(high) OVER {W.format(251)} AS high252, close / c90 - 1 AS momentum_90d,
    CASE WHEN i > 30 THEN stddev_pop(r) OVER {W.format(29)} * sqrt(365) END AS realized_volatility_30d
  FROM ranks),
first AS (
  SELECT *, close / sma200 AS mayer_multiple, close / gma200 * (close / ahr999_estimate_price) AS ahr999, close / sma200 * (close / ahr999_estimate_price) AS ahr999_sma,
    greatest(0, 1 - close / high252) AS drawdown_252d, close / sma200 - 1 AS sma200_gap, 'price_derived' AS cycle_indicator_source
  FROM base WHERE i >= 200),
frame AS (
  SELECT *, len(list_filter(list(ahr999) OVER w, lambda v: v <= ahr999))::DOUBLE / count(ahr999) OVER w AS ahr999_365d_percentile,
    len(list_filter(list(mayer_multiple) OVER w, lambda v: v <= mayer_multiple))::DOUBLE / count(mayer_multiple) OVER w AS mayer_multiple_365d_percentile,
    (ahr999 - lag(ahr999, 30) OVER (PARTITION BY symbol ORDER BY date)) / 30 AS ahr999_30d_slope
  FROM first WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 364 PRECEDING))"""
BASE_COLUMNS = "close sma200 gma200 high252 momentum_90d ahr999_estimate_price rsi14 realized_volatility_30d mayer_multiple ahr999 ahr999_sma drawdown_252d sma200_gap"
LATEST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY frame.date DESC) = 1"

ROTATION = f"""
{BARS}, {WILDER},
vols AS (
  SELECT symbol, date, close, rsi14, close / lag(close) OVER s - 1 AS r, count(*) OVER (PARTITION BY symbol) AS rows_
  FROM rsi WINDOW s AS (PARTITION BY symbol ORDER BY date)),
means AS (
  SELECT *, {_full('avg(close)', 'close', 140)} AS ma_trend, {_full('avg(close)', 'close', 20)} AS ma20, {_full('stddev_pop(close)', 'close', 20)} AS sd,
    {_full('stddev_samp(r)', 'r', 10, scale=' * sqrt(252)')} AS realized_volatility_10, {_full('stddev_samp(r)', 'r', 20, scale=' * sqrt(252)')} AS realized_volatility,
    {_full('quantile_cont(rsi14, 0.9)', 'rsi14', 252)} AS rq
  FROM vols),
frame AS (
  SELECT *, close AS price, ma20 - lag(ma20) OVER s AS ma20_slope, ma20 + 2 * sd AS bb_upper, ma20 AS bb_mid, ma20 - 2 * sd AS bb_lower,
    greatest(70.0::DOUBLE, coalesce(lag(rq) OVER s, 70.0::DOUBLE)) AS rsi14_dynamic_threshold, count(realized_volatility_10) OVER w AS n10,
    {_full('quantile_cont(realized_volatility_10, 0.95)', 'realized_volatility_10', 252, 126)} AS vq,
    CASE WHEN vq IS NOT NULL THEN least(0.75::DOUBLE, greatest(0.5::DOUBLE, vq)) END AS t10
  FROM means WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING))"""
_FIXED = {"lookback": 252, "percentile": 0.95, "min_periods": 126, "floor": 0.5, "cap": 0.75}
_DYNAMIC = ", ".join(
    f"round(t10 + {TIE}, 4) AS {v}_dynamic_threshold, n10 AS {v}_dynamic_sample_count, " + ", ".join(f"{x}::DOUBLE AS {v}_dynamic_{k}" for k, x in _FIXED.items())
    for v in ("realized_volatility_10", "realized_volatility")
)

DIRTY = """
raw AS (
  SELECT event_type AS series, event_id, try_cast(CASE WHEN event_id % 97 = 0 THEN 'bad-date' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS date,
    try_cast(CASE WHEN event_id % 89 = 0 THEN '.' WHEN event_id % 83 = 0 THEN '-1.0' ELSE value::VARCHAR END AS DOUBLE) AS close
  FROM events)"""

CONTEXT = """
raw AS (
  SELECT event_id, DATE '2020-01-01' + (event_id * 3 % 4001)::INT AS date,
    CASE WHEN event_id % 31 <> 0 THEN (event_id % 113)::DOUBLE / 100 END AS cape_percentile,
    CASE WHEN event_id % 31 <> 0 THEN (event_id % 101)::DOUBLE / 100 END AS vix_percentile,
    CASE WHEN event_id % 31 <> 0 THEN (event_id % 97)::DOUBLE / 100 END AS breadth_above_sma200_pct,
    CASE WHEN event_id % 53 <> 0 THEN date + (CASE WHEN event_id % 59 = 0 THEN 2 ELSE 0 END) END AS provided,
    event_id % 61 = 0 AS blank, date + (CASE WHEN event_id % 67 = 0 THEN 1 ELSE 0 END) AS universe
  FROM events)"""
_IN = "cape_percentile BETWEEN 0 AND 1 AND vix_percentile BETWEEN 0 AND 1 AND breadth_above_sma200_pct BETWEEN 0 AND 1"
_KNOWN = "cape_percentile IS NOT NULL AND vix_percentile IS NOT NULL AND breadth_above_sma200_pct IS NOT NULL"

METRICS = """
vix AS (SELECT l_shipdate::DATE AS date, max(l_extendedprice) AS value FROM lineitem GROUP BY 1),
cape AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, max(o_totalprice) AS value FROM orders GROUP BY 1)"""
PROXY = """
f AS (SELECT o_orderdate::DATE AS date, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
o AS (SELECT o_orderdate::DATE AS date, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"""


def _percentile(source: str) -> str:
    return f"SELECT date, len(list_filter(list(value) OVER w, lambda v: v <= value))::DOUBLE / count(value) OVER w AS p FROM {source} WINDOW w AS (ORDER BY date)"


_need = [(c, s, f, i) for c, by in CONSUMERS.items() for s, fields in by.items() for i, f in enumerate(fields)]
NEED = "need(consumer, symbol, field, ord) AS (VALUES " + ", ".join(f"('{c}', '{s}', '{f}', {i})" for c, s, f, i in _need) + ")"
_have = [(f["family"], c, s, x) for f in FAMILIES.values() for c in f["compatible_profiles"] for s in f["symbols"] for x in f["derived_indicator_fields"]]
HAVE = "have(family, consumer, symbol, field) AS (VALUES " + ", ".join(str(r) for r in _have) + ")"
_runs = [(f["family"], c) for f in FAMILIES.values() for c in f["runtime_consumers"]]
COVERED = "covered AS (SELECT consumer, family, symbol, field FROM need JOIN have USING (consumer, symbol, field))"
ENTRIES = """
entries AS (
  SELECT 'bundle.' || o_custkey AS bundle_id, o_orderdate::DATE AS as_of, CASE WHEN o_orderstatus = 'P' THEN 'stale' ELSE 'FRESH' END AS freshness_status,
    o_orderpriority AS profile, o_orderkey AS position FROM orders)"""

SQL: dict[str, str] = {
    "ohlcv_normalize": f"""WITH {DIRTY}
      SELECT series AS symbol, {DAY}, close, close AS high, close AS low FROM raw WHERE close > 0 AND raw.date <= DATE '{DIRTY_AS_OF}'
      QUALIFY row_number() OVER (PARTITION BY series, raw.date ORDER BY event_id DESC) = 1""",
    "sma": f"WITH {BARS} SELECT symbol, {DAY}, {', '.join(f'round({_mean(n).replace("date ROWS", "bars.date ROWS")} + {TIE}, 6) AS sma{n}' for n in (20, 50, 100, 200))} FROM bars",
    "ema": f"WITH {BARS}, k AS (SELECT symbol, date, {_ema(20)} AS ema20, {_ema(50)} AS ema50 FROM bars) SELECT symbol, {DAY}, {_rounded('ema20 ema50')} FROM k",
    "high_drawdown": f"""WITH {BARS}, k AS (SELECT symbol, date, close, {_full('max(high)', 'high', 252)} AS high252 FROM bars)
      SELECT symbol, {DAY}, round(high252 + {TIE}, 6) AS high252, round(CASE WHEN high252 > 0 THEN greatest(0, 1 - close / high252) END + {TIE}, 6) AS drawdown_252d FROM k""",
    "rsi_simple": f"WITH {BARS}, {RSI} SELECT symbol, {DAY}, round(rsi14 + {TIE}, 4) AS rsi14 FROM rsi",
    "rsi_wilder": f"WITH {BARS}, {WILDER} SELECT symbol, {DAY}, round(rsi14 + {TIE}, 4) AS rsi14 FROM rsi",
    "atr14": f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr FROM bars
      WINDOW s AS (PARTITION BY symbol ORDER BY date)), k AS (SELECT symbol, date, {_full('avg(tr)', 'tr', 14)} AS atr14 FROM t) SELECT symbol, {DAY}, round(atr14 + {TIE}, 6) AS atr14 FROM k""",
    "realized_vol_log_pop": f"""WITH {BARS}, t AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM bars),
      k AS (SELECT symbol, date, {_full('stddev_pop(r)', 'r', 20, scale=' * sqrt(252)')} AS volatility_20d, {_full('stddev_pop(r)', 'r', 63, scale=' * sqrt(252)')} AS volatility_63d FROM t)
      SELECT symbol, {DAY}, {_rounded('volatility_20d volatility_63d')} FROM k""",
    "realized_vol_simple_samp": f"""WITH {BARS}, t AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars),
      k AS (SELECT symbol, date, {_full('stddev_samp(r)', 'r', 10, scale=' * sqrt(252)')} AS volatility_10 FROM t) SELECT symbol, {DAY}, round(volatility_10 + {TIE}, 6) AS volatility_10 FROM k""",
    "momentum_90": f"WITH {BARS}, k AS (SELECT symbol, date, close / lag(close, 90) OVER (PARTITION BY symbol ORDER BY date) - 1 AS m FROM bars) SELECT symbol, {DAY}, round(m + {TIE}, 6) AS momentum_90d FROM k",
    "trend_score": f"""WITH {BARS}, {RSI}, k AS (SELECT symbol, date, close, rsi14, {_mean(50)} AS sma50, {_mean(200)} AS sma200 FROM rsi)
      SELECT symbol, {DAY}, round(CASE WHEN sma200 IS NOT NULL AND rsi14 IS NOT NULL THEN {SCORE} END + {TIE}, 4) AS trend_score FROM k""",
    "technical_frame": f"WITH {TECHNICAL} SELECT symbol, {DAY}, {_rounded(TECHNICAL_COLUMNS, 5)} FROM frame",
    "technical_latest": f"WITH {TECHNICAL} SELECT symbol, {DAY}, {_rounded(TECHNICAL_COLUMNS, 4)} FROM frame {LATEST}",
    "btc_base": f"WITH {BTC} SELECT symbol, {DAY}, cycle_indicator_source, {_rounded(BASE_COLUMNS, 3)} FROM first",
    "btc_research_percentiles": f"WITH {BTC} SELECT symbol, {DAY}, {_rounded('ahr999_365d_percentile mayer_multiple_365d_percentile')} FROM frame",
    "btc_slope30": f"WITH {BTC} SELECT symbol, {DAY}, {_rounded('ahr999_30d_slope')} FROM frame",
    "btc_latest": f"""WITH {BTC} SELECT symbol, {DAY}, cycle_indicator_source,
      {_rounded(BASE_COLUMNS + ' ahr999_365d_percentile mayer_multiple_365d_percentile ahr999_30d_slope', 4)} FROM frame {LATEST}""",
    "rotation_bands": f"WITH {ROTATION} SELECT symbol, {DAY}, {_rounded('ma_trend ma20 ma20_slope bb_upper bb_mid bb_lower', 5)} FROM frame",
    "rotation_dynamic_rsi": f"WITH {ROTATION} SELECT symbol, {DAY}, {_rounded('rsi14 rsi14_dynamic_threshold', 4)} FROM frame",
    "rotation_dynamic_vol": f"""WITH {ROTATION} SELECT symbol, {DAY}, round(realized_volatility_10 + {TIE}, 6) AS realized_volatility_10,
      round(t10 + {TIE}, 6) AS realized_volatility_10_dynamic_threshold, n10 AS realized_volatility_10_dynamic_sample_count FROM frame""",
    "rotation_latest": f"""WITH {ROTATION} SELECT symbol, {DAY}, {_rounded('price ma_trend ma20 ma20_slope rsi14 rsi14_dynamic_threshold bb_upper bb_mid bb_lower realized_volatility realized_volatility_10', 4)},
      round(realized_volatility + {TIE}, 4) AS realized_volatility_20, {_DYNAMIC} FROM frame WHERE rows_ >= 420 {LATEST}""",
    "expanding_percentile": f"WITH {METRICS}, k AS ({_percentile('vix')}) SELECT 'm' AS series, {DAY}, round(p + {TIE}, 6) AS percentile FROM k",
    "asof_join": f"WITH {METRICS} SELECT 'm' AS series, strftime(v.date, '%Y-%m-%d') AS date, v.value AS vix, c.value AS cape FROM vix v ASOF LEFT JOIN cape c ON v.date >= c.date",
    "asof_context": f"""WITH {METRICS}, v AS ({_percentile('vix')}), c AS ({_percentile('cape')})
      SELECT 'm' AS series, strftime(v.date, '%Y-%m-%d') AS date, round(c.p + {TIE}, 6) AS cape_percentile, round(v.p + {TIE}, 6) AS vix_percentile,
        strftime(v.date, '%Y-%m-%dT00:00:00Z') AS provider_timestamp FROM v ASOF JOIN c ON v.date >= c.date""",
    "price_proxy_inner_join": f"""WITH {PROXY} SELECT 'p' AS series, strftime(f.date, '%Y-%m-%d') AS date, f.value AS QQQ, o.value AS SPY,
      strftime(f.date, '%Y-%m-%dT00:00:00Z') AS provider_timestamp FROM f JOIN o USING (date)""",
    "same_day_inner_join": f"WITH {PROXY} SELECT 'p' AS series, strftime(f.date, '%Y-%m-%d') AS date, f.value AS f, o.value AS o FROM f JOIN o USING (date)",
    "context_normalize": f"""WITH {CONTEXT}, kept AS (SELECT * FROM raw WHERE {_KNOWN} AND date <= DATE '{CONTEXT_AS_OF}'
        QUALIFY row_number() OVER (PARTITION BY date ORDER BY event_id DESC) = 1)
      SELECT {DAY}, cape_percentile, vix_percentile, breadth_above_sma200_pct,
        CASE WHEN event_id % 53 = 0 THEN 'never' ELSE strftime(provided, '%Y-%m-%dT00:00:00Z') END AS provider_timestamp FROM kept WHERE {_IN}""",
    "ohlcv_quality_report": f"""WITH {DIRTY},
      usable AS (SELECT * FROM raw WHERE close > 0 AND date <= DATE '{DIRTY_AS_OF}'),
      days AS (SELECT series, date, date_diff('day', lag(date) OVER (PARTITION BY series ORDER BY date), date) AS gap FROM (SELECT DISTINCT series, date FROM usable)),
      a AS (SELECT series, count(*) AS raw_row_count, count(*) FILTER (date IS NULL) AS invalid_date_count, count(*) FILTER (close IS NULL) AS null_close_count,
        count(*) FILTER (close <= 0) AS non_positive_close_count, count(*) FILTER (close > 0 AND date > DATE '{DIRTY_AS_OF}') AS filtered_after_as_of_count FROM raw GROUP BY series),
      b AS (SELECT series, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, count(*) AS normalized_row_count,
        coalesce(max(gap), 0) AS max_gap_days, count(*) FILTER (gap > 1) AS gap_count_above_threshold FROM days GROUP BY series),
      u AS (SELECT series, count(*) AS n FROM usable GROUP BY series),
      r AS (SELECT *, n - normalized_row_count AS duplicate_date_count, raw_row_count - normalized_row_count AS dropped_row_count,
          CASE WHEN normalized_row_count < 20 THEN 'insufficient_history_rows' ELSE '' END AS failure_reasons FROM a JOIN b USING (series) JOIN u USING (series)),
      w AS (SELECT *, concat_ws(',', CASE WHEN invalid_date_count > 0 THEN 'invalid_dates_dropped' END, CASE WHEN null_close_count > 0 THEN 'null_closes_dropped' END,
        CASE WHEN non_positive_close_count > 0 THEN 'non_positive_closes_dropped' END, CASE WHEN duplicate_date_count > 0 THEN 'duplicate_dates_collapsed' END,
        CASE WHEN filtered_after_as_of_count > 0 THEN 'rows_after_as_of_filtered' END, CASE WHEN gap_count_above_threshold > 0 THEN 'date_gaps_above_threshold' END) AS warning_reasons FROM r)
      SELECT * EXCLUDE (n), CASE WHEN failure_reasons <> '' THEN 'fail' WHEN warning_reasons <> '' THEN 'warn' ELSE 'pass' END AS quality_status FROM w""",
    "context_availability_report": f"""WITH {CONTEXT},
      usable AS (SELECT * FROM raw WHERE {_KNOWN} AND {_IN} AND date <= DATE '{CONTEXT_AS_OF}'),
      days AS (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM (SELECT DISTINCT date FROM usable)),
      a AS (SELECT count(*) AS raw_row_count, count(*) FILTER (date IS NULL) AS invalid_date_count,
        count(*) FILTER (cape_percentile IS NULL) AS null_cape_percentile, count(*) FILTER (vix_percentile IS NULL) AS null_vix_percentile,
        count(*) FILTER (breadth_above_sma200_pct IS NULL) AS null_breadth_above_sma200_pct,
        count(*) FILTER (cape_percentile IS NULL OR cape_percentile > 1) AS out_of_range_cape_percentile,
        count(*) FILTER (vix_percentile IS NULL OR vix_percentile > 1) AS out_of_range_vix_percentile,
        count(*) FILTER (breadth_above_sma200_pct IS NULL OR breadth_above_sma200_pct > 1) AS out_of_range_breadth_above_sma200_pct,
        count(*) FILTER ({_KNOWN} AND date > DATE '{CONTEXT_AS_OF}') AS filtered_after_as_of_count,
        count(*) FILTER (provided IS NULL) AS provider_timestamp_missing_count, count(*) FILTER (provided > DATE '{CONTEXT_AS_OF}') AS provider_timestamp_after_as_of_count,
        count(*) FILTER (blank) AS breadth_universe_snapshot_missing_count, 0::BIGINT AS breadth_universe_as_of_invalid_count,
        count(*) FILTER (universe > date) AS breadth_universe_as_of_after_observation_count FROM raw),
      b AS (SELECT strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, count(*) AS normalized_row_count,
        coalesce(max(gap), 0) AS max_gap_days, count(*) FILTER (gap > 7) AS gap_count_above_threshold FROM days),
      r AS (SELECT 'c' AS series, *, (SELECT count(*) FROM usable) - normalized_row_count AS duplicate_date_count,
        null_cape_percentile + null_vix_percentile + null_breadth_above_sma200_pct AS null_indicator_count,
        out_of_range_cape_percentile + out_of_range_vix_percentile + out_of_range_breadth_above_sma200_pct AS out_of_range_count FROM a, b),
      w AS (SELECT *, concat_ws(',', CASE WHEN normalized_row_count <= 0 THEN 'no_usable_rows' END, CASE WHEN normalized_row_count < 1 THEN 'insufficient_history_rows' END,
          CASE WHEN provider_timestamp_after_as_of_count > 0 THEN 'provider_timestamp_after_as_of' END,
          CASE WHEN breadth_universe_as_of_after_observation_count > 0 THEN 'breadth_universe_as_of_after_observation' END) AS failure_reasons,
        concat_ws(',', CASE WHEN invalid_date_count > 0 THEN 'invalid_dates_dropped' END, CASE WHEN null_indicator_count > 0 THEN 'null_indicators_dropped' END,
          CASE WHEN out_of_range_count > 0 THEN 'out_of_range_indicators_dropped' END, CASE WHEN duplicate_date_count > 0 THEN 'duplicate_dates_collapsed' END,
          CASE WHEN filtered_after_as_of_count > 0 THEN 'rows_after_as_of_filtered' END, CASE WHEN gap_count_above_threshold > 0 THEN 'date_gaps_above_threshold' END,
          CASE WHEN provider_timestamp_missing_count > 0 THEN 'provider_timestamps_missing_or_invalid' END,
          CASE WHEN breadth_universe_snapshot_missing_count > 0 THEN 'breadth_universe_snapshot_missing' END) AS warning_reasons FROM r)
      SELECT *, CASE WHEN failure_reasons <> '' THEN 'fail' WHEN warning_reasons <> '' THEN 'warn' ELSE 'pass' END AS quality_status FROM w""",
    "source_staleness": f"""WITH {METRICS}, both_ AS (SELECT 'daily' AS series, max(date) AS d FROM vix UNION ALL SELECT 'monthly', max(date) FROM cape)
      SELECT series, strftime(d, '%Y-%m-%d') AS last_date, greatest(0, date_diff('day', d, DATE '{STALE_AS_OF}')) AS lag_days,
        CASE WHEN greatest(0, date_diff('day', d, DATE '{STALE_AS_OF}')) > 120 THEN series || ':latest_observation_stale' ELSE '' END AS failure_reasons FROM both_""",
    "gap_stats": """WITH days AS (SELECT DISTINCT DATE '2020-01-01' + (event_id * 3 % 4001)::INT AS date FROM events WHERE event_id % 7 < 3),
      gaps AS (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM days)
      SELECT 'g' AS series, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, count(*) AS normalized_row_count,
        coalesce(max(gap), 0) AS max_gap_days, count(*) FILTER (gap > 1) AS gap_count_above_threshold FROM gaps""",
    "event_gaps": """WITH days AS (SELECT DISTINCT DATE '2000-01-01' + (event_id * event_id % 9973)::INT AS date FROM events),
      gaps AS (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM days)
      SELECT 'e' AS series, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, count(*) AS normalized_row_count,
        coalesce(max(gap), 0) AS max_gap_days, count(*) FILTER (gap > 1) AS gap_count_above_threshold FROM gaps""",
    "contract_coverage": f"WITH {NEED}, {HAVE}, {COVERED} SELECT * FROM covered",
    "missing_fields_antijoin": f"""WITH {NEED}, n AS (SELECT *, row_number() OVER (ORDER BY consumer, symbol, ord) AS n FROM need)
      SELECT consumer, symbol, field FROM n WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 1)""",
    "missing_fields_by_size": f"""WITH {NEED}, n AS (SELECT *, row_number() OVER (ORDER BY consumer, symbol, ord) AS n FROM need)
      SELECT consumer, symbol, field FROM n WHERE n NOT IN (SELECT p_size * p_size % 53 FROM part)""",
    "ownership_matrix": f"""WITH {NEED}, {HAVE}, {COVERED},
      c AS (SELECT consumer, count(DISTINCT (symbol, field)) AS k, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM covered GROUP BY consumer)
      SELECT consumer, CASE WHEN consumer LIKE 'research:%' THEN 'research' ELSE 'runtime' END AS kind, count(*) AS required_count,
        coalesce(any_value(k), 0) AS covered_count, coalesce(any_value(families), '') AS families, coalesce(any_value(k), 0) = count(*) AS complete
      FROM need LEFT JOIN c USING (consumer) GROUP BY consumer""",
    "runtime_coverage": f"""WITH {NEED}, runs(family, consumer) AS (VALUES {', '.join(map(str, _runs))})
      SELECT consumer, coalesce(string_agg(family, ',' ORDER BY family), '') AS families, count(family) AS family_count
      FROM (SELECT DISTINCT consumer FROM need WHERE consumer NOT LIKE 'research:%') LEFT JOIN runs USING (consumer) GROUP BY consumer""",
    "index_top1_as_of": f"""WITH {ENTRIES} SELECT bundle_id, strftime(as_of, '%Y-%m-%d') AS as_of, position FROM entries
      WHERE lower(freshness_status) = 'fresh' AND entries.as_of <= DATE '1997-01-01' AND profile = '1-URGENT'
      QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY entries.as_of DESC, position) = 1""",
    "index_upsert": f"""WITH {ENTRIES} SELECT bundle_id, strftime(as_of, '%Y-%m-%d') AS as_of, freshness_status, position FROM entries
      QUALIFY row_number() OVER (PARTITION BY bundle_id, entries.as_of ORDER BY (position % 3 = 0) DESC, position DESC) = 1""",
    "set_difference_known": "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "set_intersection": "WITH x AS (SELECT o_orderdate::DATE AS date FROM orders INTERSECT SELECT l_shipdate::DATE FROM lineitem) SELECT strftime(date, '%Y-%m-%d') AS date FROM x",
}
