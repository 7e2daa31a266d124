"""Queries over long and over many series: all events as one series, and a series for each user or supplier.

The sequential kernels run over equal blocks here (``functions/blocks``), so neither one series with all rows nor a
thousand short ones puts its work in one task. Values aren't shifted before rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import Recursive, Series, with_recursive
from ..operators import indicators as I
from ..operators import normalize as N
from ..operators import quality as Q
from ..operators.joins import as_of_join
from ..sources.fixtures import read
from .oracle import BASE_COLUMNS, BTC, CYCLE

WHOLE = Series((), "event_id", long=True)
USERS = Series(("user_id",), "event_id", long=True)


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", "event_id", "value")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def ema_events(spark: SparkSession, d: str) -> DataFrame:
    wanted = [Recursive(f"ema{n}", "ema", "value", n) for n in (20, 50)]
    return _rounded(with_recursive(_ticks(spark, d).drop("user_id"), WHOLE, wanted), "ema20", "ema50").drop("value")


def ema_users(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(with_recursive(_ticks(spark, d), USERS, [Recursive("ema20", "ema", "value", 20)]), "ema20").drop("value")


def rsi_wilder_events(spark: SparkSession, d: str) -> DataFrame:
    rows = with_recursive(_ticks(spark, d).drop("user_id"), WHOLE, [Recursive("rsi14", "wilder_rsi", "value", 14)])
    return _rounded(rows, "rsi14").drop("value")


def rsi_wilder_users(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(with_recursive(_ticks(spark, d), USERS, [Recursive("rsi14", "wilder_rsi", "value", 14)]), "rsi14").drop("value")


def _asof(spark: SparkSession, d: str, keys: tuple[str, ...]) -> DataFrame:
    """Each purchase, signup and error with the last view or click before it."""
    e = read(spark, d, "events")
    seen = F.col("event_type").isin("view", "click")
    left = e.where(~seen).select("user_id", "event_id", F.col("value").alias("spent"))
    right = e.where(seen).select("user_id", "event_id", F.col("value").alias("seen"))
    return as_of_join(left, right, keys, "spent", "seen", order="event_id", long=True)


def asof_events(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, ())


def asof_users(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, ("user_id",))


def expanding_percentile_events(spark: SparkSession, d: str) -> DataFrame:
    return with_recursive(_ticks(spark, d).drop("user_id"), WHOLE, [Recursive("percentile", "expanding_percentile", "value")]).drop("value")


def expanding_percentile_users(spark: SparkSession, d: str) -> DataFrame:
    return with_recursive(_ticks(spark, d), USERS, [Recursive("percentile", "expanding_percentile", "value")]).drop("value")


def rolling_order_events(spark: SparkSession, d: str) -> DataFrame:
    """Rolling quantile and trailing share over frames of 2520 rows."""
    wanted = [Recursive("q90", "rolling_quantile", "value", 2520, 0.9, 126), Recursive("share", "trailing_percentile", "value", 2520)]
    return _rounded(with_recursive(_ticks(spark, d).drop("user_id"), WHOLE, wanted), "q90").drop("value")


def rolling_order_users(spark: SparkSession, d: str) -> DataFrame:
    wanted = [Recursive("q90", "rolling_quantile", "value", 20, 0.9), Recursive("share", "trailing_percentile", "value", 30)]
    return _rounded(with_recursive(_ticks(spark, d), USERS, wanted), "q90").drop("value")


def asof_context_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Valuation context of every supplier: its daily top price, its monthly top quantity carried to the day."""
    rows = read(spark, d, "lineitem").withColumn("series", F.col("l_suppkey"))
    daily = rows.groupBy("series", F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("value"), F.lit(0).alias("_ord"))
    monthly = rows.groupBy("series", F.trunc("l_shipdate", "month").alias("date")).agg(F.max("l_quantity").alias("value"), F.lit(0).alias("_ord"))
    found = I.public_context(N.metric(daily, "value"), N.metric(monthly, "value"), long=True)
    return found.withColumn("date", C.iso_day(F.col("date")))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, date, close, high): a series of orders for every nation, moved 20 years on."""
    nation = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("symbol"))
    rows = read(spark, d, "orders").join(nation, "o_custkey").groupBy("symbol", F.date_add(F.to_date("o_orderdate"), 7305).alias("date"))
    return N.cycle(rows.agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.lit(0).alias("_ord")))


def _digits(column: str) -> int:
    """Means of prices in cents over 200 days end at the fifth digit; other values end nowhere."""
    return 6 if column == "sma200" else 4


def cycle_nations(spark: SparkSession, d: str) -> DataFrame:
    """Cycle indicators of every nation's series."""
    frame = I.cycle_frame(_nations(spark, d)).drop("cycle_indicator_source")
    return frame.select("symbol", C.iso_day(F.col("date")).alias("date"), *(F.round(c, _digits(c)).alias(c) for c in frame.columns[2:]))


def cycle_nations_latest(spark: SparkSession, d: str) -> DataFrame:
    frame = I.cycle_latest(_nations(spark, d)).drop("cycle_indicator_source")
    return frame.select("symbol", C.iso_day(F.col("date")).alias("date"), *(F.round(c, _digits(c)).alias(c) for c in frame.columns[2:]))


def gap_users(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the days of every user, which squares of event ids spread unevenly."""
    e = F.col("event_id")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (e * e % 9973).cast("int"))
    rows = read(spark, d, "events").select("user_id", day.alias("date"), e.alias("_ord"))
    days = Q.gap_stats(N.last_per_day(rows, ("user_id",)), ("user_id",), 30)
    return days.withColumns({c: C.iso_day(F.col(c)) for c in ("first_date", "last_date")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ema_events, ema_users, rsi_wilder_events, rsi_wilder_users, asof_events, asof_users, expanding_percentile_events,
        expanding_percentile_users, rolling_order_events, rolling_order_users, asof_context_suppliers, cycle_nations, cycle_nations_latest, gap_users,
    )
}

# ---- DuckDB twins: plain loops and counts

_LOOP = """vals AS (SELECT list(value ORDER BY event_id) AS v, list(event_id ORDER BY event_id) AS ids FROM events)"""

_EMA_EVENTS = f"""
WITH RECURSIVE {_LOOP},
walk AS (
  SELECT 1 AS i, v[1] AS a, v[1] AS b FROM vals WHERE len(v) > 0
  UNION ALL
  SELECT i + 1, a + (v[i + 1] - a) * (2.0::DOUBLE / 21), b + (v[i + 1] - b) * (2.0::DOUBLE / 51) FROM walk, vals WHERE i < len(v))
SELECT ids[i] AS event_id, CASE WHEN i >= 20 THEN round(a, 6) END AS ema20, CASE WHEN i >= 50 THEN round(b, 6) END AS ema50 FROM walk, vals
"""

_EMA_USERS = """
SELECT user_id, event_id, CASE WHEN row_number() OVER w >= 20 THEN round(list_reduce(list(value) OVER w, lambda a, x: a + (x - a) * (2.0::DOUBLE / 21)), 6) END AS ema20
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
"""

_RSI = "CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END"

_RSI_EVENTS = f"""
WITH RECURSIVE {_LOOP},
steps AS (SELECT list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) AS s FROM vals),
walk AS (
  SELECT 14::BIGINT AS i, list_sum(list_transform(s[1:14], lambda x: greatest(x, 0))) / 14 AS g, list_sum(list_transform(s[1:14], lambda x: greatest(-x, 0))) / 14 AS l
  FROM steps WHERE len(s) >= 14
  UNION ALL
  SELECT i + 1, (g * 13 + greatest(s[i + 1], 0)) / 14, (l * 13 + greatest(-s[i + 1], 0)) / 14 FROM walk, steps WHERE i < len(s))
SELECT ids[i + 1] AS event_id, round({_RSI}, 6) AS rsi14 FROM walk, vals
UNION ALL SELECT unnest(ids[1:14]), 50.0::DOUBLE FROM vals
"""

_RSI_USERS = f"""
WITH steps AS (
  SELECT user_id, event_id, row_number() OVER w AS i, value - lag(value) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
seeds AS (SELECT user_id, avg(greatest(step, 0)) AS g0, avg(greatest(-step, 0)) AS l0 FROM steps WHERE i BETWEEN 2 AND 15 GROUP BY user_id),
later AS (
  SELECT user_id, event_id, list(greatest(step, 0)) OVER w AS gs, list(greatest(-step, 0)) OVER w AS ls
  FROM steps WHERE i > 15 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
folded AS (
  SELECT user_id, event_id, list_reduce(list_prepend(g0, gs), lambda a, x: (a * 13 + x) / 14) AS g, list_reduce(list_prepend(l0, ls), lambda a, x: (a * 13 + x) / 14) AS l
  FROM later JOIN seeds USING (user_id)
  UNION ALL SELECT user_id, event_id, g0, l0 FROM steps JOIN seeds USING (user_id) WHERE i = 15
  UNION ALL SELECT user_id, event_id, 0, 0 FROM steps WHERE i < 15)
SELECT user_id, event_id, round({_RSI}, 6) AS rsi14 FROM folded
"""


def _asof_sql(keys: str, same: str) -> str:
    return f"""
SELECT {keys} l.event_id, l.value AS spent,
  (SELECT arg_max(r.value, r.event_id) FROM events r WHERE r.event_type IN ('view', 'click') AND r.event_id <= l.event_id {same}) AS seen
FROM events l WHERE l.event_type NOT IN ('view', 'click')
"""


def _expanding_sql(keys: str, same: str) -> str:
    return f"""
SELECT {keys} x.event_id, count(*) FILTER (y.value <= x.value) / count(y.value) AS percentile
FROM events x JOIN events y ON y.event_id <= x.event_id {same} GROUP BY {keys} x.event_id
"""


def _order_sql(keys: str, part: str, quantile: int, share: int, least: int) -> str:
    return f"""
WITH frames AS (
  SELECT {keys} event_id, value, quantile_cont(value, 0.9) OVER a AS q, count(value) OVER a AS n, list(value) OVER b AS vs
  FROM events WINDOW a AS ({part} ORDER BY event_id ROWS {quantile - 1} PRECEDING), b AS ({part} ORDER BY event_id ROWS {share - 1} PRECEDING))
SELECT {keys} event_id, CASE WHEN n >= {least} THEN round(q, 6) END AS q90, len(list_filter(vs, lambda x: x <= value)) / len(vs) AS share FROM frames
"""


_NATION_BARS = """
bars AS (
  SELECT n_name AS symbol, (o_orderdate::DATE + 7305)::DATE AS date, arg_max(o_totalprice, o_orderkey) AS close, max(o_totalprice) AS high
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_NATIONS = BTC.replace(CYCLE, _NATION_BARS)
_NATION_COLUMNS = ", ".join(f"round({c}, {_digits(c)}) AS {c}" for c in f"{BASE_COLUMNS} ahr999_365d_percentile mayer_multiple_365d_percentile ahr999_30d_slope".split())

SQL = {
    "cycle_nations": f"WITH {_NATIONS} SELECT symbol, strftime(date, '%Y-%m-%d') AS date, {_NATION_COLUMNS} FROM frame",
    "cycle_nations_latest": f"WITH {_NATIONS} SELECT symbol, strftime(date, '%Y-%m-%d') AS date, {_NATION_COLUMNS} FROM frame QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
    "gap_users": """WITH days AS (SELECT DISTINCT user_id, DATE '2000-01-01' + (event_id * event_id % 9973)::INT AS date FROM events),
      gaps AS (SELECT user_id, date, date_diff('day', lag(date) OVER (PARTITION BY user_id ORDER BY date), date) AS gap FROM days)
      SELECT user_id, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, count(*) AS normalized_row_count,
        coalesce(max(gap), 0) AS max_gap_days, count(*) FILTER (gap > 30) AS gap_count_above_threshold FROM gaps GROUP BY user_id""",
    "ema_events": _EMA_EVENTS,
    "ema_users": _EMA_USERS,
    "rsi_wilder_events": _RSI_EVENTS,
    "rsi_wilder_users": _RSI_USERS,
    "asof_events": _asof_sql("", ""),
    "asof_users": _asof_sql("l.user_id,", "AND r.user_id = l.user_id"),
    "expanding_percentile_events": _expanding_sql("", ""),
    "expanding_percentile_users": _expanding_sql("x.user_id,", "AND y.user_id = x.user_id"),
    "rolling_order_events": _order_sql("", "", 2520, 2520, 126),
    "rolling_order_users": _order_sql("user_id,", "PARTITION BY user_id", 20, 30, 20),
    "asof_context_suppliers": """
WITH daily AS (SELECT l_suppkey AS series, l_shipdate::DATE AS date, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
monthly AS (SELECT l_suppkey AS series, date_trunc('month', l_shipdate)::DATE AS date, max(l_quantity) AS value FROM lineitem GROUP BY ALL),
vix AS (
  SELECT x.series, x.date, count(*) FILTER (y.value <= x.value) / count(*) AS p FROM daily x JOIN daily y ON x.series = y.series AND y.date <= x.date GROUP BY ALL),
cape AS (
  SELECT x.series, x.date, count(*) FILTER (y.value <= x.value) / count(*) AS p FROM monthly x JOIN monthly y ON x.series = y.series AND y.date <= x.date GROUP BY ALL)
SELECT v.series, strftime(v.date, '%Y-%m-%d') AS date, c.p AS cape_percentile, v.p AS vix_percentile, strftime(v.date, '%Y-%m-%dT00:00:00Z') AS provider_timestamp
FROM vix v ASOF JOIN cape c ON v.series = c.series AND v.date >= c.date
""",
}
