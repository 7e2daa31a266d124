"""The contract relations over the driver's tables: who requires what of trade, and which suppliers cover it.

A nation whose customers ordered is a consumer; it requires the (brand, type and size) of the parts they ordered. A supplier is a
source family; it offers the brands and fields of the lots of 49 pieces or more that it shipped, to the nations of its region.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import read
from . import contracts as K


def _field() -> Column:
    return F.concat_ws("-", F.lower("p_type"), F.col("p_size").cast("string"))


def _consumer() -> Column:
    return F.concat(F.when(F.col("n_regionkey") < 2, "research:").otherwise("trade:"), "n_name")


def required(spark: SparkSession, d: str) -> DataFrame:
    """(consumer, symbol, field), each once."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    who = orders.join(read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(read(spark, d, "nation"), "n_nationkey")
    found = lines.join(who, "o_orderkey").join(read(spark, d, "part"), "p_partkey")
    return found.select(_consumer().alias("consumer"), F.col("p_brand").alias("symbol"), _field().alias("field")).distinct()


def families(spark: SparkSession, d: str) -> DataFrame:
    """(family, symbols, fields, consumers, runtime) of every supplier."""
    lots = read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    made = lots.join(read(spark, d, "part"), "p_partkey").groupBy("s_suppkey").agg(F.collect_set("p_brand").alias("symbols"), F.collect_set(_field()).alias("fields"))
    nations = read(spark, d, "nation")
    region = nations.groupBy("n_regionkey").agg(F.collect_set(_consumer()).alias("consumers"))
    where = nations.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey").join(region, "n_regionkey")
    found = read(spark, d, "supplier").join(where, "s_nationkey").join(made, "s_suppkey", "left")
    empty = F.array().cast("array<string>")
    runtime = F.when(F.col("symbols").isNotNull(), F.filter("consumers", lambda c: ~c.startswith("research:"))).otherwise(empty)
    return found.select(F.col("s_name").alias("family"), F.coalesce("symbols", empty).alias("symbols"), F.coalesce("fields", empty).alias("fields"), "consumers", runtime.alias("runtime"))


def trade_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.coverage(required(spark, d), families(spark, d))


def trade_ownership(spark: SparkSession, d: str) -> DataFrame:
    return K.ownership(required(spark, d), families(spark, d))


def trade_runtime(spark: SparkSession, d: str) -> DataFrame:
    return K.runtime_coverage(families(spark, d), required(spark, d))


def trade_missing(spark: SparkSession, d: str) -> DataFrame:
    """What no supplier of its region offers to a consumer."""
    offers = families(spark, d).select(F.explode("consumers").alias("consumer"), "symbols", "fields")
    offers = offers.select("consumer", F.explode("symbols").alias("symbol"), "fields").select("consumer", "symbol", F.explode("fields").alias("field"))
    return K.missing_fields(required(spark, d), offers, ("consumer", "symbol"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (trade_coverage, trade_ownership, trade_runtime, trade_missing)}

_BASE = """
consumers AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey < 2 THEN 'research:' ELSE 'trade:' END || n_name AS consumer FROM nation),
parts AS (SELECT p_partkey, p_brand AS symbol, lower(p_type) || '-' || p_size AS field FROM part),
need AS (
  SELECT DISTINCT consumer, symbol, field FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN consumers ON c_nationkey = n_nationkey JOIN parts ON l_partkey = p_partkey),
lots AS (SELECT DISTINCT s_suppkey, s_name AS family, s_nationkey, symbol, field FROM lineitem JOIN parts ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49),
offers AS (
  SELECT DISTINCT c.consumer, s.family, s.symbol, f.field FROM (SELECT DISTINCT s_suppkey, family, s_nationkey, symbol FROM lots) s
  JOIN (SELECT DISTINCT s_suppkey, field FROM lots) f USING (s_suppkey) JOIN consumers h ON h.n_nationkey = s.s_nationkey JOIN consumers c ON c.n_regionkey = h.n_regionkey),
covered AS (SELECT consumer, family, symbol, field FROM need JOIN offers USING (consumer, symbol, field))"""

SQL = {
    "trade_coverage": f"WITH {_BASE} SELECT * FROM covered",
    "trade_ownership": f"""WITH {_BASE},
      own AS (SELECT consumer, count(DISTINCT symbol || '|' || field) AS n, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM covered GROUP BY consumer)
      SELECT consumer, CASE WHEN consumer LIKE 'research:%' THEN 'research' ELSE 'runtime' END AS kind, count(*) AS required_count,
        coalesce(any_value(n), 0) AS covered_count, coalesce(any_value(families), '') AS families, coalesce(any_value(n), 0) = count(*) AS complete
      FROM need LEFT JOIN own USING (consumer) GROUP BY consumer""",
    "trade_runtime": f"""WITH {_BASE},
      r AS (SELECT DISTINCT c.consumer, family FROM lots JOIN consumers h ON h.n_nationkey = s_nationkey JOIN consumers c ON c.n_regionkey = h.n_regionkey)
      SELECT consumer, coalesce(string_agg(family, ',' ORDER BY family), '') AS families, count(family) AS family_count
      FROM (SELECT DISTINCT consumer FROM need WHERE consumer NOT LIKE 'research:%') LEFT JOIN r USING (consumer) GROUP BY consumer""",
    "trade_missing": f"WITH {_BASE} SELECT consumer, symbol, field FROM need WHERE (consumer, symbol, field) NOT IN (SELECT (consumer, symbol, field) FROM offers)",
}
