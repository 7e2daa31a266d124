"""Kernels over blocks of rows against plain loops: one series over many blocks, many series in one, and odd cases."""

import math

import numpy as np
import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from sextant.functions import blocks as B
from sextant.functions.kernels import Recursive, Series, prefix_ranks, with_recursive
from sextant.operators.joins import as_of_join
from sextant.plans.series import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WANTED = [
    Recursive("ema", "ema", "x", 5), Recursive("rsi", "wilder_rsi", "x", 4), Recursive("q", "rolling_quantile", "x", 9, 0.75, 3),
    Recursive("before", "rolling_quantile", "x", 6, 0.5, lag=1), Recursive("share", "trailing_percentile", "x", 7), Recursive("p", "expanding_percentile", "x"),
]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_twin(spark, name):
    names, got = rows_of(QUERIES[name](spark, SF).toPandas())
    wanted_names, wanted = rows_of(connect(SF).sql(SQL[name]).df())
    assert names == wanted_names
    assert got == wanted


def _series(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(None if k == 2 else f"s{k}", i * 3, float(x), "kept") for k, n in enumerate(lengths) for i, x in enumerate(rng.integers(0, 30, n))]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, t long, x double, other string")


@pytest.mark.parametrize("lengths", [[200], [0, 1, 70, 2, 16, 16, 5, 33], [1], [16, 16, 16], [5] * 40])
def test_blocks_equal_groups(spark, lengths):
    df = _series(spark, lengths)
    key = lambda r: (r.k or "", r.t)
    by_group = sorted(with_recursive(df, Series(("k",), "t"), WANTED).collect(), key=key)
    by_block = sorted(with_recursive(df, Series(("k",), "t", long=True), WANTED).collect(), key=key)
    assert len(by_group) == sum(lengths)
    for a, b in zip(by_group, by_block, strict=True):
        assert a.asDict().keys() == b.asDict().keys() and (a.k, a.t, a.x, a.other) == (b.k, b.t, b.x, b.other)
        for w in WANTED:
            assert (a[w.out] is None) == (b[w.out] is None)
            assert a[w.out] is None or a[w.out] == pytest.approx(b[w.out], abs=1e-9)


def test_groups_equal_loops(spark):
    rows = sorted(with_recursive(_series(spark, [60]), Series(("k",), "t"), WANTED).collect(), key=lambda r: r.t)
    x = [r.x for r in rows]
    for i, r in enumerate(rows):
        frame = lambda n, at=i: x[max(0, at - n + 1) : at + 1] if at >= 0 else []
        assert r.share == sum(v <= x[i] for v in frame(7)) / len(frame(7))
        assert r.p == sum(v <= x[i] for v in x[: i + 1]) / (i + 1)
        assert (r.q is None) == (i < 2) and (r.q is None or r.q == pytest.approx(np.quantile(frame(9), 0.75)))
        assert (r.before is None) == (i < 6) and (r.before is None or r.before == pytest.approx(np.quantile(frame(6, i - 1), 0.5)))


def test_nulls_and_empty_tables(spark):
    empty = _series(spark, [3]).limit(0)
    assert with_recursive(empty, Series(("k",), "t", long=True), WANTED).count() == 0
    holes = _series(spark, [50]).withColumn("x", F.when(F.col("t") % 4 > 0, F.col("x")))
    some = [w for w in WANTED if w.out in ("q", "share", "p")]
    a, b = (sorted(with_recursive(holes, Series(("k",), "t", long=l), some).collect(), key=lambda r: r.t) for l in (False, True))
    assert a == b and sum(r.p is None for r in a) == sum(r.x is None for r in a) > 0


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_as_of_over_blocks_equals_as_of_by_key(spark, keys):
    df = _series(spark, [90, 3, 40, 1, 25], 7)
    left = df.where("t % 2 = 0").withColumnRenamed("x", "l").withColumn("t", F.col("t") * 10 + F.when(F.col("k") == "s1", 1).otherwise(0))
    right = df.where("t % 5 < 2 and (k is null or k <> 's1')").select("k", (F.col("t") * 10).alias("t"), F.when(F.col("x") > 4, F.col("x")).alias("r"))
    if not keys:  # one key, so one row a time
        left, right = left.groupBy("t").agg(F.max("l").alias("l")), right.groupBy("t").agg(F.max("r").alias("r"))
    key = lambda r: tuple(str(v) for v in r)
    by_key = sorted(as_of_join(left, right, keys, "l", "r", order="t").collect(), key=key)
    by_block = sorted(as_of_join(left, right, keys, "l", "r", order="t", long=True).collect(), key=key)
    assert by_key == by_block and any(r.r is None for r in by_key) == bool(keys) and any(r.r is not None for r in by_key)


def test_earlier_smaller_equals_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 100):
        x = rng.permutation(n)
        assert B.earlier_smaller(x).tolist() == [int((x[:i] < v).sum()) for i, v in enumerate(x)]
        y = rng.integers(0, 5, n).astype(float)
        assert prefix_ranks(y).tolist() == [int((y[: i + 1] <= v).sum()) for i, v in enumerate(y)]


def test_blocks_spread_one_series(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 1 << 10)
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"))
    rows, count = B.placed(df, ["t"], "_place")
    assert count == n and rows.where("_place <> t").count() == 0
    sizes = [r["count"] for r in B.in_blocks(rows, "_place", B.block_size(n), n).groupBy("_block").count().collect()]
    assert len(sizes) == -(-n // 1024) and max(sizes) == 1024
    found = with_recursive(df, Series((), "t", long=True), [Recursive("ema", "ema", "x", 20)]).toPandas().sort_values("t")
    y, alpha = found["x"].iloc[0], 2 / 21
    for i, x in enumerate(found["x"]):
        y = y + (x - y) * alpha
        assert i % 5000 or i < 20 or math.isclose(y, found["ema"].iloc[i], rel_tol=1e-12)


def test_series_of_one_block_are_counted_there(spark, monkeypatch):
    """Only series that lie in several blocks are placed by value; every series has the shares of a plain count."""
    counted, over = [], B._over_blocks

    def recorded(rows, *rest):
        counted.append(rows.count())
        return over(rows, *rest)

    monkeypatch.setattr(B, "_over_blocks", recorded)
    rng = np.random.default_rng(7)
    lengths = [5] * 30 + [100] + [3] * 20
    rows = [(None if k == 4 else k, t, None if rng.random() < 0.1 else float(rng.integers(0, 6))) for k, n in enumerate(lengths) for t in range(n)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k long, t long, x double")
    got = {(r.k, r.t): (r.x, r.p) for r in B.with_expanding_percentile(df, ("k",), "t", "x", "p").collect()}
    assert len(got) == len(rows) and 100 <= sum(counted) <= 100 + 5 * (len(rows) // 16 + 1) < len(rows)
    for k, t, x in rows:
        before = [y for j, u, y in rows if j == k and u <= t and y is not None]
        assert got[k, t] == (x, None if x is None else sum(y <= x for y in before) / len(before))
