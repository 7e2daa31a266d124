"""Kernels over series of any length: a single series may hold all rows.

Rows are placed by a range exchange on (keys, order), so the place of each is exact, and places are cut into blocks of
equal size, whatever series their rows are of. What a block needs from before it comes in one of three ways:

* a halo: the rows before the block that frames reach back to are sent to it too;
* a carry: a block composes its rows' recursion y -> a * y + b to one such map; the maps, a row a block, are scanned
  on the driver, which gives the value each block starts from;
* counts: how many rows before a block fall into each range of values, from one aggregation.

A block has BLOCK_ROWS rows, or more where that would make over MOST_BLOCKS of them, so what the driver scans is
bounded whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

BLOCK_ROWS = 1 << 14
MOST_BLOCKS = 2000


def block_size(count: int) -> int:
    return max(BLOCK_ROWS, -(-count // MOST_BLOCKS))


def placed(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """``df`` with the place of each row, from 0 without gaps, in the order of the columns; and the number of rows.

    The rows are stored once sorted, so places don't change when a task runs again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("_at", 33)
    sizes = sorted((r.p, r.m) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("m")).collect())  # a row a partition
    starts, count = [], 0
    for p, m in sizes:
        starts.append((p, count))
        count += m
    table = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))  # as many rows as partitions
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumn("_p", part).join(table, "_p").withColumn(out, F.col("_start") + within)
    return numbered.drop("_p", "_start", "_at"), count


def in_blocks(rows: DataFrame, place: str, size: int, count: int, halo: int = 0) -> DataFrame:
    """``rows`` with ``_block``; a row within ``halo`` places before a block is repeated for it."""
    at = F.expr(f"{place} div {size}L")
    last = F.expr(f"least({place} + {halo}L, {max(count - 1, 0)}L) div {size}L")
    return rows.withColumn("_block", F.explode(F.sequence(at, last)) if halo else at)


def series_of(part: pd.DataFrame, keys: tuple[str, ...]) -> np.ndarray:
    """Where the rows' series changes: a number for each run of rows of equal keys; nulls equal each other."""
    change = np.zeros(len(part), bool)
    for k in keys:
        codes = pd.factorize(part[k], use_na_sentinel=False)[0]
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


@dataclass(frozen=True)
class Step:
    """A kernel over blocks.

    ``reach``: rows before a block that it looks at. ``direct(x)``: values over a series from its first row on.
    ``last(x, own)`` and ``after(x, own, state)`` see the rows of a series that began earlier, own ones from ``own`` on: the
    first gives the factor and the offsets that the block applies to the state, the second the own rows' values.
    ``state(x)``: the state after a series' rows from its first on. Kernels of the halo alone have none of these three.
    """

    column: str
    out: str
    reach: int
    direct: Callable[[np.ndarray], np.ndarray]
    last: Callable[[np.ndarray, int], tuple[float, list[float]]] | None = None
    after: Callable[[np.ndarray, int, np.ndarray], np.ndarray] | None = None
    state: Callable[[np.ndarray], list[float]] | None = None
    width: int = 0  #: numbers of the state


def _runs(part: pd.DataFrame, keys: tuple[str, ...], first: int) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of each series that has own rows, those from index ``first`` on; whole: its first row is seen."""
    number = series_of(part, keys)
    edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
    begun = int(part["_place"].iloc[0]) > 0
    return [(int(a), int(b), bool(a > 0 or not begun)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > first]


def with_steps(df: DataFrame, keys: tuple[str, ...], order: str, steps: list[Step]) -> DataFrame:
    """``df`` with the kernels' columns, computed block by block."""
    rows, count = placed(df, [*keys, order], "_place")
    size = block_size(count)
    reach = max(1, *(s.reach for s in steps))
    carried = [s for s in steps if s.width]
    carries: dict[int, np.ndarray] = {}
    if carried:
        needed = rows.select(*dict.fromkeys([*keys, "_place", *(s.column for s in carried)]))
        carries = _carries(in_blocks(needed, "_place", size, count, reach), keys, size, carried)
    shared = df.sparkSession.sparkContext.broadcast(carries)  # MOST_BLOCKS entries at most
    schema = T.StructType([*df.schema.fields, *(T.StructField(s.out, T.DoubleType()) for s in steps)])
    names = [f.name for f in schema.fields]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place", kind="stable")
        block = int(part["_block"].iloc[0])
        first = int(np.searchsorted(part["_place"].to_numpy(), block * size))
        runs = _runs(part, keys, first)
        state = shared.value.get(block - 1)
        for s in steps:
            x, out = part[s.column].to_numpy(float), np.full(len(part), np.nan)
            at = sum(c.width for c in carried[: carried.index(s)]) if s in carried else 0
            for a, b, whole in runs:
                own = max(first, a)
                if whole or not s.width:
                    out[own:b] = s.direct(x[a:b])[own - a :]
                else:
                    out[own:b] = s.after(x[a:b], own - a, state[at : at + s.width])
            part[s.out] = out
        return part.iloc[first:][names]

    return in_blocks(rows, "_place", size, count, reach).groupBy("_block").applyInPandas(run, schema)


def _carries(blocks: DataFrame, keys: tuple[str, ...], size: int, steps: list[Step]) -> dict[int, np.ndarray]:
    """For each block the states of the series of its last row after that row."""

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place", kind="stable")
        block = int(part["_block"].iloc[0])
        first = int(np.searchsorted(part["_place"].to_numpy(), block * size))
        a, b, whole = _runs(part, keys, first)[-1]
        factors, offsets = [], []
        for s in steps:
            x = part[s.column].to_numpy(float)[a:b]
            factor, found = (0.0, s.state(x)) if whole else s.last(x, max(first, a) - a)
            factors += [factor] * s.width
            offsets += found
        return pd.DataFrame({"block": [block], "a": [factors], "b": [offsets]})

    maps = blocks.groupBy("_block").applyInPandas(summarise, "block long, a array<double>, b array<double>").toPandas()
    state, found = np.zeros(sum(s.width for s in steps)), {}
    for block, a, b in sorted(zip(maps["block"], maps["a"], maps["b"], strict=True), key=lambda r: r[0]):
        state = np.where(np.asarray(a) == 0.0, 0.0, np.asarray(a) * state) + np.asarray(b)
        found[int(block)] = state
    return found


# ---- ranks among all rows before


def earlier_smaller(x: np.ndarray) -> np.ndarray:
    """For each of distinct values how many before it are smaller: halves of ever larger blocks are merged."""
    n = len(x)
    rank = np.empty(n, np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(n)
    count, width = np.zeros(n, np.int64), 1
    by_value = np.argsort(rank)
    while width < n:
        # Within each pair of halves, by value: a value of the right half counts those of the left before it.
        order = by_value[np.argsort(by_value // (2 * width), kind="stable")]
        left = (order // width) % 2 == 0
        lefts = np.cumsum(left)
        pair = order // (2 * width)
        start = np.searchsorted(pair, pair)
        before = np.where(start > 0, lefts[start - 1], 0)
        count[order] += np.where(left, 0, lefts - before)
        width *= 2
    return count


def with_expanding_percentile(df: DataFrame, keys: tuple[str, ...], order: str, column: str, out: str) -> DataFrame:
    """``df`` with the share of a series' values so far that don't exceed the current one; nulls have no share and don't count.

    Rows are placed by (keys, order). A series that lies in one block of places is counted there. Only the others, one at each
    edge of a block, are placed by value too and counted over blocks of both places.
    """
    rows, count = placed(df.withColumn("_known", F.col(column).isNotNull()), [*keys, order], "_place")
    size = block_size(count)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema.fields]
    if not keys and count > size:
        return _over_blocks(rows.select(*df.columns), keys, order, column, out)
    crossed, series = _crossing(rows, keys, size)
    edges = df.sparkSession.sparkContext.broadcast(crossed)  # MOST_BLOCKS entries at most

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place", kind="stable")
        block, number = int(part["_block"].iloc[0]), series_of(part, keys)
        inside = np.ones(len(part), bool)
        if block in edges.value:
            inside &= number != number[0]
        if block + 1 in edges.value:
            inside &= number != number[-1]
        part, number = part[inside], number[inside]
        known = part["_known"].to_numpy(bool)
        share = np.full(len(part), np.nan)
        share[known] = _shares(part[column].to_numpy(float)[known], number[known])
        return part.assign(**{out: share})[names]

    found = in_blocks(rows, "_place", size, count).groupBy("_block").applyInPandas(whole, schema)
    if not series:
        return found
    table = F.broadcast(df.sparkSession.createDataFrame(series, T.StructType([df.schema[k] for k in keys])))  # MOST_BLOCKS rows at most
    same = [rows[k].eqNullSafe(table[k]) for k in keys]
    return found.unionByName(_over_blocks(rows.join(table, same, "left_semi").select(*df.columns), keys, order, column, out))


def _crossing(rows: DataFrame, keys: tuple[str, ...], size: int) -> tuple[set[int], list[tuple]]:
    """The blocks whose first row is of the series of the row before, and those series."""
    at = F.expr(f"_place % {size}L")
    ends = {r._place: tuple(r[k] for k in keys) for r in rows.where((at == 0) | (at == size - 1)).select("_place", *keys).collect()}  # two rows a block
    crossed = {place // size for place, key in ends.items() if place and place % size == 0 and ends[place - 1] == key}
    return crossed, list({ends[b * size] for b in crossed})


def _shares(x: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each value the share of those so far in its run of equal ``number`` that don't exceed it."""
    if not len(x):
        return np.zeros(0)
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((x, number))] = np.arange(len(x))  # stable: of equal values the later one ranks higher
    start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    start = np.repeat(start, np.diff(np.append(start, len(x))))
    # Rows of earlier runs come before in both orders, so they are all among those counted.
    return (earlier_smaller(rank) + 1 - start) / (np.arange(len(x)) + 1 - start)


def _over_blocks(rows: DataFrame, keys: tuple[str, ...], order: str, column: str, out: str) -> DataFrame:
    """``rows`` with shares of series of any length.

    Every row has a place by (keys, order) and one by (keys, value, order). The values up to a row that don't exceed its own
    are the rows before it in both places. Blocks of the two places form cells: whole cells before the
    row's in both come from a table of counts, MOST_BLOCKS^2 at most; rows of its block of values in earlier blocks of
    time, and rows of its own block of time, are counted exactly in two passes over equal blocks.
    """
    known, count = placed(rows.where(F.col(column).isNotNull()), [*keys, order], "_place")
    ranked, _ = placed(known, [*keys, column, "_place"], "_rank")
    size = block_size(count)
    ranked = ranked.withColumns({"_time": F.expr(f"_place div {size}L"), "_band": F.expr(f"_rank div {size}L")})
    blocks = -(-count // size)
    cells = np.zeros((blocks + 1, blocks + 1), np.int64)
    for r in ranked.groupBy("_time", "_band").agg(F.count(F.lit(1)).alias("m")).collect():  # MOST_BLOCKS^2 at most
        cells[r._time + 1, r._band + 1] = r.m
    shared = rows.sparkSession.sparkContext.broadcast(cells.cumsum(0).cumsum(1))
    counted = T.StructType([*ranked.schema.fields, T.StructField("_less", T.LongType())])

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_rank", kind="stable")
        time, n = part["_time"].to_numpy(), len(part)
        whole = shared.value[time, int(part["_band"].iloc[0])]
        # Of equal blocks of time, later rows get smaller numbers, so they don't count here.
        return part.assign(_less=whole + earlier_smaller(time * n + np.arange(n - 1, -1, -1)))

    less = ranked.groupBy("_band").applyInPandas(across, counted)
    starts = _series_starts(ranked, keys)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema.fields]
    begun = rows.sparkSession.sparkContext.broadcast(starts)  # MOST_BLOCKS entries at most

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place", kind="stable")
        place, number = part["_place"].to_numpy(), series_of(part, keys)
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        start = place[first]
        start[0] = begun.value[int(part["_time"].iloc[0])]
        start = start[number]
        # Rows of earlier series lie before in both places, so they are all among those counted.
        upto = part["_less"].to_numpy() + earlier_smaller(part["_rank"].to_numpy()) + 1 - start
        return part.assign(**{out: upto / (place - start + 1)})[names]

    found = less.groupBy("_time").applyInPandas(within, schema)
    return found.unionByName(rows.where(F.col(column).isNull()).withColumn(out, F.lit(None).cast("double")))


def _series_starts(rows: DataFrame, keys: tuple[str, ...]) -> dict[int, int]:
    """For each block of time the place at which the series of its first row begins."""
    key = F.struct(*keys) if keys else F.lit(0)
    ends = rows.groupBy("_time").agg(
        F.min("_place").alias("low"), F.min_by(key, "_place").alias("first"), F.max_by(key, "_place").alias("last")
    )
    begins = rows.groupBy("_time", *keys).agg(F.min("_place").alias("b")).groupBy("_time").agg(F.max("b").alias("latest"))
    found, start, before = {}, 0, None
    for r in sorted(ends.join(begins, "_time").collect(), key=lambda r: r._time):  # a row a block
        same = before is not None and r.first == before.last
        found[r._time] = start if same else r.low
        # The last series of the block began in it, unless it is the first one too.
        start = found[r._time] if r.first == r.last else r.latest
        before = r
    return found
