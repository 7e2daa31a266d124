"""Whitening of embeddings by upper-triangle column aggregates.

A vector's entries become whole numbers, floor(scale * entry), so that sums and deviations are exact. The fit
list holds each distinct vector once. One aggregation sums its columns; the next sums the centred
products of every dimension pair, one generated SQL expression a pair, so that a task keeps one row of
sums however many vectors it reads. The driver gets that row (d (d + 1) / 2 doubles), assembles the covariance and has
LAPACK decompose it. Projections onto the components are generated SQL expressions too.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, table, written

SCALE = 256
LARGEST = 1 << 61  #: scaled entries are held within +- this
PAIRS_PER_PASS = 4096  #: generated sums of one aggregation; more dimension pairs take several
LEAST_VARIANCE = 1e-11  #: eigenvalues at or below this share of the largest count as 0


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` distinct vectors with column ``sums``; column i of ``components`` is the
    unit eigenvector of ``variances[i]``, which fall. ``farthest``: the largest |n * x - sum| of each column."""

    n: int
    sums: tuple[int, ...]
    farthest: tuple[int, ...]
    variances: np.ndarray
    components: np.ndarray
    identity_error: float | None = None

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def usable(self, i: int) -> bool:
        """Whether component i has a variance to divide by."""
        return bool(self.variances[i] > LEAST_VARIANCE * max(self.variances[0], 0.0))

    def explained(self, i: int) -> float | None:
        total = float(self.variances.sum())
        return float(self.variances[i]) / total if total > 0 else None


def _dimensions(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length, the least on ties; 0 for an empty table."""
    sizes = vectors.groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("m"))
    first = sizes.orderBy(F.desc("m"), "d").first()
    return first.d if first else 0


def scaled(df: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """The rows of ``df`` with a whole finite vector of the table's length, and that vector's whole
    numbers in ``_x`` (array of long)."""
    odd = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~odd)
    limit = F.lit(float(LARGEST))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, limit), -limit))
    return rows.where(F.size(vec_col) == _dimensions(rows, vec_col)).withColumn("_x", F.transform(vec_col, whole))


def _total(terms: list[str]) -> str:
    """SQL sum of the terms as a balanced tree, so that many dimensions don't nest deep."""
    while len(terms) > 1:
        terms = [f"({a} + {b})" for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0]


def _centred(n: int, sums: tuple[int, ...]) -> list[str]:
    """SQL of x - sum / n for each entry: the whole part is taken off exactly, before the cast. ``get`` gives NULL beyond
    the end, as Spark may evaluate this for rows that a filter is about to drop."""
    return [f"(CAST(get(_x, {i}) - {s // n}L AS DOUBLE) - {(s % n) / n!r}D)" for i, s in enumerate(sums)]


def _covariance(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    d = len(sums)
    centred = fit.selectExpr(*(f"{c} AS c{i}" for i, c in enumerate(_centred(n, sums))))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = np.zeros((d, d))
    for low in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[low : low + PAIRS_PER_PASS]
        row = centred.selectExpr(*(f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in part)).collect()[0]
        for (i, j), x in zip(part, row, strict=True):
            v[i, j] = v[j, i] = x / n
    return v


def fit_whitening(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of the distinct ``_x`` of ``rows`` (see ``scaled``), and how far the covariance of its first
    ``components`` lies from the identity. None for an empty table."""
    fit = written(rows.select("_x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        discard(fit)
        return None
    d = len(first[0])
    columns = [f"{f}(get(_x, {i})) AS {f}_{i}" for f in ("try_sum", "min", "max") for i in range(d)]
    found = fit.selectExpr("count(*) AS n", *columns).collect()[0]
    n = found.n
    sums = tuple(found[f"try_sum_{i}"] for i in range(d))
    if None in sums:  # beyond 64 bits
        exact = fit.selectExpr(*(f"sum(CAST(get(_x, {i}) AS DECIMAL(20, 0))) AS s{i}" for i in range(d))).collect()[0]
        sums = tuple(int(s) for s in exact)
    farthest = tuple(max(n * found[f"max_{i}"] - sums[i], sums[i] - n * found[f"min_{i}"]) for i in range(d))
    values, vectors = np.linalg.eigh(_covariance(fit, n, sums))
    model = Whitening(n, sums, farthest, values[::-1].clip(0.0), vectors[:, ::-1])
    used = [i for i in range(min(components, d)) if model.usable(i)]
    if used:
        values = fit.selectExpr(*(f"{_projected(model, i)} AS w{i}" for i in used))
        pairs = [(i, j) for i in used for j in used if i <= j]
        row = values.selectExpr(*(f"covar_pop(w{i}, w{j}) AS p{i}_{j}" for i, j in pairs)).collect()[0]
        model = replace(model, identity_error=max(abs(x - (i == j)) for (i, j), x in zip(pairs, row, strict=True)))
    discard(fit)
    return model


def _projected(model: Whitening, i: int) -> str:
    """SQL of the whitened value of component i; NULL without a variance."""
    if not model.usable(i):
        return "CAST(NULL AS DOUBLE)"
    terms = [f"{c} * {float(v)!r}D" for c, v in zip(_centred(model.n, model.sums), model.components[:, i], strict=True)]
    return f"{_total(terms)} / {float(np.sqrt(model.variances[i]))!r}D"


def _deviation(model: Whitening) -> Column:
    """sum of (n * x - sum)^2 over the entries, exact: a long if all of them fit, else decimal(38,0), else NULL."""
    most = sum(f * f for f in model.farthest)
    if most >= 10**38:
        return F.lit(None).cast("decimal(38,0)")
    whole = (lambda t: t) if most < 1 << 63 else (lambda t: f"CAST({t} AS DECIMAL(38,0))")
    number = (lambda v: f"{v}L") if most < 1 << 63 else (lambda v: f"CAST('{v}' AS DECIMAL(38,0))")
    parts = [f"({whole(f'get(_x, {i})')} * {number(model.n)} - {number(s)})" for i, s in enumerate(model.sums)]
    return F.expr(_total([f"CAST({p} * {p} AS {'BIGINT' if most < 1 << 63 else 'DECIMAL(38,0)'})" for p in parts]))


def whiten(df: DataFrame, vec_col: str, components: int, scale: int = SCALE) -> tuple[DataFrame, Whitening | None]:
    """``df`` without the rows that can't be whitened, with ``whitened`` (array of double, an entry a component)
    and ``deviation``; and the whitening, fitted on the same rows.

    Rows whose vector is null, empty, holds null or non-finite entries, or has another length than most rows, are
    dropped. Equal vectors count once in the fit and get equal values. A component without variance (all vectors
    equal, or fewer directions than asked for) has null values; a table of fewer dimensions has fewer components. An empty
    table gives an empty result and no whitening. Other columns are kept; of the names ``whitened`` and ``deviation`` the new ones are.
    """
    rows = scaled(df, vec_col, scale)
    model = fit_whitening(rows, components)
    if model is None:
        return rows.drop("_x").withColumns({"whitened": F.array().cast("array<double>"), "deviation": F.lit(0).cast("long")}), None
    values = F.array(*(F.expr(_projected(model, i)) for i in range(min(components, model.dimensions))))
    return rows.withColumns({"whitened": values, "deviation": _deviation(model)}).drop("_x"), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and each of the first 4 components; ``deviation`` is null beyond a long."""
    rows, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    shown = range(min(4, model.dimensions)) if model else range(0)
    shares = F.array(*(F.lit(model.explained(i)).cast("double") for i in shown)).cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


#: The exact columns of op11.
DEVIATION_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
fit AS (SELECT DISTINCT x FROM vectors),
sums AS (SELECT i, sum(x[i + 1]) AS s FROM fit, (SELECT unnest(range(64)) AS i) GROUP BY i),
size AS (SELECT count(*) AS n FROM fit),
deviations AS (
  SELECT rowid_ AS r, any_value(vec_id) AS vec_id, any_value(n) AS n, sum((n * x[i + 1] - s) * (n * x[i + 1] - s))::BIGINT AS deviation
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM vectors), sums, size GROUP BY rowid_)
SELECT vec_id, component::INTEGER AS component, n, deviation FROM deviations, (SELECT unnest([1, 2, 3, 4]) AS component)
"""
