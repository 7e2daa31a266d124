"""Mixing sources to target weights by entropy balancing.

Each source s has a token target T_s. The document rates w are those nearest to 1 in
relative entropy, sum of w log w - w, that meet sum over the source of w_d * size_d =
T_s and w_d <= ``max_rate``. The solution is an exponential tilt,

    w_d = min(max_rate, exp(lambda_s * size_d / mean size of s)),

whose multipliers solve the convex dual. Newton iterations find them: each is one
distributed aggregation over a histogram of (source, size), with a bisection bracket
as safeguard. Rates are then rounded into copies along the histogram, from large sizes to
small, carrying the rounding error on, so a source misses its target by about half
its smallest documents.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import gapless_rank, table, written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = Fraction(3, 2)
MAX_RATE = 2
ITERATIONS = 30  #: Newton steps; where they don't end, the bracket is halved
MOST_STEPS = 300
TOLERANCE = 1e-9


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; null counts 0."""
    # Each word is replaced by one mark, and what lies between words by nothing.
    marks = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")
    return F.octet_length(marks).cast("long")


def water_fill(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: Fraction, max_rate: int) -> dict[str | None, float]:
    """Targets by source: ``share`` of all sizes dealt by weight, none above ``max_rate``
    times its source's size, the excess dealt again by weight among the others.

    Sources go by code point, null last; weights repeat in that order.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    cap = {name: max_rate * size for name, size in order}
    rest, open_ = Fraction(sum(size for _, size in order)) * share, dict.fromkeys(weight)
    targets: dict[str | None, Fraction] = {}
    while open_:
        level = rest / sum(weight[n] for n in open_)
        full = [n for n in open_ if weight[n] * level >= cap[n]]
        if not full:
            return {n: float(x) for n, x in (targets | {n: weight[n] * level for n in open_}).items()}
        for n in full:
            targets[n] = Fraction(cap[n])
            rest -= cap[n]
            del open_[n]
        rest = max(rest, Fraction(0))
    return {n: float(x) for n, x in targets.items()}


def solve_dual(histogram: DataFrame, targets: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, lam): multipliers of the tilt for each source of ``targets``
    (source, source_size, target, scale), by safeguarded Newton steps.

    ``histogram`` has (source, size, n). A source whose target needs every document at
    ``max_rate`` gets an infinite multiplier, one with target 0 minus infinity.
    """
    full = F.col("target") >= F.col("source_size") * max_rate
    none = F.col("target") <= 0
    fixed = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(float("inf"))).when(none, F.lit(float("-inf")))
    state = targets.select(
        "source", "target", "source_size", "scale",
        F.coalesce(fixed, F.lit(0.0)).alias("lam"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        fixed.isNotNull().alias("done"),
    )
    for turn in range(MOST_STEPS):
        joined = histogram.join(state.where(~F.col("done")), histogram["source"].eqNullSafe(state["source"])).drop(histogram["source"])
        z = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        mass = F.col("n") * F.col("size")
        sums = joined.groupBy("source").agg(
            F.sum(mass * F.least(rate, F.lit(float(max_rate)))).alias("got"),
            F.sum(F.when(rate < max_rate, mass * z * rate).otherwise(0.0)).alias("slope"),
        )
        s, g = state.alias("s"), sums.alias("g")
        gap = F.col("got") - F.col("s.target")
        low = F.when(gap < 0, F.col("s.lam")).otherwise(F.col("s.low"))
        high = F.when(gap >= 0, F.col("s.lam")).otherwise(F.col("s.high"))
        newton = F.when(F.col("slope") > 0, F.col("s.lam") - gap / F.col("slope"))
        inside = F.lit(turn < ITERATIONS) & newton.isNotNull() & (F.isnull(low) | (newton > low)) & (F.isnull(high) | (newton < high))
        # Without a usable Newton step: halve the bracket, or double the reach of its open side.
        middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(high.isNull(), F.abs(low) * 2 + 1).otherwise(-F.abs(high) * 2 - 1)
        met = F.abs(gap) <= F.greatest(F.col("s.target") * TOLERANCE, F.lit(1e-6))
        # A bracket as narrow as doubles allow has met its target as well as can be.
        met = met | F.coalesce(high - low <= F.greatest(F.abs(low), F.abs(high)) * 1e-15, F.lit(False))
        old = F.col("s.done")
        state = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "left").select(
            F.col("s.source").alias("source"), F.col("s.target").alias("target"), F.col("s.source_size").alias("source_size"), F.col("s.scale").alias("scale"),
            F.when(old | met, F.col("s.lam")).when(inside, newton).otherwise(middle).alias("lam"),
            F.when(old, F.col("s.low")).otherwise(low).alias("low"),
            F.when(old, F.col("s.high")).otherwise(high).alias("high"),
            (old | F.coalesce(met, F.lit(True))).alias("done"),
        )
        state = written(state.coalesce(1), "mixing-state")
        if not state.where(~F.col("done")).limit(1).count():
            return state.select("source", "lam")
    raise RuntimeError(f"multipliers not found in {MOST_STEPS} steps")


ROUND_SCHEMA = "source string, size long, n long, rate double, base long, extra long"


def round_rates(rates: DataFrame) -> DataFrame:
    """Copies along the histogram (source, size, n, rate, max_rate): every document of a
    (source, size) gets ``base`` copies and ``extra`` of them one more.

    One task handles the distinct sizes of a source, not its documents: a source of W
    words has at most sqrt(2 W) of those.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False)
        want, got, base, extra = 0.0, 0, [], []
        for size, n, rate, most in zip(part["size"], part["n"], part["rate"], part["max_rate"], strict=True):
            want += size * n * rate
            copies = min(max(round((want - got) / size), 0), int(most) * n) if size else 0
            got += copies * size
            base.append(copies // n)
            extra.append(copies % n)
        return part.assign(base=base, extra=extra)[["source", "size", "n", "rate", "base", "extra"]]

    return rates.groupBy("source").applyInPandas(run, ROUND_SCHEMA)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = TOTAL_SHARE,
    max_rate: int = MAX_RATE,
) -> DataFrame:
    """Per row: id, text_hash, size (words), source, source_size, target, rate, copies, taken.

    Null texts have size 0 and no copies' words; a null source is a source of its own.
    Repeated rows are dealt with row by row. Which documents of equal size and source
    get the extra copy goes by a salted hash order of their ids, so reruns agree. The list of sources
    (one row per source) is gathered on the driver; nothing per document is.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "mixing-sizes")
    histogram = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()
    targets = water_fill([(r.source, r["size"]) for r in totals], weights, share, max_rate)
    schema = T.StructType.fromDDL("source string, source_size long, target double, scale double")
    catalogue = spark.createDataFrame([(r.source, r["size"], targets[r.source], max(1.0, r["size"] / r.n)) for r in totals], schema)
    lam = solve_dual(histogram, catalogue, max_rate)
    c, m = catalogue.alias("c"), lam.alias("m")
    solved = c.join(m, F.col("c.source").eqNullSafe(F.col("m.source"))).select("c.*", "lam")
    h, s = histogram.alias("h"), solved.alias("s")
    tilt = F.exp(F.least(F.col("lam") * F.col("h.size") / F.col("scale"), F.lit(50.0)))
    rate = F.when(F.col("h.size") == 0, F.lit(0.0)).otherwise(F.least(tilt, F.lit(float(max_rate))))
    rates = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.source", "h.size", "n", rate.alias("rate"), F.lit(max_rate).alias("max_rate"))
    copies = written(round_rates(rates), "mixing-copies")
    apart = F.concat_ws(":", F.col(id_col).cast("string"), F.col("text_hash").cast("string"))
    ranked = gapless_rank(sized, ["source", "size"], [F.xxhash64(F.col(id_col)), F.col(id_col), F.col("text_hash")], apart, "_rank").alias("d")
    k = copies.withColumnsRenamed({"source": "k_source", "size": "k_size"})
    full = ranked.join(k, F.col("d.source").eqNullSafe(F.col("k_source")) & (F.col("d.size") == F.col("k_size")))
    n_copies = F.col("base") + F.when(F.col("_rank") < F.col("extra"), 1).otherwise(0)
    t = catalogue.select(F.col("source").alias("t_source"), "source_size", "target")
    return full.join(t, F.col("d.source").eqNullSafe(F.col("t_source"))).select(
        id_col, "d.text_hash", "d.size", "d.source", "source_size", "target", "rate", n_copies.alias("copies"), (F.col("d.size") * n_copies).alias("taken")
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows of one id, text and source are one document
    that comes as often as the mix takes all of them."""
    mixed = mix(docs, id_col, text_col, source_col)
    copies = mixed.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_h"), F.col("source").alias("_s"))
    copies = written(copies.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"), "mixing-taken")
    key = {"k_id": F.col(id_col), "k_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "k_s": F.col(source_col).cast("string")}
    hashed = docs.withColumns(key)
    same = F.col("k_id").eqNullSafe(F.col("_id")) & (F.col("k_h") == F.col("_h")) & F.col("k_s").eqNullSafe(F.col("_s"))
    taken = hashed.join(copies.where("_rows = 1"), same).select(*docs.columns, "_copies")
    if copies.where("_rows > 1").limit(1).count():
        repeated = hashed.join(copies.where("_rows > 1"), same).groupBy("k_id", "k_h", "k_s")
        once = repeated.agg(F.first(F.struct(*docs.columns)).alias("row"), F.first("_copies").alias("_copies"))
        taken = taken.union(once.select("row.*", "_copies"))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
