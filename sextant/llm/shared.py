"""Helpers the operators of this subpackage share: reading, materialising, ranking."""

from __future__ import annotations

import atexit
import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: dict[str, SparkSession] = {}
HOT_ROWS = 10_000  #: rows of a key that one task of a join takes at most
MOST_HOT = 1000  #: keys that ``hot_keys`` returns at most; any other key has fewer than 1 in MOST_HOT rows
SLICE_BYTES = 8 << 20  #: of texts that a Python worker handles at once
MOST_BITMAP_BITS = 1 << 26  #: of a filter of members: 8 MB however many there are


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's Parquet table ``name`` below ``sf_dir`` (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where none is configured and the master is local, as in tests, one is set under
    /tmp; on a cluster that would be each machine's own, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"/tmp/sextant-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(configured)
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_written() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone; its folder goes with the cluster's
            return


atexit.register(_drop_written)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs re-reading files, never re-running
    the jobs before. Reading with the known schema needs no extra job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sextant/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan still to run reads."""
    for t in tables:
        if (path := getattr(t, "written_path", None)) in _written:
            _delete(path)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more: it does so
    when the driver collects garbage, which may be long after a large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def gapless_rank(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    salt_on: Column,
    out: str,
) -> DataFrame:
    """Number the rows of each group gaplessly from 0 in column ``out``.

    A group may hold any share of the rows, so no window sees a whole group: rows
    go to salted sub-groups (crc32 of ``salt_on``, which should tell rows apart), each is numbered by itself and
    starts after the counts of the sub-groups before it. With the square root of
    the row count as number of salts, both a sub-group and a group's list of
    counts stay near that root. Order within a group: salt, then ``order``.
    """
    salts = max(1, math.isqrt(df.count()))
    salted = df.withColumn("_salt", F.pmod(F.crc32(F.coalesce(salt_on.cast("string"), F.lit(""))), F.lit(salts)).cast("int"))
    # Each group column beside whether it is null: nulls are a group of their own, whatever texts say.
    parts = [(F.col(g).isNull(), F.coalesce(F.col(g).cast("string"), F.lit(""))) for g in groups]
    keys = [c.alias(f"_g{i}") for i, c in enumerate(x for part in parts for x in part)]
    names = [f"_g{i}" for i in range(len(keys))]
    salted = salted.select("*", *keys)
    counts = salted.groupBy(*names, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*names, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*names, "_salt").orderBy(*order)
    return (
        salted.withColumn("_row", F.row_number().over(within).cast("long") - 1)
        .join(starts, [*names, "_salt"])
        .withColumn(out, F.col("_start") + F.col("_row"))
        .drop(*names, "_salt", "_start", "_row")
    )


def hot_keys(rows: DataFrame, key: str) -> list[tuple[int, int]]:
    """(key, salts): the keys with more than HOT_ROWS rows, MOST_HOT of the most frequent at most."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    return [(r[key], -(-r["_n"] // HOT_ROWS)) for r in counts.orderBy(F.desc("_n"), key).limit(MOST_HOT).collect()]


def join_hot(rows: DataFrame, other: DataFrame, key: str, by: Column, hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """Inner join on ``key``, of which ``other`` has few rows a value. Rows of hot keys are
    dealt by the hash of ``by`` into as many salts as their count asks for, and the rows of
    ``other`` for them are repeated as often."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(other, key)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, _salts int"
    salts = F.broadcast(rows.sparkSession.createDataFrame(hot, schema))  # MOST_HOT rows at most
    n = F.coalesce("_salts", F.lit(1))
    left = rows.withColumn("_by", F.xxhash64(by)).join(salts, key, "left").withColumn("_salt", F.pmod("_by", n).cast("int")).drop("_salts", "_by")
    right = other.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts in ``column`` take SLICE_BYTES at most, or have one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


class Bitmap:
    """A filter of members' 64-bit hashes, 8 to 16 bits a member and MOST_BITMAP_BITS at most. When
    the members outgrow it, it lets more through that isn't one."""

    def __init__(self, members: DataFrame, column: str) -> None:
        spark = members.sparkSession
        self.bits = n = min(MOST_BITMAP_BITS, 1 << max(6, (8 * members.count()).bit_length()))
        slot = F.pmod(F.col(column), F.lit(n)).alias("slot")
        words = members.select(slot).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # bits / 64 rows at most
        bitmap = np.zeros(n // 64, np.int64)
        bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        self.shared = spark.sparkContext.broadcast(bitmap)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.int64) & np.int64(self.bits - 1)
        return (self.shared.value[at >> 6] >> (at & 63)) & 1 == 1


def with_members(df: DataFrame, members: DataFrame, hashed: Column) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``hashed`` is among those of ``members`` (one column), and a few
    besides; nothing is shuffled."""
    bitmap = Bitmap(members, members.columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.may_hold(batch.column(batch.num_columns - 1).to_numpy())))

    kept = df.withColumn("_hashed", hashed)
    return kept.mapInArrow(run, kept.schema).drop("_hashed")


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n shuffle partitions a number that ``repartition(n, column)`` sends there, so that
    as many blocks are dealt one to a partition."""
    tried = spark.range(n * (20 + n.bit_length()), numPartitions=min(n, 64)).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k"))
    found = {r.p: r.k for r in tried.collect()}  # n rows
    return [found.get(p, p) for p in range(n)]
