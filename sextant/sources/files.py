"""Files: CSV sources of daily series, hashes, and their provenance."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import ORDER, ohlcv
from ..storage import shared_dir

CHUNK = 1 << 20


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of many files, hashed on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV at any path that Spark reads."""
    if "://" not in str(path):
        with open(path, newline="", encoding="utf-8") as f:
            return next(csv.reader(f), [])
    return next(csv.reader([r.value for r in spark.read.text(str(path)).limit(1).collect()]), [])


def read_many(spark: SparkSession, path: str, columns: dict[str, str], format: str = "csv", order: str | None = None) -> DataFrame:
    """Rows of many series in any number of files (CSV with headers, Parquet, or a table's name with format ``table``), as
    text plus the row's position, under the names of ``columns`` (name: source column).

    Files are split over tasks. The position is the column ``order`` if given, otherwise path, block and line, so
    that of equal days the later line still wins.
    """
    raw = spark.read.table(path) if format == "table" else spark.read.option("header", True).format(format).load(path)
    if missing := [c for c in columns.values() if c not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    if order is None and format == "table":
        raise ValueError("a table has no lines; give its order column")
    kept = [F.col(f"`{source}`").cast("string").alias(name) for name, source in columns.items()]
    line = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # counts on within a task, blocks of a file in turn
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", line.alias("line")) if order is None else F.col(f"`{order}`")
    return raw.select(*kept, at.alias(ORDER))


def read_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text plus the row's position, under the names of ``columns`` (name: source column).

    A small file, one series: the position is the order of the lines of a single partition.
    A required column that is missing is an error before anything runs.
    """
    header = csv_header(spark, path)
    columns = columns or {c: c for c in header}
    if missing := [columns[c] for c in required if columns[c] not in header]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE").coalesce(1)
    kept = [F.col(f"`{source}`").alias(name) for name, source in columns.items() if source in header]
    return rows.select(*kept, F.monotonically_increasing_id().alias(ORDER))


def load_ohlcv(
    spark: SparkSession, path: str, symbol: str, columns: dict[str, str] | None = None, as_of: str | None = None
) -> DataFrame:
    """One symbol's normalised rows of a CSV; an empty result is an error."""
    names = {c: c for c in ("date", "close", "high", "low", "volume")} | (columns or {})
    raw = read_csv(spark, path, names, ("date", "close")).withColumn("symbol", F.lit(symbol))
    rows = ohlcv(raw, as_of, strict=True)
    if rows.isEmpty():
        raise ValueError(f"{path} has no usable rows")
    return rows


@dataclass(frozen=True)
class Provenance:
    provider: str
    provider_dataset: str
    provider_timestamp: str
    raw_artifact_sha256: str
    license_scope: str
    path: str


def csv_provenance(path: str, as_of: str, provider: str = "local_csv", dataset: str = "btc_usd_daily_ohlcv", license_scope: str = "internal_runtime") -> Provenance:
    for name, value in (("as_of", as_of), ("provider", provider), ("provider_dataset", dataset), ("license_scope", license_scope)):
        if not value or not value.strip():
            raise ValueError(f"{name} must not be empty")
    return Provenance(provider, dataset, f"{as_of[:10]}T00:00:00Z", sha256_file(path), license_scope, str(path))


def resolve_as_of(path: str, requested: str | None, yesterday: str) -> str:
    """The requested day (or yesterday) if the file has it, otherwise its last date."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    days = read_csv(spark, path, {"date": "date"}, ("date",)).where("date <> ''")
    day = requested or yesterday
    found = days.agg(F.max_by("date", ORDER).alias("last"), F.bool_or(F.col("date") == day).alias("has")).first()
    if found.last is None:
        raise ValueError(f"{path} has no dates")
    return day if found.has else found.last


def write_csv(frame: DataFrame, path: str) -> tuple[int, list[str]]:
    """One CSV file with header, sorted by date, at a local or any Hadoop path. Returns rows and columns.

    Tasks write parts of ranges of dates to the shared folder; the parts are then joined in order as streams, so the
    driver never holds rows. The file appears whole: it is renamed once it is written.
    """
    spark = frame.sparkSession
    seen = Observation()
    parts = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    frame.orderBy("date").observe(seen, F.count(F.lit(1)).alias("n")).write.csv(parts, header=False, nullValue="", emptyValue='""')
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop, remote = jvm.org.apache.hadoop.fs.Path, "://" in str(path)
    source = hadoop(parts).getFileSystem(conf)
    names = sorted(str(f.getPath()) for f in source.listStatus(hadoop(parts)) if f.getPath().getName().startswith("part-"))
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(frame.columns)
    half = f"{path}.{uuid.uuid4().hex}"
    if remote:
        target = hadoop(str(path)).getFileSystem(conf)
        out = target.create(hadoop(half), True)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        out = jvm.java.io.FileOutputStream(half)
    try:
        out.write(header.getvalue().encode())
        for name in names:
            part = source.open(hadoop(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    if remote:
        target.delete(hadoop(str(path)), False)
        target.rename(hadoop(half), hadoop(str(path)))
    else:
        os.replace(half, path)
    source.delete(hadoop(parts), True)
    return int(seen.get["n"]), list(frame.columns)


def csv_shape(path: str) -> tuple[list[str], int, str, str]:
    """(columns, rows, first date, last date) of a CSV in file order, read by many tasks."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    columns = csv_header(spark, path)
    if not columns:
        return [], 0, "", ""
    day = "date" if "date" in columns else columns[0]
    at = F.col(ORDER)
    rows = read_many(spark, str(path), {"day": day}).agg(F.count(F.lit(1)).alias("n"), F.min_by("day", at).alias("a"), F.max_by("day", at).alias("b")).first()
    return columns, rows.n, rows.a or "", rows.b or ""
