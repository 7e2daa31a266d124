"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[str] = []  #: paths alone: the package is pickled by value for tasks, and a session here would fail there


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only where none is set and the master is local, as
    in tests, one below /tmp is; on a cluster that would be each machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"/tmp/sextant-{spark.sparkContext.applicationId}"
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what follows never runs the jobs
    before again. The table goes when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/series/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for path in _kept:
        try:
            spark = SparkSession.active()
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and its folder is the cluster's to clear
            return
