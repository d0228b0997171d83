"""Tables between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only up to so many rows.
MOST_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may leave it unset (tests): it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str = "t") -> str:
    """A path in the shared folder that is not there yet; what is written to it goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to a new table in the shared folder and read again; it goes when the session ends, or with release()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def tidy(spark: SparkSession) -> None:
    """Have the session delete each query's shuffle files when it ends: jobs of many written steps need them no longer. Jobs make this setting, operators don't."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, name: str = "ids") -> DataFrame:
    """df, written once, with a broadcast hint if its rows are few enough; else joins shuffle it."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df
