"""Scratch tables in the shared folder, hash folds, joins with hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of a table's rows is hot; so there are at most its inverse.
HOT_SHARE = 0.01


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may leave it unset (tests): it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to a new table in the shared folder and read it: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hold the session's Arrow batches to `rows` rows: 10,000 long texts take hundreds of MB on both sides.

    A setting of the session, so jobs make it (the queries and the pipeline do) and operators don't.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(col: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def text_hash(text_col: str = "text"):
    """A 64-bit hash of a text; null texts have one of their own."""
    return F.xxhash64(F.col(text_col), F.col(text_col).isNull())


def hot_keys(df: DataFrame, on: str, total: int | None = None, share: float = HOT_SHARE) -> list:
    """Keys with more than `share` of df's rows, 1 / share at most."""
    total = df.count() if total is None else total
    n = df.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, total * share)).where(F.col(on).isNotNull())
    return [r[on] for r in n.collect()]


def skew_join(left: DataFrame, right: DataFrame, on: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key. Rows of hot keys stay where they are: their few rows of right are broadcast."""
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right, on, how).unionByName(left.where(is_hot).join(F.broadcast(right.where(F.col(on).isin(hot))), on, how))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: (node, root), root the least node reachable; roots have no row.

    Alternates large-star and small-star until no edge changes; every round is cut into the
    shared folder. A node of high degree meets its neighbours through a partial aggregate and a
    join that leaves hot nodes' edges where they are.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "cc")
    n = e.count()
    for _ in range(max_rounds if n else 1):
        if not n:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = skew_join(both, least, "u", hot_keys(both, "u", 2 * n)).where("v > u")
        large = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            skew_join(large, low, "u", hot_keys(large, "u", n))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.*").where("u <> v").distinct()
        )
        new = cut(small, "cc")
        m = new.count()
        same = m == n and new.join(e, ["u", "v"], "left_anti").isEmpty()
        drop(e)
        drop(large)
        e, n = new, m
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
