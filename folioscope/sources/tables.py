"""Reading raw pages and artefact tables, writing artefacts."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.sources.scratch import bounded


def read_raw(spark: SparkSession, path: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(document_id, url, html, size_bytes) from a Parquet table of pages."""
    rows = spark.read.parquet(path)
    url = F.col("url") if "url" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col(id_col).cast("string").alias("document_id"), url.alias("url"), F.col(html_col).alias("html"), F.octet_length(html_col).cast("long").alias("size_bytes"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, url, html, size_bytes) from a folder of HTML files, decoded as UTF-8."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("document_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"), F.col("length").alias("size_bytes"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artefact with a fixed schema: Parquet, or JSON arrays where the path ends in .json; empty if missing.

    A JSON file that is cut off, or holds a value of another type, stops the job that reads it;
    read_checked() sets such records apart instead.
    """
    names = spark.createDataFrame([], schema).columns
    try:
        if path.endswith(".json"):
            return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(names)
        return spark.read.schema(schema).parquet(path).select(names)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_checked(spark: SparkSession, path: str, schema: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged) of JSON artefacts: rows with the schema's columns, and (file, entry, record, problem) of what isn't one.

    whole: a file is one array of records; else each of its lines is one, so that a large file is read
    by many tasks. `cut off`: an array that doesn't end or is no array (entry -1); none of its records is a
    row. `wrong type`: an object with a value that is not of its column's type. `no object`: any other entry. Missing
    fields are null. Both tables read the files, so cut() them to read once; empty files have neither. A missing path is an error.
    """
    struct = spark.createDataFrame([], schema).schema
    bad = next(n for n in ("_bad", "__bad", "___bad") if n not in struct.names)
    lines = spark.read.text(path, wholetext=whole).select(F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value")).where("value <> ''")
    # an array of texts keeps every entry as it stands; one that is cut off is null as a whole
    entries = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>"))
    rows = lines.withColumn("entries", entries)
    broken = rows.where("entries is null").select("file", F.lit(-1).alias("entry"), F.col("value").alias("record"), F.lit("cut off").alias("problem"))
    each = rows.where("entries is not null").select("file", F.posexplode("entries").alias("entry", "record"))
    parsed = each.withColumn("row", F.from_json("record", struct.add(bad, "string"), {"columnNameOfCorruptRecord": bad}))
    problem = F.when(~F.coalesce(F.col("record").rlike(r"^\{"), F.lit(False)), "no object").when(F.col(f"row.{bad}").isNotNull(), "wrong type")
    parsed = parsed.withColumn("problem", problem)
    good = parsed.where("problem is null").select([F.col(f"row.`{n}`").alias(n) for n in struct.names if n != bad])
    return good, broken.unionByName(parsed.where("problem is not null").select("file", "entry", "record", "problem"))


def bucket_of(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def write_artifacts(tables: dict[str, DataFrame], path: str, buckets: int = 0, reviewed: tuple[str, ...] = ()) -> None:
    """Each table to its own Parquet folder, overwritten; tables named in `reviewed` are people's and never written.

    With buckets, tables that have a document_id are partitioned by a hash bucket of it. For runs that
    hold only some of the documents there is merge_artifacts().
    """
    for name, df in tables.items():
        if name in reviewed:
            continue
        if buckets and "document_id" in df.columns:
            df.withColumn("bucket", bucket_of(F.col("document_id"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _register(tables: dict[str, DataFrame], path: str, buckets: int, spark: SparkSession) -> None:
    """Keep each table's columns and the number of buckets with the store: an empty table has no file that tells them."""
    have = _registered(spark, path)
    shape = lambda n, schema: (n, [(f.name, f.dataType.simpleString()) for f in schema])
    for name, df in tables.items():
        if name in have and shape(*have[name]) != shape(buckets, df.schema):
            raise ValueError(f"{name} at {path} has buckets and columns {shape(*have[name])}, not {shape(buckets, df.schema)}")
    if set(tables) - set(have):
        rows = [(n, k, s.json()) for n, (k, s) in (have | {n: (buckets, df.schema) for n, df in tables.items()}).items()]
        spark.createDataFrame(rows, "name string, buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_tables")


def _registered(spark: SparkSession, path: str) -> dict[str, tuple[int, StructType]]:
    if not there(spark, f"{path}/_tables"):
        return {}
    return {r["name"]: (r["buckets"], StructType.fromJson(json.loads(r["columns"]))) for r in spark.read.schema("name string, buckets int, columns string").parquet(f"{path}/_tables").collect()}


def stored_artifacts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that merge_artifacts keeps at path, with their columns, empty ones too."""
    return {n: spark.read.schema(c).parquet(f"{path}/{n}") if there(spark, f"{path}/{n}") else spark.createDataFrame([], c) for n, (_, c) in _registered(spark, path).items()}


def merge_artifacts(tables: dict[str, DataFrame], path: str, replaced: DataFrame, buckets: int = 64, reviewed: tuple[str, ...] = ()) -> list[int]:
    """Write the rows of some documents into the tables at path, and carry those of all others over; the buckets written.

    replaced: document_id of every document whose rows the tables hold anew, and of those that are
    gone; a null id is an id. Only the buckets of these are read and overwritten, each as a whole. A run that stops in between
    leaves some tables new and some old, which the same run mends when repeated. Another number
    of buckets, or other columns, than the store has is an error. Tables without document_id are overwritten.
    """
    spark = replaced.sparkSession
    _register({k: v for k, v in tables.items() if k not in reviewed and "document_id" in v.columns}, path, buckets, spark)
    ids = bounded(replaced.select(F.col("document_id").alias("_id")).distinct(), "replaced")
    touched = sorted(r["b"] for r in ids.select(bucket_of(F.col("_id"), buckets).alias("b")).distinct().collect())  # at most `buckets`
    run = uuid.uuid4().hex
    for name, df in tables.items():
        if name in reviewed:
            continue
        if "document_id" not in df.columns:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            continue
        if not touched:
            continue
        rows = df.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
        at = f"{path}/{name}"
        if there(spark, at):
            old = spark.read.schema(rows.schema).parquet(at).where(F.col("bucket").isin(touched))
            rows = rows.unionByName(old.join(ids, F.col("document_id").eqNullSafe(F.col("_id")), "left_anti"))
        # dealt by bucket and slice, so that a bucket is few files
        rows = rows.repartition("bucket", F.pmod(F.xxhash64("document_id", F.lit(1)), F.lit(8))).withColumn("run", F.lit(run))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(at)
        # an empty partition overwrites nothing: buckets that lost their last row still hold another run's, and are deleted
        now = spark.read.schema("run string, bucket int").parquet(at).where(F.col("bucket").isin(touched) & (F.col("run") != run))
        for r in now.select("bucket").distinct().collect():
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/bucket={r['bucket']}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return touched


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
