"""A corpus pipeline: language, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
DataFrame; all but the last return the columns of their input, whatever these are besides doc_id,
text, lang and source. Decisions are about rows, told apart by doc_id and a hash of the text: two
texts under one id, or without an id, are judged each for itself. An empty table gives an empty
one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, jaccard, langid, mixing, shards, templates

#: A list of rows is broadcast only up to this many; beyond it the join is shuffled.
MOST_BROADCAST = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bounded(rows: DataFrame) -> DataFrame:
    """rows, written once, with a broadcast hint if they are few enough."""
    rows = common.cut(rows, "ids")
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def by_row(docs: DataFrame, rows: DataFrame, how: str) -> tuple[DataFrame, dict[str, str]]:
    """docs joined with rows (_id, _hash, ...) by doc_id, nulls too, and text; rows' columns get names that docs does not have."""
    names = dict(zip(rows.columns, common.fresh(docs, *rows.columns), strict=True))
    rows = bounded(rows).withColumnsRenamed(names)
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col(names["_id"])) & (common.text_hash() == F.col(names["_hash"])), how), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language: those with no letter, or with under a quarter of known n-grams, go.

    Null and empty texts have no letter. Where no row has a language, none can be known, and all
    rows with a letter stay. Repeated rows meet the same fate.
    """
    common.text_batches(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs, model, carry=True)
    return kept.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= 0.25)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8 or more): that with the least doc_id, ids before nulls.

    Of ids' ties the text with the least hash stays, and of wholly equal rows one. Null, empty and
    wordless texts are in no group and all stay, repeated ones too.
    """
    common.text_batches(spark)
    rows = common.cut(jaccard.jaccard_classes(docs, words=5, percent=80).where("root is not null"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    best = rows.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = common.skew_join(rows, best, "root", common.hot_keys(rows, "root"))
    groups = groups.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (order == F.col("best")).alias("stays"))
    # (id, text) of rows that go, and of rows that stay once of several
    odd = groups.groupBy("_id", "_hash", "stays").agg(F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    marked, names = by_row(docs, odd.select("_id", "_hash", (~F.col("stays")).alias("_drop")), "left")
    drop = F.col(names["_drop"])
    single, several = marked.where(drop.isNull()).select(docs.columns), marked.where(~drop)
    return single.unionByName(several.dropDuplicates([names["_id"], names["_hash"]]).select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and empty texts hold none. Repeated rows meet the same fate."""
    common.text_batches(spark)
    hits = templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_hash=True)
    return by_row(docs, hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "left_anti")[0]


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once; rows of small sources again, up to twice in all, by the mixture's plan.

    A null source is a source of its own; null and empty texts count as one token. Equal rows are
    dealt equally often.
    """
    dealt = mixing.mix_sources(docs, max_epochs=2.0, with_hash=True)
    again = dealt.where("epoch > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg((F.max("epoch") + 1).cast("int").alias("_times"))
    more, names = by_row(docs, again, "left")
    (copy,) = common.fresh(more, "_copy")
    return more.withColumn(copy, F.explode(F.sequence(F.lit(1), F.coalesce(names["_times"], F.lit(1))))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, divided) in 16 shards of nearly equal bytes; every row, repeated ones too, has a slot."""
    return shards.kd_shards(docs, n_shards=16)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixture", mixture), ("shards", shard)]

#: None: SQL can't express the filters' fit, the slot check or the bisection.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs, name)
    return docs
