"""The registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import SPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt anew: a table of one file may be one task, and what follows is dear for each row."""
    return df.repartition(F.xxhash64(df.columns[0]))


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that both engines give one schema."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(f(Tables(spark, sf_dir)))

        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return f

    return add


def ws(x: str) -> str:
    """SQL of norm_ws."""
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def key(x: str) -> str:
    """SQL of norm_title."""
    return rf"trim(regexp_replace(regexp_replace(lower({ws(x)}), '[^\p{{L}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


def slug(x: str) -> str:
    return f"coalesce(nullif(left(replace({key(x)}, ' ', '-'), 80), ''), 'untitled')"


def short(x: str, n: int) -> str:
    """SQL of excerpt."""
    return f"CASE WHEN length({ws(x)}) <= {n} THEN {ws(x)} ELSE trim(left({ws(x)}, {n - 1})) || '...' END"


def re2(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE).replace("'", "''")


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{re2(pattern)}')"
