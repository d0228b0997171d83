"""Running a stream to its end over files that are there, for backfills and tests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.scratch import shared_dir


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Everything that an append stream gives for the files there are, as a table at path."""
    path = path or scratch(stream.sparkSession)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def slices(rows: DataFrame, by: str, n: int, path: str) -> Iterator[DataFrame]:
    """n streams of rows, each over all files so far: a slice more of the values of `by`, in their order, is written before each.

    Run a stream from its checkpoint before taking the next: that run reads the new slice alone, as one batch.
    """
    low, high = rows.agg(F.min(by), F.max(by)).first()
    at = F.when(F.lit(low == high), 0).otherwise(F.least(F.floor((F.col(by) - low) * n / (high - low if high != low else 1)), F.lit(n - 1))) if low is not None else F.lit(0)
    for i in range(n):
        rows.where(at == i).write.mode("append").parquet(f"{path}/in")
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(f"{path}/in")
