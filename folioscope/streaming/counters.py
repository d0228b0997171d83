"""Streaming counts of attempts and running vote scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.sources.scratch import cut
from folioscope.sources.tables import bucket_of, there


def rate_counts_stream(attempts: DataFrame, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """(window_start, user_id, action, n) in tumbling epoch-aligned windows; rows later than the delay are dropped. Also runs on a batch."""
    rows = attempts.withWatermark("ts", delay) if attempts.isStreaming else attempts
    w = F.window("ts", f"{seconds} seconds")
    return rows.groupBy(w, "user_id", "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "user_id", "action", "n")


def vote_deltas_stream(votes: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """(target_id, user_id, delta): what each voter's change adds to a target's score.

    votes: event_id, ts, user_id, target_id, value. State is one row a voter and target: the last
    value with its (ts, event_id), so a late or repeated vote changes nothing. Sum the deltas by
    target for the running score. With ttl_ms, state idle for that long is forgotten; keep it longer
    than votes may change.
    """

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        at, event, value = state.get if state.exists else (-1, -1, 0)
        start = value
        for pdf in batches:
            for ts, e, v in zip(pdf["ts"], pdf["event_id"], pdf["value"], strict=True):
                if (int(ts.value // 1000), int(e)) > (at, event):
                    at, event, value = int(ts.value // 1000), int(e), int(v)
        state.update((at, event, value))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if value != start:
            yield pd.DataFrame({"user_id": [key[0]], "target_id": [key[1]], "delta": [value - start]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return votes.groupBy("user_id", "target_id").applyInPandasWithState(update, "user_id long, target_id long, delta long", "at long, event long, value long", "append", timeout)


def count_windows(attempts: DataFrame, path: str, seconds: int = 60, delay: str = "1 minute") -> tuple[DataFrame, dict[str, int]]:
    """Count a stream's attempts by window over the files there are; ((window_start, user_id, action, n), {rows, counted, late}).

    Windows are as in rate_counts_stream, and open ones count too. Every row is counted or late:
    `rows` is what the run's batches read, by a metric observed before the watermark drops any, and
    late is what the counts lack. path keeps the checkpoint, the counts and each batch's metric, so a later run goes on from there and
    its figures are of all runs. A batch that is repeated writes its own folder again.
    """
    spark = attempts.sparkSession
    seen: dict[int, int] = {}

    class Metrics(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            m = event.progress.observedMetrics.get("attempts")
            if m is not None:
                seen[event.progress.batchId] = max(seen.get(event.progress.batchId, 0), m["n"])

        def onQueryTerminated(self, event):
            pass

    counted = rate_counts_stream(attempts.observe("attempts", F.count(F.lit(1)).alias("n")), seconds, delay)
    write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/counts/batch={epoch}")
    listener = Metrics()
    spark.streams.addListener(listener)
    try:
        q = counted.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
        for p in q.recentProgress:  # the listener may lag behind
            if "attempts" in p.observedMetrics:
                seen[p.batchId] = max(seen.get(p.batchId, 0), p.observedMetrics["attempts"]["n"])
    finally:
        spark.streams.removeListener(listener)
    for batch, n in seen.items():
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    counts = spark.read.schema("window_start timestamp, user_id string, action string, n long, batch long".replace("user_id string", f"user_id {counted.schema['user_id'].dataType.simpleString()}")).parquet(f"{path}/counts")
    counts = counts.groupBy("window_start", "user_id", "action").agg(F.max_by("n", "batch").alias("n"))
    rows = spark.read.schema("n long, batch long").parquet(f"{path}/rows").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts, {"rows": rows, "counted": held, "late": rows - held}


def fold_scores(batch: DataFrame, path: str, epoch: int, buckets: int = 64) -> None:
    """foreachBatch sink: add one batch of deltas (target_id, delta) to the scores kept at path.

    Scores lie in buckets by a hash of the target. Only buckets that the batch touches are read and
    written, each as a whole and with the batch's number, so a batch costs what it touches, and one that is
    replayed, in whole or where some buckets were written before a crash, changes nothing twice. Batches must come in
    the order of their numbers; use the same number of buckets throughout.
    """
    spark = batch.sparkSession
    new = cut(batch.groupBy("target_id").agg(F.sum("delta").alias("score")).withColumn("bucket", bucket_of(F.col("target_id"), buckets)), "deltas")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    kind = f"target_id {batch.schema['target_id'].dataType.simpleString()}, score long, epoch long, bucket int"
    if there(spark, path):
        old = spark.read.schema(kind).parquet(path).where(F.col("bucket").isin(touched))
        done = [r["bucket"] for r in old.groupBy("bucket").agg(F.max("epoch").alias("epoch")).where(F.col("epoch") >= epoch).collect()]
        new = new.where(~F.col("bucket").isin(done)) if done else new
        old = old.where(~F.col("bucket").isin(done)) if done else old
        new = new.unionByName(old.drop("epoch")).groupBy("bucket", "target_id").agg(F.sum("score").alias("score"))
        if len(done) == len(touched):
            return
    out = new.select("target_id", "score", F.lit(epoch).cast("long").alias("epoch"), "bucket")
    out.repartition("bucket", F.pmod(F.xxhash64("target_id", F.lit(1)), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def fold_votes(batch: DataFrame, path: str, epoch: int, buckets: int = 64) -> None:
    """foreachBatch sink: a batch of votes (event_id, ts, user_id, target_id, value) into the last votes and the scores kept at path.

    Last votes lie in buckets by target, as scores do; a batch reads and writes the buckets of its targets alone. What
    changes a voter's last vote goes to fold_scores as a delta, then the votes are written. A batch that is
    replayed after a crash finds either its votes not written, and gives the same deltas, which scores that have the batch's number skip,
    or finds them written, and gives none. Late and repeated votes change nothing. votes are stored as long numbers and a timestamp.
    """
    spark = batch.sparkSession
    own = ["user_id", "target_id", "ts", "event_id", "value"]
    last = F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id"))
    latest = lambda df: df.groupBy("bucket", "user_id", "target_id").agg(last.alias("v")).select("bucket", "user_id", "target_id", "v.*")
    new = cut(latest(batch.select(*[F.col(c).cast("timestamp" if c == "ts" else "long") for c in own]).withColumn("bucket", bucket_of(F.col("target_id"), buckets))), "votes")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    kind = "user_id long, target_id long, ts timestamp, event_id long, value long, bucket int"
    old = spark.read.schema(kind).parquet(f"{path}/votes").where(F.col("bucket").isin(touched)) if there(spark, f"{path}/votes") else spark.createDataFrame([], kind)
    before = old.select(F.col("user_id").alias("_u"), F.col("target_id").alias("_t"), F.struct("ts", "event_id").alias("_at"), F.col("value").alias("_v"))
    rows = new.join(before, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("target_id").eqNullSafe(F.col("_t")), "left")
    newer = F.col("_at").isNull() | (F.struct("ts", "event_id") > F.col("_at"))
    deltas = rows.where(newer).select("target_id", (F.coalesce("value", F.lit(0)) - F.coalesce("_v", F.lit(0))).alias("delta"))
    fold_scores(deltas, f"{path}/scores", epoch, buckets)
    merged = latest(new.unionByName(old)).select(*own, "bucket")
    merged.repartition("bucket", F.pmod(F.xxhash64("target_id", "user_id", F.lit(1)), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/votes")


def folded_scores(spark: SparkSession, path: str, target: str = "long") -> DataFrame:
    """(target_id, score) as fold_scores keeps them."""
    return spark.read.schema(f"target_id {target}, score long, epoch long, bucket int").parquet(path).select("target_id", "score")
