"""Queries of streams that stop and go on again, over the documents as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.plans.registry import Tables, query
from folioscope.sources.scratch import new_path
from folioscope.streaming import counters, price
from folioscope.streaming.run import drain, slices

#: Documents as a log: a row every seven seconds.
TS = "timestamp_seconds(1700000000 + 7 * doc_id)"
EPOCH = "(1700000000 + 7 * doc_id)"
COIN = "'c' || doc_id * doc_id % 101"


def log(t: Tables, *columns: str):
    return t.documents.selectExpr("doc_id", *columns)


@query(f"""WITH g AS (SELECT {COIN} AS coin, {EPOCH} AS sec, n_chars % 50 AS price, lag(n_chars % 50) OVER w AS earlier, lead({EPOCH}) OVER w AS later, (SELECT max({EPOCH}) - 10 FROM documents) AS mark FROM documents WINDOW w AS (PARTITION BY {COIN} ORDER BY doc_id))
 SELECT coin, sec AS at, CASE WHEN price > earlier THEN 'up' WHEN price < earlier THEN 'down' ELSE 'flat' END AS direction, 'live' AS status FROM g UNION ALL SELECT coin, sec + 350, 'flat', 'stale' FROM g WHERE coalesce(later, mark) - sec > 350""")
def n2_tick_stream(t):
    """Directions and staleness of a stream that is stopped and restarted twice."""
    rows = log(t, f"{COIN} AS coin", f"{TS} AS ts", "CAST(n_chars % 50 AS DOUBLE) AS price")
    path = new_path(t.spark, "ticks")
    for stream in slices(rows, "doc_id", 3, path):
        out = drain(price.tick_direction_stream(stream, "10 seconds", 350), path)
    return out.select("coin", F.unix_seconds("ts").alias("at"), "direction", "status")


@query(f"""WITH d AS (SELECT {EPOCH} AS sec, doc_id, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 2 END AS run FROM documents), m AS (SELECT max(CASE WHEN run = 1 THEN sec END) - 60 AS mark FROM d),
 l AS (SELECT run = 2 AND (sec // 3600 + 1) * 3600 <= mark AS late FROM d, m) SELECT 'rows' AS metric, count(*) AS n FROM l UNION ALL SELECT 'late', CAST(sum(CASE WHEN late THEN 1 ELSE 0 END) AS BIGINT) FROM l UNION ALL SELECT 'counted', CAST(sum(CASE WHEN late THEN 0 ELSE 1 END) AS BIGINT) FROM l""")
def n4_late_rows(t):
    """Rows of a second run that come after their window was closed, counted as late."""
    rows = log(t, "doc_id % 40 AS user_id", "source AS action", f"{TS} AS ts")
    path = new_path(t.spark, "attempts")
    for stream in slices(rows.withColumn("run", F.when(F.col("doc_id") % 3 > 0, 1).otherwise(2)), "run", 2, path):
        _, figures = counters.count_windows(stream, path, 3600, "1 minute")
    return t.spark.createDataFrame(list(figures.items()), "metric string, n long")


@query("SELECT target_id, CAST(sum(v) AS BIGINT) AS score FROM (SELECT doc_id % 97 AS target_id, doc_id % 300 AS user_id, arg_max(CASE WHEN n_chars % 3 = 0 THEN -1 ELSE 1 END, doc_id) AS v FROM documents GROUP BY ALL) GROUP BY 1")
def n5_folded_votes(t):
    """Scores folded into buckets by three runs; every batch is delivered twice."""
    rows = log(t, "doc_id AS event_id", f"{TS} AS ts", "doc_id % 300 AS user_id", "doc_id % 97 AS target_id", "CAST(CASE WHEN n_chars % 3 = 0 THEN -1 ELSE 1 END AS BIGINT) AS value")
    path = new_path(t.spark, "votes")

    def twice(batch, epoch):
        counters.fold_votes(batch, path, epoch, 16)
        counters.fold_votes(batch, path, epoch, 16)

    for stream in slices(rows, "event_id", 3, path):
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return counters.folded_scores(t.spark, f"{path}/scores")
