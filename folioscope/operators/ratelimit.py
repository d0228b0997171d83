"""Fixed-window rate limits over a log of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import bounded, cut

#: Action, step, scope, window in seconds, limit.
LIMITS = (
    ("thread", 1, "user", 60, 3), ("thread", 2, "user", 86400, 20), ("thread", 3, "ip", 60, 10),
    ("post", 1, "user", 60, 10), ("post", 2, "user", 86400, 100), ("post", 3, "ip", 60, 30),
    ("vote", 1, "user", 60, 60), ("vote", 2, "user", 86400, 1000), ("vote", 3, "ip", 60, 120),
    ("report", 1, "user", 3600, 10), ("report", 2, "ip", 3600, 30),
    ("moderate", 1, "user", 60, 60), ("moderate", 2, "user", 86400, 1000),
)


def bucket_start(ts: Column, seconds) -> Column:
    """Start of the epoch-aligned window, in the session's time zone (use UTC)."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / s) * s)


def rate_limit(attempts: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """attempts (event_id, ts, user_id, ip, action[, is_moderator]) with allowed, denied_step and retry_after.

    Limits are tried by step; each counts only attempts that the earlier ones let through, and the
    rejecting one counts its own. An empty subject, a limit or window under 1 and an action without
    limits are denied. With is_moderator, moderation by others fails before any counting. Attempts count in the order
    of (ts, event_id); rows that repeat an event share its verdict.

    A limit of k lets through what is not after a bucket's k-th attempt. Each task keeps its first k
    rows a bucket, so only these are shuffled, and the k-th of each bucket, if there is one, is joined to
    the rows where they stand; a bucket, however hot, is no task of its own.
    """
    spark = attempts.sparkSession
    known = F.col("action").isin(*{x[0] for x in limits})
    blocked = ~F.coalesce(known, F.lit(False))
    if "is_moderator" in attempts.columns:
        blocked = blocked | ((F.col("action") == "moderate") & ~F.coalesce("is_moderator", F.lit(False)))
    rows = attempts.withColumn("denied_step", F.when(blocked, 0)).withColumn("retry_after", F.lit(None).cast("int"))
    last = max(x[1] for x in limits)
    for step in range(1, last + 1):
        mine = [x for x in limits if x[1] == step]
        pick = lambda i, mine=mine: F.coalesce(*[F.when(F.col("action") == x[0], F.lit(x[i])) for x in mine])
        scope, secs, most = pick(2), pick(3), pick(4)
        live = F.col("denied_step").isNull() & scope.isNotNull()
        subject = F.trim(F.when(scope == "user", F.col("user_id").cast("string")).otherwise(F.col("ip").cast("string")))
        bad = (F.coalesce(subject, F.lit("")) == "") | (most < 1) | (secs < 1)
        start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.greatest(secs, F.lit(1)))
        # a null time is a time before all others, with a bucket of its own
        key = F.when(live & ~bad, F.struct(scope.alias("scope"), subject.alias("s"), "action", secs.alias("secs"), F.coalesce(start, F.lit(-(1 << 62))).alias("b")))
        at = F.struct("ts", "event_id")
        counted = rows.select(key.alias("_k"), "ts", "event_id", most.alias("_most")).where("_k is not null")
        n = F.row_number().over(Window.partitionBy("_k").orderBy("ts", "event_id"))
        first = counted.withColumn("_n", n).where(F.col("_n") <= max(1, *[x[4] for x in mine]))
        kth = bounded(first.where("_n = _most").select("_k", at.alias("_kth")), "kth")
        over = live & (bad | F.coalesce(at > F.col("_kth"), F.lit(False)))
        rows = rows.withColumn("_k", key).join(kth, "_k", "left").withColumns({"retry_after": F.when(over, secs).otherwise(F.col("retry_after")), "denied_step": F.when(over, F.lit(step)).otherwise(F.col("denied_step"))}).drop("_k", "_kth")
        if step < last:
            rows = cut(rows, "attempts")
    return rows.select(*attempts.columns, "denied_step", "retry_after", F.col("denied_step").isNull().alias("allowed"))


def rate_limit_buckets(attempts: DataFrame, limits: tuple = LIMITS, newer_than=None) -> DataFrame:
    """(scope, subject, action, window_seconds, window_start, count, updated_at) of counted attempts, newer buckets only if asked."""
    rule = F.broadcast(attempts.sparkSession.createDataFrame(list(limits), "action string, step int, scope string, window_seconds int, most int"))
    judged = rate_limit(attempts, limits)
    counted = judged.join(rule, "action").where(F.col("denied_step").isNull() | ((F.col("denied_step") >= F.col("step")) & (F.col("denied_step") > 0)))
    subject = F.trim(F.when(F.col("scope") == "user", F.col("user_id").cast("string")).otherwise(F.col("ip").cast("string")))
    rows = counted.where(F.coalesce(subject, F.lit("")) != "").groupBy("scope", subject.alias("subject"), "action", "window_seconds", bucket_start(F.col("ts"), F.col("window_seconds")).alias("window_start")).agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("updated_at"))
    return rows if newer_than is None else rows.where(F.col("window_start") >= F.lit(newer_than))
