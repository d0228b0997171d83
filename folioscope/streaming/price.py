"""Price feed: messages to ticks, direction and staleness, in batch and as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: seconds without a tick after which a feed is stale.
STALE_SECONDS = 20


def parse_mids(messages: DataFrame, coin: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(ts, coin, price) of allMids messages that have the coin; malformed, other and non-finite ones go. Works on streams."""
    m = F.from_json(value, "channel string, data struct<mids: map<string, string>>")
    rows = messages.select(ts, m.alias("m")).where("m.channel = 'allMids'")
    price = F.trim(F.try_element_at("m.data.mids", F.lit(coin))).try_cast("double")
    rows = rows.select(ts, F.lit(coin).alias("coin"), price.alias("price"))
    return rows.where(F.col("price").isNotNull() & ~F.isnan("price") & (F.abs("price") < float("inf")))


def neighbours(ticks: DataFrame, value: str, key: str, ts: str, tie: list[str]) -> DataFrame:
    """ticks with _before and _after: the value of the tick before and after in a key's time order.

    Windows are a key's hours, so a busy key is many tasks; borders are carried by a window over one
    row an hour. A null key is a key of its own; ticks without a time come before all others of
    their key. Repeated rows follow each other.
    """
    order = [ts, *tie]
    hour = F.floor(F.col(ts).cast("timestamp").cast("double") / 3600)
    # a join drops null keys, so both sides are told apart by what is never null
    rows = ticks.withColumns({"_hour": F.coalesce(hour, F.lit(-(1 << 62))), "_none": F.col(key).isNull()})
    blank = F.coalesce(F.col(key).cast("string"), F.lit(""))
    at = F.struct(*order)
    edges = rows.groupBy(key, "_none", "_hour").agg(F.max_by(value, at).alias("_last"), F.min_by(value, at).alias("_first"))
    by_hour, inside = Window.partitionBy(key).orderBy("_hour"), Window.partitionBy(key, "_hour").orderBy(*order)
    edges = edges.select(blank.alias("_key"), "_none", "_hour", F.lag("_last").over(by_hour).alias("_prev"), F.lead("_first").over(by_hour).alias("_next"))
    rows = rows.withColumns({"_in": F.row_number().over(inside), "_b": F.lag(value).over(inside), "_a": F.lead(value).over(inside), "_end": F.lead(F.lit(True)).over(inside).isNull()})
    rows = rows.withColumn("_key", blank).join(edges, ["_key", "_none", "_hour"])
    rows = rows.withColumn("_before", F.when(F.col("_in") == 1, F.col("_prev")).otherwise(F.col("_b"))).withColumn("_after", F.when(F.col("_end"), F.col("_next")).otherwise(F.col("_a")))
    return rows.drop("_key", "_none", "_hour", "_in", "_b", "_a", "_end", "_prev", "_next")


def tick_direction(ticks: DataFrame, key: str = "coin", ts: str = "ts", price: str = "price", tie: str | None = None) -> DataFrame:
    """ticks with direction against the tick before: up, down or flat; the first is flat, and so is one whose own price or that before is null. Batch."""
    rows = neighbours(ticks, price, key, ts, [tie] if tie else [])
    before = F.col("_before")
    return rows.withColumn("direction", F.when(F.col(price) > before, "up").when(F.col(price) < before, "down").otherwise("flat")).drop("_before", "_after")


def staleness(ticks: DataFrame, until, seconds: float = STALE_SECONDS, key: str = "coin", ts: str = "ts") -> DataFrame:
    """(key, at, status): `live` at the first tick and after a gap, `stale` `seconds` after a tick that no other followed by then (judged up to `until`).

    A null key is a key; ticks without a time say nothing and are left out. Batch.
    """
    rows = neighbours(ticks.select(key, F.col(ts).cast("timestamp").alias("t")).where("t is not null"), "t", key, "t", [])
    sec = lambda c: c.cast("double")
    live = F.when(F.col("_before").isNull() | (sec(F.col("t")) - sec(F.col("_before")) > seconds), F.struct(F.col("t").alias("at"), F.lit("live").alias("status")))
    next_ = F.coalesce(F.col("_after"), F.lit(until).cast("timestamp"))
    stale = F.when(sec(next_) - sec(F.col("t")) > seconds, F.struct((F.col("t") + F.make_interval(secs=F.lit(seconds))).alias("at"), F.lit("stale").alias("status")))
    return rows.select(key, F.explode(F.array_compact(F.array(live, stale))).alias("x")).select(key, "x.*")


TICK = "coin string, ts timestamp, price double, direction string, status string"


class LastTick(StatefulProcessor):
    """A coin's last tick in a value state, and an event-time timer for when it goes stale."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double, at long, stale boolean")

    def row(self, key, at, price, direction, status):
        return (key[0], pd.Timestamp(at, unit="us"), price, direction, status)

    def frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["coin", "ts", "price", "direction", "status"])

    def handleInputRows(self, key, rows, timerValues):
        price, at, stale = self.last.get() if self.last.exists() else (None, None, True)
        pdf = pd.concat(list(rows)).sort_values(["ts", "price"])
        out = []
        for ts, now in zip(pdf["ts"], pdf["price"], strict=True):
            t = int(pd.Timestamp(ts).value // 1000)
            if at is not None and t < at:  # later than the watermark allows for, but older than what was seen: it changes nothing
                out.append(self.row(key, t, now, "flat", "late"))
                continue
            if not stale and t - at > self.wait:
                out.append(self.row(key, at + self.wait, price, "flat", "stale"))
            out.append(self.row(key, t, now, "flat" if price is None or now == price else "up" if now > price else "down", "live"))
            price, at, stale = float(now), t, False
        self.last.update((price, at, stale))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not stale:
            self.handle.registerTimer((at + self.wait) // 1000)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        price, at, stale = self.last.get()
        out = [] if stale else [self.row(key, at + self.wait, price, "flat", "stale")]
        self.last.update((price, at, True))
        yield self.frame(out)

    def close(self) -> None:
        pass


def tick_direction_stream(ticks: DataFrame, delay: str = "10 seconds", seconds: float = STALE_SECONDS) -> DataFrame:
    """(coin, ts, price, direction, status) of a stream of ticks (coin, ts, price), in append mode.

    status `live` is a tick with its direction against the coin's tick before. `stale` is a row
    `seconds` after a tick that no other followed by then, given once: with the next tick, or when
    the watermark passes it. Batches may cut the stream anywhere: live and stale rows are those of the batch
    functions. `late` is a tick older than one that an earlier batch held; ticks older than the watermark go, and so do those
    without a coin, time or price. The session keeps state in RocksDB from then on; a coin's ticks of one batch are sorted in memory.
    """
    spark = ticks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = ticks.where("coin is not null and ts is not null and price is not null").withWatermark("ts", delay).groupBy("coin")
    return rows.transformWithStateInPandas(LastTick(seconds), TICK, "append", "EventTime")
