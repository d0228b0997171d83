import datetime as dt
import json

from pyspark.sql import functions as F

from folioscope.streaming import counters, price

T0 = dt.datetime(2024, 1, 1)


def stream(spark, path, *batches, schema):
    """A file stream of the batches, one file each, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/in{i}")
    return [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in*")][0]


def drain(df, tmp_path, mode="append"):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_parse_mids(spark):
    good = lambda v, c="allMids": json.dumps({"channel": c, "data": {"mids": {"k": v}}})
    rows = [(1, good("1.5")), (2, "{bad"), (3, good("1", "other")), (4, good("x")), (5, json.dumps({"channel": "allMids", "data": {"mids": {"z": "1"}}})), (6, good("NaN")), (7, good("2")), (8, None)]
    assert [(r["ts"], r["price"]) for r in price.parse_mids(spark.createDataFrame(rows, "ts long, value string"), "k").orderBy("ts").collect()] == [(1, 1.5), (7, 2.0)]


def test_direction_and_staleness(spark):
    rows = [("c", T0 + dt.timedelta(seconds=s), p) for s, p in ((0, 1.0), (20, 1.0), (40.001, 2.0), (41, 1.0))]
    df = spark.createDataFrame(rows, "coin string, ts timestamp, price double")
    assert [r["direction"] for r in price.tick_direction(df).orderBy("ts").collect()] == ["flat", "flat", "up", "down"]
    got = [((r["at"] - T0).total_seconds(), r["status"]) for r in price.staleness(df, str(T0 + dt.timedelta(seconds=100))).orderBy("at").collect()]
    assert got == [(0, "live"), (40.0, "stale"), (40.001, "live"), (61.0, "stale")]


def test_direction_over_hours(spark):
    """Neighbours in other hours, hours without ticks, and ties."""
    import random

    g = random.Random(1)
    rows = [(c, T0 + dt.timedelta(seconds=g.choice([0, 5, 3599, 3600, 9000, 90000]) + g.randint(0, 2)), i, float(g.randint(0, 3))) for i, c in enumerate("abc" * 40)]
    got = {r["i"]: r["direction"] for r in price.tick_direction(spark.createDataFrame(rows, "coin string, ts timestamp, i int, price double"), tie="i").collect()}
    for c in "abc":
        own = sorted((t, i, p) for k, t, i, p in rows if k == c)
        for (_, _, b), (_, i, p) in zip([(0, 0, own[0][2]), *own], own, strict=False):
            assert got[i] == ("up" if p > b else "down" if p < b else "flat")
    assert len(got) == len(rows)


def test_ticks_without_a_key_or_a_time(spark):
    rows = [("c", T0, 1.0), (None, T0, 5.0), (None, T0 + dt.timedelta(hours=2), 4.0), ("c", None, 9.0), ("", T0, 7.0), ("c", T0 + dt.timedelta(seconds=1), None)]
    df = spark.createDataFrame(rows, "coin string, ts timestamp, price double")
    got = {(r["coin"], r["ts"], r["price"]): r["direction"] for r in price.tick_direction(df).collect()}
    assert len(got) == len(rows) and got[None, rows[2][1], 4.0] == "down" and got["c", T0, 1.0] == "down" and got["", T0, 7.0] == "flat" and got["c", rows[5][1], None] == "flat"
    stale = sorted((str(r["coin"]), (r["at"] - T0).total_seconds(), r["status"]) for r in price.staleness(df, str(T0 + dt.timedelta(hours=2))).collect())
    assert stale == [("", 0, "live"), ("", 20, "stale"), ("None", 0, "live"), ("None", 20, "stale"), ("None", 7200, "live"), ("c", 0, "live"), ("c", 21, "stale")]


def test_tick_stream_over_restarts_equals_batch(spark, tmp_path):
    """Each file a run of its own from the checkpoint; gaps within a file, between files, and at the end."""
    import random

    g = random.Random(2)
    kind = "coin string, ts timestamp, price double"
    rows = sorted({(c, T0 + dt.timedelta(seconds=g.choice([0, 7, 30, 60, 200, 260]) + g.randint(0, 9))): float(g.randint(0, 3)) for c in "abc" * 12}.items(), key=lambda x: x[0][1])
    rows = [(*k, v) for k, v in rows]
    cuts = [0, 5, 6, len(rows) // 2, len(rows)]
    src, path = str(tmp_path / "in"), str(tmp_path)
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame([*rows[a:b], (None, T0, 1.0), ("a", None, 1.0), ("a", rows[a][1], None)], kind).coalesce(1).write.mode("append").parquet(src)
        stream_ = spark.readStream.schema(kind).parquet(src)
        q = price.tick_direction_stream(stream_, "10 seconds").writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.schema(price.TICK).parquet(f"{path}/out")
    whole = spark.createDataFrame(rows, kind)
    want = sorted((r["coin"], r["ts"], r["price"], r["direction"]) for r in price.tick_direction(whole).collect())
    assert sorted((r["coin"], r["ts"], r["price"], r["direction"]) for r in got.where("status = 'live'").collect()) == want
    mark = max(r[1] for r in rows) - dt.timedelta(seconds=10)
    stale = sorted((r["coin"], r["at"]) for r in price.staleness(whole, str(mark)).where("status = 'stale'").collect())
    assert sorted((r["coin"], r["ts"]) for r in got.where("status = 'stale'").collect()) == stale and stale


def test_late_rows_are_counted(spark, tmp_path):
    row = lambda s: (T0 + dt.timedelta(seconds=s), "u", "post")
    kind, src, path = "ts timestamp, user_id string, action string", str(tmp_path / "in"), str(tmp_path / "run")
    figures = []
    for rows in ([row(0), row(10), row(61)], [row(400)], [row(5), row(5), row(330), row(900)], []):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        counts, n = counters.count_windows(spark.readStream.schema(kind).parquet(src), path, 60, "1 minute")
        figures.append((n["rows"], n["counted"], n["late"]))
    assert figures == [(3, 3, 0), (4, 4, 0), (8, 6, 2), (8, 6, 2)]  # 330 s: its window is open until the mark passes 360 s
    assert {int((r["window_start"] - T0).total_seconds()): r["n"] for r in counts.collect()} == {0: 2, 60: 1, 360: 1, 300: 1, 900: 1}


def test_rate_counts_drop_late_rows(spark, tmp_path):
    row = lambda s: (T0 + dt.timedelta(seconds=s), "u", "post")
    s = stream(spark, str(tmp_path), [row(0), row(10), row(61)], [row(400)], [row(401)], [row(5), row(900)], schema="ts timestamp, user_id string, action string")
    got = {int((r["window_start"] - T0).total_seconds()): r["n"] for r in drain(counters.rate_counts_stream(s), tmp_path).collect()}
    assert got[0] == 2 and got[60] == 1  # the late row at 5 s doesn't count


def test_vote_deltas_sum_to_the_batch_score(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, target_id long, value long"
    rows = [(i, T0 + dt.timedelta(seconds=i), i % 4, i % 3, 1 if i % 5 else -1) for i in range(40)]
    s = stream(spark, str(tmp_path), rows[:15], rows[15:30], rows[30:] + rows[:3], schema=schema)
    got = {r["target_id"]: r["s"] for r in drain(counters.vote_deltas_stream(s), tmp_path).groupBy("target_id").agg(F.sum("delta").alias("s")).collect()}
    last = {}
    for _, _, u, t, v in rows:
        last[u, t] = v
    want = {}
    for (_, t), v in last.items():
        want[t] = want.get(t, 0) + v
    assert got == want


def test_folded_scores_touch_their_buckets_once(spark, tmp_path):
    import glob

    path = str(tmp_path / "s")
    batch = lambda *x: spark.createDataFrame(list(x), "target_id long, delta long")
    scores = lambda: {r["target_id"]: r["score"] for r in counters.folded_scores(spark, path).collect()}
    files = lambda: set(glob.glob(f"{path}/bucket=*/*.parquet"))
    counters.fold_scores(batch(), path, 0, 8)
    counters.fold_scores(batch(*[(i, 1) for i in range(40)], (1, 5)), path, 1, 8)
    whole = files()
    for epoch in (2, 2, 3, 3):
        counters.fold_scores(batch((1, -2), (1, 1)), path, epoch, 8)
    assert scores() == {**{i: 1 for i in range(40)}, 1: 4}
    assert len(whole - files()) < len(whole) / 4  # one bucket of eight was written again
    counters.fold_scores(batch((1, 7), (2, 7)), path, 3, 8)  # a crash left the bucket of 1 written and, say, that of 2 not
    one, two = (spark.sql(f"select pmod(xxhash64({i}L), 8)").first()[0] for i in (1, 2))
    assert scores()[1] == 4 and scores()[2] == (1 if one == two else 8)


def test_folded_votes_replay_and_come_late(spark, tmp_path):
    import random

    g = random.Random(6)
    kind = "event_id long, ts timestamp, user_id long, target_id long, value long"
    rows = [(i, T0 + dt.timedelta(seconds=g.randint(0, 60)), g.randint(0, 4), g.randint(0, 6), g.choice([1, -1])) for i in range(120)]
    path = str(tmp_path)
    for epoch, part in enumerate((rows[:50], rows[:50], rows[50:90] + rows[:20], [], rows[90:])):
        for _ in range(2):
            counters.fold_votes(spark.createDataFrame(part, kind), path, epoch, 4)
    last, want = {}, {}
    for e, ts, u, t, v in sorted(rows, key=lambda r: r[1::-1]):
        last[u, t] = v
    for (_, t), v in last.items():
        want[t] = want.get(t, 0) + v
    assert {r["target_id"]: r["score"] for r in counters.folded_scores(spark, f"{path}/scores").collect()} == want
