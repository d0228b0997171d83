"""Streams over a table of several files that are not in time order."""

import datetime as dt
from collections import Counter

from folioscope.plans import queries_forum, registry  # noqa: F401

T0 = dt.datetime(2024, 1, 1)


def test_backfill_of_unordered_files(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(120)]
    for part in (rows[80:], rows[:40], rows[40:80]):  # the newest first
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["n4_rate_counts_stream"](spark, str(tmp_path)).collect()
    end = rows[-1][1] - dt.timedelta(minutes=1)
    hour = lambda t: t.replace(minute=0, second=0)
    want = Counter((hour(t), u, a) for _, t, u, a, _ in rows if hour(t) + dt.timedelta(hours=1) <= end)
    assert {(r["window_start"], r["user_id"], r["action"]): r["n"] for r in got} == want and len(got) == len(want)
