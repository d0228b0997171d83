import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.operators import forum as O
from folioscope.operators import ratelimit as L

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_votes_change_and_repeat(spark):
    rows = [(1, at(0), "u", "thread", "t", 1), (2, at(1), "u", "thread", "t", -1), (3, at(1), "v", "thread", "t", -1), (4, at(2), "v", "thread", "t", -1), (6, at(5), "w", "thread", "x", -1), (5, at(5), "w", "thread", "x", 1)]
    votes = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id string, target_type string, target_id string, value int")
    assert {r["target_id"]: r["score"] for r in O.score_from_votes(votes).collect()} == {"t": -2, "x": -1}


def test_replies_count_soft_deleted_posts(spark):
    ev = spark.createDataFrame([("t", "insert", False), ("t", "insert", True), ("t", "delete", False), ("s", "delete", False)], "thread_id string, op string, is_deleted boolean")
    assert {r["thread_id"]: r["reply_count"] for r in O.reply_counts(ev).collect()} == {"t": 1, "s": 0}
    assert {r["thread_id"]: r["reply_count"] for r in O.reply_counts(ev, False).collect()} == {"t": 0, "s": 0}


def test_pages_meet_without_gaps(spark):
    rows = [(i, float(i % 3), at(i % 4), i == 7) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, score double, created_at timestamp, is_deleted boolean")
    seen, cursor = [], None
    while True:
        page = O.thread_page(df, "score", cursor, 7).orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).collect()
        seen += [r["id"] for r in page]
        if not page or not page[-1]["has_more"]:
            break
        cursor = (page[-1]["score"], page[-1]["created_at"], page[-1]["id"])
    want = sorted((r for r in rows if not r[3]), key=lambda r: (r[1], r[2], r[0]), reverse=True)
    assert seen == [r[0] for r in want]
    assert [O.page_limit(x) for x in (None, 0, 500, 7)] == [25, 1, 100, 7]
    assert O.thread_page(df.limit(0)).count() == 0


def test_writes_in_locked_and_deleted_threads(spark):
    threads = spark.createDataFrame([("open", False, False), ("locked", True, False), ("gone", False, True)], "id string, is_locked boolean, is_deleted boolean")
    base = dict(title_len=10, body_len=10, value=1, reason_len=5, target_type="thread", score=0)
    cases = [("post", False, "open", {}, "ok"), ("post", False, "locked", {}, "thread locked"), ("post", True, "locked", {}, "ok"), ("post", False, "gone", {}, "thread deleted"), ("post", False, "none", {}, "no such thread"), ("thread", False, None, {"title_len": 2}, "title length"), ("thread", False, None, {"title_len": 300}, "ok"), ("thread", False, None, {"score": 3}, "counters are not the client's"), ("vote", False, "open", {"value": 0}, "vote value"), ("report", False, "open", {"reason_len": 1001}, "reason length"), ("moderate", False, "open", {}, "not a moderator"), ("moderate", True, "gone", {}, "ok"), ("dance", False, "open", {}, "unknown action")]
    rows = [(i, k, m, t, *({**base, **x}).values()) for i, (k, m, t, x, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, kind string, is_moderator boolean, thread_id string, title_len int, body_len int, value int, reason_len int, target_type string, score int")
    assert [r["verdict"] for r in O.validate_writes(df, threads).orderBy("i").collect()] == [c[4] for c in cases]


def test_tree_with_orphans_and_depth(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 99), (8, 9), (9, 8)]
    got = {r["id"]: (r["root_id"], r["depth"], r["indent"], r["path"]) for r in O.post_tree(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert got[6] == (1, 5, 4, [1, 2, 3, 4, 5, 6]) and got[7] == (7, 0, 0, [7]) and 8 not in got


def test_tree_of_a_deep_chain_and_a_wide_root(spark):
    """Chains of 5,000 and 105 posts, 2,000,000 replies to one post, a cycle with a tail, in few joins."""
    from pyspark.sql import functions as F

    chain = spark.range(5000).select("id", (F.col("id") - 1).alias("parent_id"))
    wide = spark.range(10_000, 2_010_000).select("id", F.lit(0).cast("long").alias("parent_id"))
    other = spark.createDataFrame([(6000, 6001), (6001, 6000), (6002, 6001), (6003, None)], "id long, parent_id long")
    got = O.post_tree(chain.union(wide).union(other), with_path=False)
    assert got.count() == 2_005_001 and got.agg(F.max("depth")).first()[0] == 4999
    assert got.where("id = 4999").first()[:2] == (4999, 0) and got.where("id between 6000 and 6002").isEmpty()
    assert got.where("depth = 1").count() == 2_000_001
    path = O.post_tree(spark.range(105).select("id", (F.col("id") - 1).alias("parent_id"))).where("id = 104").first()
    assert path["path"] == list(range(105)) and path["indent"] == 4
    assert O.post_tree(spark.createDataFrame([], "id long, parent_id long")).count() == 0


def test_nearest_ranks_against_sorting(spark):
    import math
    import random

    g = random.Random(3)
    rows = [(n, round(g.expovariate(0.02), g.randint(0, 2))) for n in "abc" for _ in range({"a": 1, "b": 777, "c": 40}[n])] + [("d", None)]
    got = {r["name"]: (r["p95"], r["p99"]) for r in O.nearest_ranks(spark.createDataFrame(rows, "name string, ms double")).collect()}
    want = {n: tuple(sorted(v)[math.ceil(p / 100 * len(v)) - 1] for p in (95, 99)) for n in "abc" for v in [[m for k, m in rows if k == n]]}
    assert got == want


def test_post_scores(spark):
    votes = spark.createDataFrame([(1, at(0), "u", "post", "p1", 1), (2, at(1), "u", "post", "p1", -1), (3, at(0), "v", "thread", "p1", 1), (4, at(0), "w", "post", "p2", 1)], "event_id long, ts timestamp, user_id string, target_type string, target_id string, value int")
    got = {r["id"]: r["score"] for r in O.apply_scores(spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string"), votes, "post").collect()}
    assert got == {"p1": -1, "p2": 1, "p3": 0}


def test_latency(spark):
    rows = [("read:posts", float(i), True) for i in range(1, 101)] + [("write:vote", 10.0, False), ("read:threads", 301.0, True)]
    got = {r["name"]: r for r in O.latency_report(spark.createDataFrame(rows, "name string, ms double, ok boolean")).collect()}
    assert (got["read:posts"]["p95"], got["read:posts"]["p99"], got["read:posts"]["failed"]) == (95.0, 99.0, False)
    assert got["write:vote"]["p95"] == 0 and got["write:vote"]["failed"] and got["read:threads"]["failed"]


def attempts(spark, rows):
    return spark.createDataFrame([(i, at(s), u, ip, a) for i, (s, u, ip, a) in enumerate(rows)], "event_id long, ts timestamp, user_id string, ip string, action string")


@pytest.mark.parametrize("n", [3, 4])
def test_rate_limit_at_and_over(spark, n):
    got = L.rate_limit(attempts(spark, [(i, "u", "1", "thread") for i in range(n)] + [(60, "u", "1", "thread")])).orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True] * 3 + [False] * (n - 3) + [True]
    assert [r["retry_after"] for r in got if not r["allowed"]] == [60] * (n - 3)


def brute(rows, limits):
    counts, out = {}, []
    for s, u, ip, a in rows:
        mine = sorted((x for x in limits if x[0] == a), key=lambda x: x[1])
        denied = None if mine else 0
        for _, step, scope, secs, most in mine:
            subject = (u if scope == "user" else ip) or ""
            if not subject.strip():
                denied = step
                break
            k = (scope, subject.strip(), a, secs, s // secs)
            counts[k] = counts.get(k, 0) + 1
            if counts[k] > most:
                denied = step
                break
        out.append(denied)
    return out, counts


def test_rate_limit_cascade_against_brute_force(spark):
    import random

    g = random.Random(4)
    limits = (("vote", 1, "user", 60, 2), ("vote", 2, "user", 600, 4), ("vote", 3, "ip", 60, 3), ("post", 1, "ip", 120, 1))
    rows = sorted(((g.randrange(1200), g.choice(["a", "b", " "]), g.choice(["1", "2", "unknown"]), g.choice(["vote", "vote", "post", "nothing"])) for _ in range(400)), key=lambda r: r[0])
    df = attempts(spark, rows)
    want, counts = brute(rows, limits)
    assert [r["denied_step"] for r in L.rate_limit(df, limits).orderBy("event_id").collect()] == want
    got = {(r["scope"], r["subject"], r["action"], r["window_seconds"], int((r["window_start"] - T0).total_seconds()) // r["window_seconds"]): r["count"] for r in L.rate_limit_buckets(df, limits).collect()}
    assert got == counts
    assert L.rate_limit(df.limit(0), limits).count() == 0


def test_profiles_and_defaults(spark):
    up = spark.createDataFrame([("u1", "a@b", '{"user_name":"x","full_name":"X Y"}'), ("u2", "a@b", "{}"), ("12345678-9", None, None), ("old", "a@b", None)], "user_id string, email string, meta string")
    old = spark.createDataFrame([("old", "h", None, "moderator")], "id string, handle string, display_name string, role string")
    got = {r["id"]: (r["handle"], r["display_name"]) for r in O.profile_from_signup(up, old).collect()}
    assert got == {"u1": ("x", "X Y"), "u2": ("a", "New member"), "12345678-9": ("user_12345678", "New member")}
    df = spark.createDataFrame([("old",), ("none",)], "author_id string")
    assert {(r["author_handle"], r["author_display_name"], r["author_role"]) for r in O.with_author_defaults(df, old).collect()} == {("h", "h", "moderator"), ("member", "Community member", "member")}


def test_floored_counts_against_a_fold(spark):
    """Deletes before inserts, ties, a key with most rows, keys without a name, empty logs."""
    import random

    g = random.Random(4)
    rows = [(g.choice(["hot"] * 6 + ["a", "b", None, ""]), g.randint(0, 40), i, g.choice(["insert", "delete", "delete", "edit", None]), g.random() < 0.2) for i in range(600)]
    df = spark.createDataFrame(rows, "thread_id string, ts int, id int, op string, is_deleted boolean").repartition(5)
    for keep in (True, False):
        want = {}
        for thread, _, _, op, gone in sorted(rows, key=lambda r: r[1:3]):
            if keep or not gone:
                want[thread] = max(0, want.get(thread, 0) + {"insert": 1, "delete": -1}.get(op, 0))
        assert {r["thread_id"]: r["reply_count"] for r in O.reply_counts(df, keep, ("ts", "id")).collect()} == want
    assert O.reply_counts(df.where("false"), order=("ts", "id")).count() == 0
    valid = spark.createDataFrame([("t", 1, "delete"), ("t", 2, "insert")], "thread_id string, ts int, op string")
    assert [O.reply_counts(valid, order=o).first()["reply_count"] for o in ((), ("ts",))] == [0, 1]


def test_latency_of_no_name_and_unknown_outcome(spark):
    rows = [(None, 900.0, True), (None, 800.0, True), ("", 5.0, True), ("a", 1.0, None), ("a", None, True)]
    got = {r["name"]: (r["n"], r["errors"], r["p95"], r["p99"], r["failed"]) for r in O.latency_report(spark.createDataFrame(rows, "name string, ms double, ok boolean")).collect()}
    assert got == {None: (2, 0, 900.0, 900.0, True), "": (1, 0, 5.0, 5.0, False), "a": (2, 1, 0.0, 0.0, True)}


def test_tree_of_repeated_posts(spark):
    rows = [(1, None), (2, 1), (2, 1), (2, None), (3, 2), (3, 2), (None, 1)]
    got = sorted((r["id"], r["root_id"], r["depth"], r["path"]) for r in O.post_tree(spark.createDataFrame(rows, "id long, parent_id long")).collect())
    assert got == [(1, 1, 0, [1]), (2, 1, 1, [1, 2]), (3, 1, 2, [1, 2, 3])]


def test_limits_against_a_window_for_each_bucket(spark):
    """A hot address with half of all rows, null times and subjects, three steps."""
    import datetime as dt
    import random

    from folioscope.operators import ratelimit as L

    g = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    limits = (("vote", 1, "user", 60, 2), ("vote", 2, "user", 600, 5), ("vote", 3, "ip", 60, 9), ("post", 1, "user", 60, 1), ("post", 2, "ip", 60, 3), ("bad", 1, "user", 60, 0))
    rows = [(i, None if i % 50 == 7 else t0 + dt.timedelta(seconds=g.randint(0, 900)), g.choice([1, 2, 3, 4, 5, 6, None]), "unknown" if g.random() < 0.5 else g.choice(["a", " ", None]), g.choice(["vote", "vote", "post", "bad", "other", None])) for i in range(500)]
    want = {}
    live = {r[0]: r for r in rows if r[4] in ("vote", "post", "bad")}
    want |= {r[0]: 0 for r in rows if r[0] not in live}
    for step in (1, 2, 3):
        rule = {x[0]: x[2:] for x in limits if x[1] == step}
        used = {}
        for i, ts, user, ip, action in sorted(live.values(), key=lambda r: (r[1] is not None, r[1] or t0, r[0])):
            if action not in rule:
                continue
            scope, secs, most = rule[action]
            subject = ("" if user is None else str(user)) if scope == "user" else (ip or "").strip()
            key = scope, subject, action, None if ts is None else int(ts.timestamp()) // secs
            used[key] = used.get(key, 0) + 1
            if not subject or most < 1 or used[key] > most:
                want[i] = step
                del live[i]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, ip string, action string").repartition(6)
    out = L.rate_limit(df, limits)
    got = {r["event_id"]: r["denied_step"] for r in out.collect()}
    assert got == {r[0]: want.get(r[0]) for r in rows} and {r["retry_after"] for r in out.where("denied_step = 2 and action = 'vote'").collect()} == {600}


def test_roles_come_from_profiles_and_reports_are_for_moderators(spark):
    profiles = spark.createDataFrame([(1, "moderator"), (2, "member"), (3, None), (2, "moderator"), (None, "moderator")], "id long, role string")
    rows = O.with_roles(spark.createDataFrame([(1, False), (2, True), (3, True), (4, True), (None, True)], "user_id long, is_moderator boolean"), profiles)
    assert {r["user_id"]: r["is_moderator"] for r in rows.collect()} == {1: True, 2: True, 3: False, 4: False, None: False} and rows.count() == 5
    reports = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "open"), (2, dt.datetime(2023, 1, 1), "open"), (3, dt.datetime(2022, 1, 1), "closed")], "id long, created_at timestamp, status string")
    assert [r["id"] for r in O.report_queue(reports, moderator=True).collect()] == [2, 1] and O.report_queue(reports).count() == 0
