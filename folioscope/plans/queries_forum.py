"""Queries of the forum, rate limits and feeds, over orders as threads, customers as profiles, lineitems as posts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from folioscope.operators import forum as O
from folioscope.operators import ratelimit as L
from folioscope.operators import rules as R
from folioscope.plans.queries_text import THEME, THREAD_SECTION, thread_sections
from folioscope.plans.registry import Tables, query
from folioscope.sources.scratch import new_path
from folioscope.streaming import counters, price
from folioscope.streaming.run import drain

ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


def threads(t: Tables):
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"), thread_sections().alias("section_id"),
        (F.col("o_orderstatus") == "P").alias("is_deleted"), (F.col("o_orderkey") % 5 == 0).alias("is_locked"), F.concat_ws(" ", "o_orderpriority", F.expr("repeat('body text ', CAST(o_orderkey % 60 AS INT))")).alias("body"),
    )


THREADS = f"(SELECT o_orderkey AS id, o_custkey AS author_id, o_totalprice AS score, o_orderdate AS created_at, {THREAD_SECTION} AS section_id, o_orderstatus = 'P' AS is_deleted, o_orderkey % 5 = 0 AS is_locked, o_orderpriority || ' ' || repeat('body text ', CAST(o_orderkey % 60 AS INT)) AS body FROM orders)"


def profiles(t: Tables):
    return t.customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("handle"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("display_name"), F.when(F.col("c_custkey") % 10 == 0, "moderator").otherwise("member").alias("role"))


PROFILES = "(SELECT c_custkey AS id, c_name AS handle, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS display_name, CASE WHEN c_custkey % 10 = 0 THEN 'moderator' ELSE 'member' END AS role FROM customer WHERE c_custkey % 7 <> 0)"


def posts(t: Tables):
    return t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("thread_id"), F.col("l_shipdate").alias("created_at"), (F.col("l_returnflag") == "R").alias("is_deleted"))


POSTS = "(SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS thread_id, l_shipdate AS created_at, l_returnflag = 'R' AS is_deleted FROM lineitem)"


def votes(t: Tables):
    return t.events.select("event_id", "ts", "user_id", F.lit("thread").alias("target_type"), (F.col("event_id") % 97).alias("target_id"), F.when(F.col("value") >= 100, 1).otherwise(-1).cast("long").alias("value"))


VOTES = "(SELECT event_id, ts, user_id, 'thread' AS target_type, event_id % 97 AS target_id, CASE WHEN value >= 100 THEN 1 ELSE -1 END AS value FROM events)"
SCORES = f"(SELECT target_type, target_id, CAST(sum(value) AS BIGINT) AS score FROM (SELECT target_type, target_id, user_id, arg_max(value, (ts, event_id)) AS value FROM {VOTES} GROUP BY ALL) GROUP BY ALL)"


@query("SELECT event_id AS id, coalesce(s.score, 0) AS score FROM events e LEFT JOIN (SELECT target_id, CAST(sum(value) AS BIGINT) AS score FROM (SELECT event_id % 97 AS target_id, user_id, arg_max(CASE WHEN value >= 100 THEN 1 ELSE -1 END, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) GROUP BY 1) s ON s.target_id = e.event_id")
def h3_post_scores(t):
    rows = votes(t).drop("target_type").join(t.events.select("event_id", F.when(F.col("event_type") == "view", "post").otherwise("thread").alias("target_type")), "event_id")
    return O.apply_scores(t.events.select(F.col("event_id").alias("id")), rows, "post")


def post_events(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("thread_id"), F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), F.array(F.lit("insert"), F.lit("delete"))).otherwise(F.array(F.lit("insert"))).alias("ops"), (F.col("l_returnflag") == "R").alias("is_deleted"))
    return rows.select("thread_id", F.explode("ops").alias("op"), "is_deleted")


COUNTS = "(SELECT l_orderkey AS thread_id, CAST(greatest(0, sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 0 ELSE 1 END)) AS BIGINT) AS reply_count FROM lineitem GROUP BY 1)"


@query("SELECT c_custkey AS id, 'p' || c_custkey AS x_user_id, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey WHEN c_custkey % 3 = 1 THEN c_name ELSE 'user_' || left(CAST(c_custkey AS VARCHAR), 8) END AS handle, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey ELSE 'New member' END AS display_name, CAST(NULL AS VARCHAR) AS avatar_url, 'member' AS role FROM customer WHERE c_custkey % 7 = 0")
def c14_profile_from_signup(t):
    k = F.col("c_custkey") % 3
    meta = F.to_json(F.struct(F.concat(F.lit("p"), "c_custkey").alias("provider_id"), F.when(k == 0, F.concat(F.lit("u"), "c_custkey")).alias("user_name")))
    rows = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(k == 1, F.concat("c_name", F.lit("@host"))).alias("email"), meta.alias("meta"))
    return O.profile_from_signup(rows, profiles(t))


@query(f"SELECT id FROM {THREADS} WHERE NOT is_deleted")
def d3_visible_rows(t):
    return O.visible_rows(threads(t)).select("id")


@query("SELECT o_orderkey AS id, o_custkey AS author_id FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus <> 'P') AND o_orderstatus <> 'P'")
def d5_get_by_id(t):
    first = t.orders.where("o_orderstatus <> 'P'").agg(F.min("o_orderkey")).first()[0]
    return O.get_by_id(threads(t), first).select("id", "author_id")


@query(f"SELECT t.id, t.author_id, score, section_id, left(body, 280) AS body_preview, p.handle AS author_handle, p.display_name AS author_display_name, p.role AS author_role FROM {THREADS} t JOIN {PROFILES} p ON p.id = t.author_id WHERE NOT is_deleted")
def p6_thread_list(t):
    return O.thread_list(threads(t), profiles(t)).select("id", "author_id", "score", "section_id", "body_preview", "author_handle", "author_display_name", "author_role")


@query(f"SELECT t.id, coalesce(handle, 'member') AS author_handle, coalesce(display_name, handle, 'Community member') AS author_display_name, coalesce(role, 'member') AS author_role FROM {THREADS} t LEFT JOIN {PROFILES} p ON p.id = t.author_id")
def p7_author_defaults(t):
    return O.with_author_defaults(threads(t), profiles(t)).select("id", "author_handle", "author_display_name", "author_role")


@query(f"""SELECT a.id, CASE WHEN kind = 'moderate' AND NOT mod THEN 'not a moderator' WHEN kind = 'thread' AND title_len NOT BETWEEN 3 AND 300 THEN 'title length' WHEN kind IN ('thread', 'post') AND body_len NOT BETWEEN 1 AND 20000 THEN 'body length' WHEN kind = 'vote' AND value NOT IN (-1, 1) THEN 'vote value'
  WHEN kind = 'report' AND reason_len NOT BETWEEN 1 AND 1000 THEN 'reason length' WHEN kind IN ('thread', 'post') AND a.score <> 0 THEN 'counters are not the client''s' WHEN kind <> 'thread' AND t.id IS NULL THEN 'no such thread' WHEN kind = 'post' AND NOT mod AND is_deleted THEN 'thread deleted' WHEN kind = 'post' AND NOT mod AND is_locked THEN 'thread locked' ELSE 'ok' END AS verdict
  FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + CASE WHEN l_suppkey % 11 = 0 THEN 100000000 ELSE 0 END AS thread_id, CASE l_linenumber WHEN 1 THEN 'thread' WHEN 2 THEN 'post' WHEN 3 THEN 'vote' WHEN 4 THEN 'report' WHEN 5 THEN 'moderate' ELSE 'post' END AS kind, l_suppkey % 3 = 0 AS mod, l_partkey % 310 AS title_len, l_partkey * 50 AS body_len, l_partkey % 3 - 1 AS value, l_partkey % 1100 AS reason_len, CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS score FROM lineitem) a
  LEFT JOIN {THREADS} t ON t.id = a.thread_id""")
def p9_validate_writes(t):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(n == 1, "thread").when(n == 3, "vote").when(n == 4, "report").when(n == 5, "moderate").otherwise("post")
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 8 + n).alias("id"), (F.col("l_orderkey") + F.when(F.col("l_suppkey") % 11 == 0, 100000000).otherwise(0)).alias("thread_id"), kind.alias("kind"), (F.col("l_suppkey") % 3 == 0).alias("is_moderator"),
        (p % 310).alias("title_len"), (p * 50).alias("body_len"), (p % 3 - 1).alias("value"), (p % 1100).alias("reason_len"), F.lit("thread").alias("target_type"), F.when(p % 17 == 0, 1).otherwise(0).alias("score"),
    )
    return O.validate_writes(rows, threads(t)).select("id", "verdict")


@query("SELECT doc_id, coalesce(doc_id % 500 IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS is_moderator, CASE WHEN n_chars % 4 = 0 AND NOT coalesce(doc_id % 500 IN (SELECT doc_id FROM labels WHERE quality = 1), false) THEN 'not a moderator' WHEN n_chars % 4 > 0 AND n_chars > 20000 THEN 'body length' ELSE 'ok' END AS verdict FROM documents")
def p9_roles(t):
    """Documents as attempts of 500 users, whose roles stand in labels; a quarter of them are moderation."""
    d, k = t.documents, F.col("n_chars") % 4
    rows = d.select("doc_id", (F.col("doc_id") % 500).alias("user_id"), F.lit(True).alias("is_moderator"), F.when(k == 0, "moderate").otherwise("post").alias("kind"), F.lit(3).alias("title_len"), F.col("n_chars").alias("body_len"), F.lit(1).alias("value"), F.lit(1).alias("reason_len"), F.lit("thread").alias("target_type"), F.lit(0).alias("score"), F.col("doc_id").alias("thread_id"))
    held = d.select(F.col("doc_id").alias("id"), F.lit(False).alias("is_locked"), F.lit(False).alias("is_deleted"))
    profiles_ = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "moderator").otherwise("member").alias("role"))
    return O.validate_writes(O.with_roles(rows, profiles_), held).select("doc_id", "is_moderator", "verdict")


ACTIONS = "(SELECT user_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'keep' END AS action, event_id AS target_id FROM events)"


@query(f"SELECT t.id, is_deleted OR EXISTS (SELECT 1 FROM {ACTIONS} a WHERE a.action = 'delete' AND a.target_id = t.id AND a.user_id % 10 = 0) AS is_deleted FROM {THREADS} t")
def p10_moderation(t):
    acts = t.events.select("user_id", F.when(F.col("event_type") == "error", "delete").otherwise("keep").alias("action"), F.col("event_id").alias("target_id"))
    mods = t.events.where("user_id % 10 = 0").select(F.col("user_id").alias("id")).distinct()
    return O.apply_moderation(threads(t), acts, mods).select("id", "is_deleted")


@query(f"SELECT * FROM {SCORES}")
def h1_score_from_votes(t):
    return O.score_from_votes(votes(t))


@query(f"SELECT * FROM {COUNTS}")
def h2_reply_counts(t):
    return O.reply_counts(post_events(t))


_LOG = "(SELECT doc_id, source AS thread_id, n_chars % 50 AS k, CASE WHEN doc_id * 7919 % 100 < 48 THEN 'delete' ELSE 'insert' END AS op FROM documents)"


@query(f"SELECT thread_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(CASE op WHEN 'insert' THEN 1 ELSE -1 END AS BIGINT) ORDER BY k, doc_id)), lambda a, b: greatest(0, a + b)) AS reply_count FROM {_LOG} GROUP BY 1")
def h2_floored_counts(t):
    """Logs with deletes before their inserts: every delete stops at 0."""
    rows = t.documents.select("doc_id", F.col("source").alias("thread_id"), (F.col("n_chars") % 50).alias("k"), F.when(F.col("doc_id") * 7919 % 100 < 48, "delete").otherwise("insert").alias("op"))
    return O.reply_counts(rows, order=("k", "doc_id"))


@query(f"SELECT t.id, coalesce(s.score, 0) AS score, coalesce(c.reply_count, 0) AS reply_count FROM {THREADS} t LEFT JOIN {SCORES} s ON s.target_id = t.id LEFT JOIN {COUNTS} c ON c.thread_id = t.id")
def h3_apply_counters(t):
    return O.apply_counters(threads(t), votes(t), post_events(t)).select("id", "score", "reply_count")


@query("""SELECT *, errors > 0 OR p95 > slo_p95 OR p99 > slo_p99 AS failed FROM (SELECT event_type AS name, count(*) AS n, count(*) FILTER (event_id % 50 = 0 AND event_type = 'click') AS errors,
  coalesce(quantile_disc(value, 0.95) FILTER (NOT (event_id % 50 = 0 AND event_type = 'click')), 0) AS p95, coalesce(quantile_disc(value, 0.99) FILTER (NOT (event_id % 50 = 0 AND event_type = 'click')), 0) AS p99, CAST(300 AS DOUBLE) AS slo_p95, CAST(750 AS DOUBLE) AS slo_p99 FROM events GROUP BY 1)""")
def h10_latency_report(t):
    rows = t.events.select(F.col("event_type").alias("name"), F.col("value").alias("ms"), (~((F.col("event_id") % 50 == 0) & (F.col("event_type") == "click"))).alias("ok"))
    return O.latency_report(rows)


_COUNTED = f"(SELECT k.theme, count(o.o_orderkey) AS n FROM (VALUES ('business'), ('financials'), ('risks'), ('governance'), ('offering'), ('general')) k(theme) LEFT JOIN orders o ON coalesce({THEME}, 'general') = k.theme GROUP BY 1)"


@query(f"SELECT * FROM {_COUNTED}")
def h11_theme_counts(t):
    return O.theme_counts(threads(t))


@query(f"SELECT m.section_id, m.theme, coalesce(n, 0) AS n FROM (VALUES ('key-risk-themes', 'risks'), ('use-of-proceeds', 'offering'), ('control-governance', 'governance')) m(section_id, theme) LEFT JOIN {_COUNTED} c ON c.theme = m.theme")
def h11_brief_section_counts(t):
    return O.brief_section_counts(threads(t), {"key-risk-themes": "risks", "use-of-proceeds": "offering", "control-governance": "governance"})


@query(f"SELECT id, score, true AS has_more FROM {THREADS} WHERE NOT is_deleted AND score < 200000 ORDER BY score DESC, created_at DESC, id DESC LIMIT 25")
def i1_keyset_page(t):
    far = dt.datetime(1900, 1, 1)
    return O.thread_page(threads(t), "score", (200000.0, far, 0)).select("id", "score", "has_more")


@query(f"WITH r AS (SELECT id, created_at FROM {THREADS} WHERE NOT is_deleted AND created_at < TIMESTAMP '1997-01-01' ORDER BY created_at DESC, id DESC LIMIT 41) SELECT *, (SELECT count(*) > 40 FROM r) AS has_more FROM r ORDER BY created_at DESC, id DESC LIMIT 40")
def i1_recent_page(t):
    return O.thread_page(threads(t), "recent", (dt.datetime(1997, 1, 1), -1), 40).select("id", "created_at", "has_more")


@query(f"WITH c AS (SELECT score, created_at, id FROM {THREADS} WHERE NOT is_deleted ORDER BY score, created_at, id LIMIT 1 OFFSET 10), r AS (SELECT t.id, t.score FROM {THREADS} t, c WHERE NOT t.is_deleted AND (t.score, t.created_at, t.id) < (c.score, c.created_at, c.id)) SELECT *, count(*) OVER () > 25 AS has_more FROM r")
def i1_last_page(t):
    rows = O.visible_rows(threads(t)).orderBy("score", "created_at", "id").limit(11).collect()  # the cursor of a reader near the end
    return O.thread_page(threads(t), "score", tuple(rows[-1][c] for c in ("score", "created_at", "id"))).select("id", "score", "has_more")


@query(f"SELECT id, created_at FROM {POSTS} WHERE thread_id = (SELECT min(l_orderkey) FROM lineitem) AND NOT is_deleted ORDER BY created_at, id LIMIT 50")
def i2_posts_page(t):
    first = t.lineitem.agg(F.min("l_orderkey")).first()[0]
    return O.posts_page(posts(t), first).select("id", "created_at")


@query("SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) WHERE rank <= 3")
def i3_first_pages(t):
    rows = t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), F.lit(False).alias("is_deleted"))
    return O.first_page_per_thread(rows, 3).select(F.col("thread_id").alias("conv_id"), F.col("id").alias("turn"), "rank")


@query(f"SELECT id, score FROM (SELECT id, score, {THEME.replace('o_orderpriority', 'section_of')} AS theme FROM (SELECT o_orderkey AS id, o_totalprice AS score, o_orderpriority AS section_of FROM orders)) WHERE theme = 'offering'")
def i4_thread_feed(t):
    rows = threads(t).withColumn("theme", R.resolve_theme(F.col("section_id"))).withColumn("pos", F.col("id"))
    return O.thread_feed(rows, "offering").select("id", "score")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY ts, event_id LIMIT 25")
def i5_report_queue(t):
    rows = t.events.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return O.report_queue(rows, moderator=True).select("id", "created_at")


@query("""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + CASE WHEN turn = 0 OR turn % 5 = 4 THEN 999 ELSE turn // 2 END AS parent_id FROM conversations WHERE NOT (turn > 0 AND turn // 2 = turn)),
 t AS (SELECT id, id AS root_id, 0 AS depth FROM p WHERE parent_id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, t.root_id, t.depth + 1 FROM p JOIN t ON p.parent_id = t.id)
 SELECT id, root_id, CAST(depth AS BIGINT) AS depth, CAST(least(depth, 4) AS BIGINT) AS indent FROM t""")
def i14_post_tree(t):
    turn = F.col("turn")
    rows = t.conversations.select((F.col("conv_id") * 1000 + turn).alias("id"), (F.col("conv_id") * 1000 + F.when((turn == 0) | (turn % 5 == 4), 999).otherwise(F.floor(turn / 2))).alias("parent_id"))
    return O.post_tree(rows).select("id", "root_id", "depth", "indent")


@query("SELECT event_id, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS bucket FROM events")
def l1_bucket_start(t):
    return t.events.select("event_id", L.bucket_start(F.col("ts"), 3600).cast("timestamp_ntz").alias("bucket"))


SMALL_LIMITS = (("vote", 1, "user", 86400, 2), ("vote", 2, "user", 604800, 5), ("vote", 3, "ip", 3600, 3), ("post", 1, "user", 86400, 1), ("post", 2, "ip", 86400, 4))


def attempts(t: Tables):
    e = F.col("event_type")
    return t.events.select("event_id", "ts", (F.col("user_id") % 40).alias("user_id"), F.when(F.col("event_id") % 13 == 0, "unknown").otherwise(F.concat(F.lit("ip"), F.col("user_id") % 9)).alias("ip"), F.when(e.isin("click", "view"), "vote").when(e == "purchase", "post").otherwise("other").alias("action"))


def cascade(limits) -> str:
    """SQL of the cascade: each step numbers the rows that are still passing."""
    sql = "(SELECT event_id, ts, user_id % 40 AS user_id, CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE 'ip' || (user_id % 9) END AS ip, CASE WHEN event_type IN ('click', 'view') THEN 'vote' WHEN event_type = 'purchase' THEN 'post' ELSE 'other' END AS action FROM events)"
    sql = f"(SELECT *, CASE WHEN action NOT IN ({', '.join(sorted({repr(x[0]) for x in limits}))}) THEN 0 END AS denied_step FROM {sql})"
    for step in sorted({x[1] for x in limits}):
        mine = [x for x in limits if x[1] == step]
        pick = lambda i, q=False, mine=mine: "CASE action " + " ".join(f"WHEN '{x[0]}' THEN {repr(x[i]) if q else x[i]}" for x in mine) + " END"
        sql = f"(SELECT * EXCLUDE (denied_step, scope, secs, most, n), CASE WHEN denied_step IS NULL AND scope IS NOT NULL AND n > most THEN {step} ELSE denied_step END AS denied_step FROM (SELECT *, row_number() OVER (PARTITION BY denied_step IS NULL, scope, CASE scope WHEN 'user' THEN CAST(user_id AS VARCHAR) ELSE ip END, action, floor(epoch(ts) / secs) ORDER BY ts, event_id) AS n FROM (SELECT *, {pick(2, True)} AS scope, {pick(3)} AS secs, {pick(4)} AS most FROM {sql})))"
    return sql


@query(f"SELECT event_id, CAST(coalesce(denied_step, -1) AS BIGINT) AS denied_step, denied_step IS NULL AS allowed FROM {cascade(SMALL_LIMITS)}")
def l2_rate_limit(t):
    return L.rate_limit(attempts(t), SMALL_LIMITS).select("event_id", F.coalesce("denied_step", F.lit(-1)).alias("denied_step"), "allowed")


@query(
    f"WITH j AS {cascade(SMALL_LIMITS)} SELECT scope, subject, action, CAST(secs AS BIGINT) AS window_seconds, to_timestamp(floor(epoch(ts) / secs) * secs)::TIMESTAMP AS window_start, count(*) AS count FROM (SELECT j.*, r.*, CASE r.scope WHEN 'user' THEN CAST(user_id AS VARCHAR) ELSE ip END AS subject FROM j JOIN (VALUES "
    + ", ".join(f"('{a}', {s}, '{c}', {w})" for a, s, c, w, _ in SMALL_LIMITS)
    + ") r(act, step, scope, secs) ON r.act = j.action WHERE denied_step IS NULL OR (denied_step >= step AND denied_step > 0)) GROUP BY ALL"
)
def l3_buckets(t):
    return L.rate_limit_buckets(attempts(t), SMALL_LIMITS).select("scope", "subject", "action", "window_seconds", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "count")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ip' || user_id WHEN event_id % 3 = 1 THEN '10.0.0.1' ELSE 'unknown' END AS ip FROM events")
def l4_client_ip(t):
    from folioscope.functions.text import client_ip

    k = F.col("event_id") % 3
    fwd = F.when(k == 0, F.concat(F.lit("  ip"), "user_id", F.lit(" , proxy"))).when(k == 1, " , x")
    return t.events.select("event_id", client_ip(fwd, F.when(k == 1, ""), F.when(k == 1, "10.0.0.1")).alias("ip"))


@query("SELECT event_id, value AS price FROM events WHERE event_type <> 'error' AND event_id % 4 <> 1")
def n1_parse_mids(t):
    k = F.col("event_id") % 4
    body = F.concat(F.lit('{"channel":"'), F.when(F.col("event_type") == "error", "other").otherwise("allMids"), F.lit('","data":{"mids":{"'), F.when(k == 1, "other").otherwise("coin"), F.lit('":"'), F.col("value").cast("string"), F.lit('"}}}'))
    rows = t.events.select(F.col("event_id").alias("ts"), body.alias("value"))
    return price.parse_mids(rows, "coin").select(F.col("ts").alias("event_id"), "price")


@query("SELECT event_id, CASE WHEN value > b THEN 'up' WHEN value < b THEN 'down' ELSE 'flat' END AS direction FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events)")
def n2_tick_direction(t):
    return price.tick_direction(t.events, "event_type", "ts", "value", "event_id").select("event_id", "direction")


_GAP = 900


@query(f"""WITH g AS (SELECT event_type AS coin, ts, lag(ts) OVER w AS b, coalesce(lead(ts) OVER w, TIMESTAMP '2030-01-01') AS a FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
 SELECT coin, ts AS at, 'live' AS status FROM g WHERE b IS NULL OR epoch(ts) - epoch(b) > {_GAP} UNION ALL SELECT coin, ts + INTERVAL {_GAP} SECOND, 'stale' FROM g WHERE epoch(a) - epoch(ts) > {_GAP}""")
def n3_staleness(t):
    rows = t.events.select(F.col("event_type").alias("coin"), "ts")
    return price.staleness(rows, "2030-01-01 00:00:00", _GAP).select("coin", F.col("at").cast("timestamp_ntz").alias("at"), "status")


@query("SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS window_start, user_id, event_type AS action, count(*) AS n FROM events GROUP BY ALL")
def n4_rate_counts(t):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("action"))
    return counters.rate_counts_stream(rows, 3600).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "action", "n")


def event_stream(t: Tables):
    """The table of events as a stream of files, all in one batch: the files needn't be in time order."""
    path = f"{t.sf_dir}/events.parque[t]"
    rows = t.spark.readStream.schema(t.events.schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT to_timestamp(b * 3600)::TIMESTAMP AS window_start, user_id, action, count(*) AS n FROM (SELECT floor(epoch(ts) / 3600) AS b, user_id, event_type AS action FROM events) WHERE (b + 1) * 3600 <= (SELECT floor(epoch_ms(max(ts)) / 1000.0 - 60) FROM events) GROUP BY ALL")
def n4_rate_counts_stream(t):
    rows = event_stream(t).withColumnRenamed("event_type", "action")
    out = drain(counters.rate_counts_stream(rows, 3600, "1 minute"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "action", "n")


@query("SELECT target_id, CAST(sum(value) AS BIGINT) AS score FROM (SELECT user_id, event_id % 97 AS target_id, arg_max(CASE WHEN value >= 100 THEN 1 ELSE -1 END, (ts, event_id)) AS value FROM events GROUP BY ALL) GROUP BY 1")
def n5_votes_stream(t):
    rows = event_stream(t).select("event_id", "ts", "user_id", (F.col("event_id") % 97).alias("target_id"), F.when(F.col("value") >= 100, 1).otherwise(-1).cast("long").alias("value"))
    path = new_path(t.spark, "votes")
    fold = lambda batch, epoch: counters.fold_votes(batch, path, epoch, 16)
    rows.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(fold).start().awaitTermination()
    return counters.folded_scores(t.spark, f"{path}/scores")
