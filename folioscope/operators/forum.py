"""Forum jobs over threads, posts, votes and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.operators.rules import THEMES, resolve_theme
from folioscope.sources.scratch import bounded, cut

#: Page sizes, preview length and the targets of the latency report.
MOST_ROWS, PAGE, POSTS_PAGE, PREVIEW = 100, 25, 50, 280
SLO = {"write:vote": (750.0, 2000.0), "read:posts": (400.0, 1000.0)}
DEFAULT_SLO = (300.0, 750.0)


def visible_rows(df: DataFrame, moderator: bool = False) -> DataFrame:
    return df if moderator else df.where(~F.col("is_deleted"))


def get_by_id(df: DataFrame, id_, id_col: str = "id") -> DataFrame:
    return visible_rows(df).where(F.col(id_col) == id_).limit(1)


def page_limit(limit: int | None, default: int = PAGE) -> int:
    return default if limit is None else min(max(int(limit), 1), MOST_ROWS)


def after_cursor(order: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Rows strictly after the cursor in an order of (column, descending), compared as tuples."""
    out, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, cursor, strict=True):
        c = F.col(name)
        out = out | (equal & ((c < F.lit(value)) if down else (c > F.lit(value))))
        equal = equal & (c == F.lit(value))
    return out


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], cursor: tuple | None = None, limit: int | None = None, default: int = PAGE) -> DataFrame:
    """One page of rows and a column has_more: whether a row follows.

    The next cursor is the last row's order columns. It is a top-k, so no full sort and no offset;
    limits are held to 1 to 100.
    """
    n = page_limit(limit, default)
    rows = df if cursor is None else df.where(after_cursor(order, cursor))
    top = rows.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order]).limit(n + 1)
    rank = Window.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order])  # over n + 1 rows
    numbered = top.withColumn("_n", F.row_number().over(rank)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > n)
    return numbered.where(F.col("_n") <= n).drop("_n")


def thread_page(threads: DataFrame, sort: str = "score", cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    order = [("score", True)] * (sort == "score") + [("created_at", True), ("id", True)]
    return keyset_page(visible_rows(threads), order, cursor, limit)


def posts_page(posts: DataFrame, thread_id, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    return keyset_page(visible_rows(posts).where(F.col("thread_id") == thread_id), [("created_at", False), ("id", False)], cursor, limit, POSTS_PAGE)


def first_page_per_thread(posts: DataFrame, n: int = POSTS_PAGE) -> DataFrame:
    w = Window.partitionBy("thread_id").orderBy("created_at", "id")
    return visible_rows(posts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def thread_feed(threads: DataFrame, theme: str | None = "all", sort: str = "score") -> DataFrame:
    """Threads of a theme (None: those without one, "all": all) by score or recency; ties keep their position."""
    rows = threads if theme == "all" else threads.where(F.col("theme").isNull() if theme is None else F.col("theme") == theme)
    return rows.orderBy(F.desc("score" if sort == "score" else "created_at"), "pos")


def report_queue(reports: DataFrame, cursor: tuple | None = None, limit: int | None = None, moderator: bool = False) -> DataFrame:
    """A page of open reports, oldest first; only a moderator sees any."""
    rows = reports.where("status = 'open'") if moderator else reports.where(F.lit(False))
    return keyset_page(rows, [("created_at", False), ("id", False)], cursor, limit)


def with_roles(attempts: DataFrame, profiles: DataFrame, user: str = "user_id") -> DataFrame:
    """attempts with is_moderator as the users' profiles (id, role) say; users without a profile are none, and a user with several is one if any says so.

    Only moderators' ids are joined.
    """
    mods = bounded(profiles.where("role = 'moderator'").select(F.col("id").alias("_mod")).distinct(), "moderators")
    return attempts.drop("is_moderator").join(mods, F.col(user) == F.col("_mod"), "left").withColumn("is_moderator", F.col("_mod").isNotNull()).drop("_mod")


def profile_from_signup(signups: DataFrame, profiles: DataFrame) -> DataFrame:
    """New profiles from (user_id, email, meta JSON) rows; ids that have one are left alone.

    handle: user_name, else the mail address's local part, else `user_` and the id's first 8
    characters. display_name: full_name, user_name, `New member`. Of several rows of a user one counts.
    """
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    rows = signups.join(profiles.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    rows = rows.groupBy("user_id").agg(F.min(F.struct("meta", "email")).alias("x")).select("user_id", "x.*")
    handle = F.coalesce(get("user_name"), F.split_part("email", F.lit("@"), F.lit(1)), F.concat(F.lit("user_"), F.substring(F.col("user_id").cast("string"), 1, 8)))
    display = F.coalesce(get("full_name"), get("user_name"), F.lit("New member"))
    return rows.select(F.col("user_id").alias("id"), get("provider_id").alias("x_user_id"), handle.alias("handle"), display.alias("display_name"), get("avatar_url").alias("avatar_url"), F.lit("member").alias("role"))


def thread_list(threads: DataFrame, profiles: DataFrame, preview: int = PREVIEW) -> DataFrame:
    """Threads that aren't deleted with their author's handle, name and role, and a preview of the body."""
    p = profiles.select(F.col("id").alias("author_id"), F.col("handle").alias("author_handle"), F.col("display_name").alias("author_display_name"), F.col("role").alias("author_role"))
    return visible_rows(threads).withColumn("body_preview", F.substring("body", 1, preview)).drop("body").join(p, "author_id")


def with_author_defaults(df: DataFrame, profiles: DataFrame) -> DataFrame:
    p = profiles.select(F.col("id").alias("author_id"), F.col("handle").alias("_h"), F.col("display_name").alias("_d"), F.col("role").alias("_r"))
    rows = df.join(p, "author_id", "left")
    return rows.withColumn("author_handle", F.coalesce("_h", F.lit("member"))).withColumn("author_display_name", F.coalesce("_d", "_h", F.lit("Community member"))).withColumn("author_role", F.coalesce("_r", F.lit("member"))).drop("_h", "_d", "_r")


def latest_votes(votes: DataFrame) -> DataFrame:
    """The last value of each (user, target); ties in time go to the larger event id."""
    return votes.groupBy("user_id", "target_type", "target_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def score_from_votes(votes: DataFrame) -> DataFrame:
    """(target_type, target_id, score). The first grouping is by voter, so a hot target isn't a hot key until it is summed in part."""
    return latest_votes(votes).groupBy("target_type", "target_id").agg(F.sum("value").cast("long").alias("score"))


def reply_counts(events: DataFrame, count_deleted: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """(thread_id, reply_count) from insert and delete events; soft-deleted posts count unless told otherwise.

    With order, columns that put a thread's events in order, every delete stops at 0, as floored_sums says. Without it the net count does, which
    is the same where each delete comes after its insert.
    """
    rows = events if count_deleted else events.where(~F.coalesce("is_deleted", F.lit(False)))
    step = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    if order:
        return floored_sums(rows.withColumn("_step", step), "thread_id", "_step", order).withColumnRenamed("total", "reply_count")
    return rows.groupBy("thread_id").agg(F.greatest(F.lit(0), F.sum(step)).cast("long").alias("reply_count"))


def floored_sums(rows: DataFrame, key: str, step: str, order: tuple[str, ...]) -> DataFrame:
    """(key, total): a key's steps added up in order, where a sum that would fall under 0 becomes 0.

    A run of steps is summed up by its sum and its least prefix sum, and two runs side by side by
    these alone. So rows are sorted into ranges of (key, order), whatever a key's size, each range
    yields a pair a key, and a key's pairs, one a range at most, are put together in order. A null
    key is a key, null steps count as 0, and rows equal in key and order must have equal steps.
    """
    names = [f"_o{i}" for i in range(len(order))]
    plain = rows.select(F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)], F.coalesce(F.col(step).cast("long"), F.lit(0)).alias("step"))

    def run(batches):
        at = TaskContext.get().partitionId()
        held = None  # the last key so far, its sum and least prefix sum
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, steps = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            codes = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            run_sum = np.cumsum(steps)
            before = np.concatenate([[0], run_sum])[start]
            total = np.concatenate([run_sum, [0]])[np.concatenate([start[1:], [n]]) - 1] - before
            least = np.minimum.reduceat(run_sum, start) - before
            found = list(zip(keys.take(pa.array(start)).to_pylist(), total.tolist(), least.tolist(), strict=True))
            if held and held[0] == found[0][0]:
                found[0] = (held[0], held[1] + found[0][1], min(held[2], held[1] + found[0][2]))
            elif held:
                found.insert(0, held)
            held = found.pop()
            if found:
                yield table(found, at)
        if held:
            yield table([held], at)

    def table(found, at):
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([at] * len(found), pa.int32()), *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)]], ["key", "at", "total", "least"])

    kind = to_arrow_type(plain.schema["key"].dataType)
    ranged = plain.repartitionByRange("key", *names).sortWithinPartitions("key", *names).select("key", "step")
    pairs = ranged.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, at int, total long, least long")
    pairs = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "total", "least"))).alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("m"))
    both = F.aggregate("p", zero, lambda a, x: F.struct((a["s"] + x["total"]).alias("s"), F.least(a["m"], a["s"] + x["least"]).alias("m")))
    return pairs.select("key", both.alias("b")).select(F.col("key").alias(key), (F.col("b.s") - F.col("b.m")).alias("total"))


def apply_scores(rows: DataFrame, votes: DataFrame, target_type: str) -> DataFrame:
    """Threads or posts with their score computed anew from the votes on that type; 0 without any."""
    s = score_from_votes(votes.where(F.col("target_type") == target_type)).select(F.col("target_id").alias("id"), F.col("score").alias("_s"))
    return rows.join(s, "id", "left").withColumn("score", F.coalesce("_s", F.lit(0))).drop("_s")


def apply_counters(threads: DataFrame, votes: DataFrame, post_events: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """threads with score and reply_count computed anew; 0 without any. order: as for reply_counts."""
    r = reply_counts(post_events, order=order).select(F.col("thread_id").alias("id"), F.col("reply_count").alias("_r"))
    rows = apply_scores(threads, votes, "thread").join(r, "id", "left")
    return rows.withColumn("reply_count", F.coalesce("_r", F.lit(0))).drop("_r")


def validate_writes(attempts: DataFrame, threads: DataFrame) -> DataFrame:
    """attempts with verdict: `ok` or the first rule broken.

    attempts: kind (thread, post, vote, report, moderate), is_moderator (see with_roles), title_len, body_len, value,
    reason_len, target_type, score, thread_id. A moderator may write in locked and deleted threads; moderation
    needs one.
    """
    t = threads.select(F.col("id").alias("thread_id"), F.col("is_locked").alias("_locked"), F.col("is_deleted").alias("_deleted"), F.lit(True).alias("_there"))
    rows = attempts.join(t, "thread_id", "left")
    k, mod, n = F.col("kind"), F.coalesce("is_moderator", F.lit(False)), lambda c: F.coalesce(c, F.lit(0))
    verdict = (
        F.when(~k.isin("thread", "post", "vote", "report", "moderate"), "unknown action")
        .when((k == "moderate") & ~mod, "not a moderator")
        .when((k == "thread") & ~n("title_len").between(3, 300), "title length")
        .when(k.isin("thread", "post") & ~n("body_len").between(1, 20000), "body length")
        .when(k.isin("vote", "report") & ~F.coalesce(F.col("target_type"), F.lit("")).isin("thread", "post"), "target type")
        .when((k == "vote") & ~n("value").isin(-1, 1), "vote value")
        .when((k == "report") & ~n("reason_len").between(1, 1000), "reason length")
        .when(k.isin("thread", "post") & (n("score") != 0), "counters are not the client's")
        .when((k != "thread") & F.col("_there").isNull(), "no such thread")
        .when((k == "post") & ~mod & F.col("_deleted"), "thread deleted")
        .when((k == "post") & ~mod & F.col("_locked"), "thread locked")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).drop("_locked", "_deleted", "_there")


def apply_moderation(rows: DataFrame, actions: DataFrame, moderators: DataFrame) -> DataFrame:
    """rows with is_deleted set where a moderator's delete action names them; nothing is ever cleared."""
    hits = actions.where("action = 'delete'").join(moderators.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(F.col("target_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, "id", "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_hit").isNotNull()).drop("_hit")


def nearest_ranks(samples: DataFrame, percents: tuple[int, ...] = (95, 99)) -> DataFrame:
    """(name, p<percent>...) of samples (name, ms): exact percentiles by nearest rank.

    Counts by whole milliseconds place each rank in one millisecond; only its values are then
    counted. So a task has a name's milliseconds, or the values of one of them, and not its samples.
    """
    # a join drops null names, so a name is told by what is never null
    rows = samples.where("ms is not null").select("ms", F.floor("ms").alias("whole"), F.col("name").isNull().alias("none"), F.coalesce("name", F.lit("")).alias("name"))
    upto = Window.partitionBy("none", "name").orderBy("whole")
    counts = rows.groupBy("none", "name", "whole").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("none", "name")))
    ranks = counts.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("rank", F.ceil(F.col("n") * F.col("percent") / F.lit(100)))
    ranks = ranks.where("rank > upto - c and rank <= upto").select("none", "name", "whole", "percent", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    values = rows.join(ranks, ["none", "name", "whole"]).groupBy("none", "name", "percent", "rank", "ms").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy("none", "name", "percent").orderBy("ms"))).where("rank > upto - c and rank <= upto")
    return values.groupBy("none", "name").agg(*[F.max(F.when(F.col("percent") == p, F.col("ms"))).alias(f"p{p}") for p in percents]).select(F.when(~F.col("none"), F.col("name")).alias("name"), *[f"p{p}" for p in percents])


def latency_report(samples: DataFrame, slo: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """(name, n, errors, p95, p99, slo_p95, slo_p99, failed); percentiles by nearest rank over successes, 0 without any.

    A null name is a name, and a null ok is an error; samples without ms have no rank.
    """
    samples = samples.withColumn("ok", F.coalesce("ok", F.lit(False)))
    rows = samples.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("errors"))
    if approximate:
        pct = lambda p: F.percentile_approx("ms", p / 100, 10000).alias(f"p{p}")
        ranks = samples.where("ok").groupBy("name").agg(pct(95), pct(99))
    else:
        ranks = nearest_ranks(samples.where("ok").select("name", "ms"))
    ranks = ranks.withColumnRenamed("name", "_name")
    rows = rows.join(ranks, F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name").na.fill(0.0, ["p95", "p99"])
    if slo is None:
        slo = samples.sparkSession.createDataFrame([(k, *v) for k, v in SLO.items()], "name string, p95_ms double, p99_ms double")
    rows = rows.join(F.broadcast(slo), "name", "left").withColumn("slo_p95", F.coalesce("p95_ms", F.lit(DEFAULT_SLO[0]))).withColumn("slo_p99", F.coalesce("p99_ms", F.lit(DEFAULT_SLO[1]))).drop("p95_ms", "p99_ms")
    return rows.withColumn("failed", (F.col("errors") > 0) | (F.col("p95") > F.col("slo_p95")) | (F.col("p99") > F.col("slo_p99")))


def backfill_themes(threads: DataFrame, column: str = "section_id") -> DataFrame:
    return threads.withColumn(column, resolve_theme(F.col(column)))


def theme_counts(threads: DataFrame, column: str = "section_id") -> DataFrame:
    """(theme, n) of every theme, 0 included; threads of no theme are `general`."""
    n = threads.groupBy(F.coalesce(resolve_theme(F.col(column)), F.lit("general")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(threads.sparkSession.createDataFrame([(t,) for t in (*THEMES, "general")], "theme string"))
    return every.join(n, "theme", "left").select("theme", F.coalesce("n", F.lit(0)).alias("n"))


def brief_section_counts(threads: DataFrame, mapping: dict[str, str], column: str = "section_id") -> DataFrame:
    """(section_id, theme, n): threads of each brief section's theme."""
    m = F.broadcast(threads.sparkSession.createDataFrame(list(mapping.items()), "section_id string, theme string"))
    return m.join(theme_counts(threads, column), "theme", "left").select("section_id", "theme", F.coalesce("n", F.lit(0)).alias("n"))


def post_tree(posts: DataFrame, indent: int = 4, with_path: bool = True) -> DataFrame:
    """(id, root_id, depth, path, indent) of posts (id, parent_id): path of ids from the root, indent capped; orphans are roots.

    Pointers to ancestors double each round, so a tree of any depth takes log2(depth) joins, and
    every round is written to the shared folder. Posts on or below a cycle have no root and are left
    out. Paths of a chain grow with the square of its depth; with_path=False leaves them out. Of rows
    that repeat an id the one with the least parent counts, a null one last; rows without an id are left out.
    """
    posts = posts.where("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    kind = posts.schema["id"].dataType.simpleString()
    there = posts.select(F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    rows = posts.select("id", "parent_id").join(there, "parent_id", "left")
    up = F.col("_there").isNotNull()
    # to: an ancestor, depth: steps to it, done: whether it is the root, path: ids from below it to here
    path = (F.when(up, F.array("id")).otherwise(F.array()) if with_path else F.array()).cast(f"array<{kind}>")
    state = cut(rows.select("id", F.when(up, F.col("parent_id")).otherwise(F.col("id")).alias("to"), up.cast("long").alias("depth"), (~up).alias("done"), path.alias("path")), "tree")
    n = state.count()
    for _ in range(n.bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        above = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("done").alias("_done"), F.col("path").alias("_path"))
        moved = state.where("not done").join(above, "to").select("id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"), F.concat("_path", "path").alias("path"))
        state = cut(state.where("done").unionByName(moved.where(F.col("depth") <= n)), "tree")
    out = state.where("done").select("id", F.col("to").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.concat(F.array("to"), "path").alias("path"), F.least("depth", F.lit(indent)).cast("int").alias("indent"))
    return out if with_path else out.drop("path")
