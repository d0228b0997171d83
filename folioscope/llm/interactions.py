"""How document filters interact, in any order, counted on the lattice of their subsets.

A state is the set of filters applied so far. The rows that an edge (state, filter) removes are those
that fail the filter and none of the state's; they don't depend on the order in which the state
was reached. So one pass over the documents counts their failure patterns, and all orders' steps
and the Shapley sums are read from the same n * 2^(n-1) edges, each weighted by the number of
orders that reach its state and leave the next.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Filters an audit may have: it makes n * 3^(n-1) pairs of edges and failure patterns.
MOST_FILTERS = 8
#: Beyond so many filters the orders to report must be named.
MOST_PERMUTED = 6
LETTERS = "ABCDE"


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): documents by what they fail and their labels, n rows each.

    A: under 200 words `[^\\x20\\x09-\\x0D]+`; B: under half of the words distinct; C: over 2 % capitals
    A-Z; D: holds one of #$%&*|; E: a smaller id has the same text. Null texts count as empty, null
    parts as the empty string. Rows without an id are neither copies nor originals; a row repeated
    under one id is no copy of itself. good and toxic: some label of the id says 1; ids without
    labels, and null labels, are neither. Texts are the same if their SHA-256 is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    size = F.size("words")
    rows = rows.select(
        "id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), (size < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * size).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 2 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    rows = rows.groupBy("id", "digest", "part", "A", "B", "C", "D").agg(F.count(F.lit(1)).alias("n"))
    rows = common.cut(rows, "failures")
    # joined by both, so a text with many copies is spread over all tasks
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(first, ["id", "digest"], "left").join(known, "id", "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.groupBy("part", "A", "B", "C", "D", copy.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]).agg(F.sum("n").alias("n"))


def path_counts(n: int, after: Mapping[int, Sequence[int]] | None = None) -> tuple[list[int], list[int]]:
    """For each state the number of orders of filters that reach it from none, and that lead from it to all.

    after: for a filter those that must come before it. States are bit masks of filters.
    """
    before = [sum(1 << g for g in set((after or {}).get(f, ()))) for f in range(n)]
    reach, leave = [0] * (1 << n), [0] * (1 << n)
    reach[0] = leave[-1] = 1
    for s in range(1 << n):
        for f in range(n):
            if not s >> f & 1 and not before[f] & ~s:
                reach[s | 1 << f] += reach[s]
    for s in reversed(range(1 << n)):
        for f in range(n):
            if not s >> f & 1 and not before[f] & ~s:
                leave[s] += leave[s | 1 << f]
    return reach, leave


def audit(rows: DataFrame, filters: Sequence[str] = LETTERS, part: str = "part", count: str = "n", lost: Mapping[str, str | Column] | None = None, after: Mapping[str, Sequence[str]] | None = None, orders: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, one column a name of lost, shapley) for each part, order and step.

    rows: counts of documents by part and by failed filters, one boolean column a filter (null: not
    failed). lost: name -> boolean column, counted among the removed ones. after: filter -> those that
    must come before it; orders that break this are neither listed nor counted. orders: those to list,
    as sequences of all filters; all permutations if there are at most 6 filters. shapley is a
    filter's removed, summed over all orders, listed or not; divided by their number it is the
    Shapley value. filter_order joins the filters' names. Parts are those of rows, so an empty table gives no rows; each
    part has a row for every order and step, with zeros. Repeated rows of the table add up.
    """
    n, lost = len(filters), dict(lost or {})
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    at = {f: i for i, f in enumerate(filters)}
    rules = {at[f]: [at[g] for g in before] for f, before in (after or {}).items()}
    reach, leave = path_counts(n, rules)
    if not reach[-1]:
        raise ValueError("no order of the filters keeps to the rules")
    if orders is None:
        if n > MOST_PERMUTED:
            raise ValueError(f"name the orders to list: {n} filters have too many")
        orders = list(itertools.permutations(filters))
    if any(sorted(o) != sorted(filters) for o in orders):
        raise ValueError("an order names every filter once")
    orders = [o for o in orders if all(o.index(filters[g]) < o.index(filters[f]) for f, before in rules.items() for g in before)]

    spark, every = rows.sparkSession, (1 << n) - 1
    mask = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    marks = {name: F.sum(F.when(F.expr(c) if isinstance(c, str) else c, F.col(count)).otherwise(0)).alias(f"_l{i}") for i, (name, c) in enumerate(lost.items())}
    counts = common.cut(rows.groupBy(F.col(part).alias("_part"), mask.alias("_mask")).agg(F.sum(count).alias("_n"), *marks.values()), "patterns")
    cols = ["_n", *(f"_l{i}" for i in range(len(lost)))]
    none = counts.select("_part").distinct().select("_part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("_mask"), *[F.lit(0).cast("long").alias(c) for c in cols])
    # patterns that pass all filters of the state: the edge's filter removes them or keeps them
    through = []
    for s, f in itertools.product(range(1 << n), range(n)):
        if not s >> f & 1:
            weight = reach[s] * leave[s | 1 << f] if all(s >> g & 1 for g in rules.get(f, ())) else 0
            through += [(s, f, m, bool(m >> f & 1), weight) for m in range(1 << n) if not m & s]
    through = spark.createDataFrame(through, "_state int, _filter int, _mask int, _removes boolean, _weight long")
    edges = (
        counts.unionByName(none).join(F.broadcast(through), "_mask").groupBy("_part", "_state", "_filter", "_weight")
        .agg(F.sum(F.when(F.col("_removes"), 0).otherwise(F.col("_n"))).alias("kept"), *[F.sum(F.when(F.col("_removes"), F.col(c)).otherwise(0)).alias(c) for c in cols])
    )
    own = Window.partitionBy("_part", "_filter")  # 2^(n-1) edges
    alone = F.element_at(F.array(*[F.lit(every ^ 1 << f) for f in range(n)]), F.col("_filter") + 1)  # the state of all others
    edges = edges.select(
        "*", F.sum(F.col("_n") * F.col("_weight")).over(own).alias("shapley"),
        F.max(F.when(F.col("_state") == 0, F.col("_n"))).over(own).alias("_fails"), F.max(F.when(F.col("_state") == alone, F.col("_n"))).over(own).alias("unique_fails"),
    )
    steps = [("".join(o), i + 1, sum(1 << at[f] for f in o[:i]), at[o[i]]) for o in orders for i in range(n)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, _state int, _filter int")
    return edges.join(F.broadcast(steps), ["_state", "_filter"]).select(
        F.col("_part").alias(part), "filter_order", "step", "kept", F.col("_n").alias("removed"), (F.col("_fails") - F.col("_n")).alias("redundant"), "unique_fails", *[F.col(f"_l{i}").alias(name) for i, name in enumerate(lost)], "shapley"
    )
