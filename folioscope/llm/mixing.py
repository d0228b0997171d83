"""Temperature mixing of sources, realised as budgeted permutations of blocks.

Source shares p become weights w ~ p^a. The exponent a is bisected until the weights meet a target
entropy or until no source would be repeated more than a limit. Budgets w * total are then dealt:
whole passes over a source, and one part pass over its blocks in a permuted order up to the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RANGE_BITS = 12


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised p^a of the sources that have tokens."""
    live = {s: t for s, t in tokens.items() if t > 0}
    top = max(live.values(), default=1)
    raw = {s: (t / top) ** exponent for s, t in live.items()}
    norm = math.fsum(raw.values())
    return {s: r / norm for s, r in raw.items()}


def entropy(w: dict) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


def least_budget(tokens: dict, w: dict) -> float:
    """The smallest total at which every source is passed over at least once."""
    return max((tokens[s] / x for s, x in w.items()), default=0.0)


def solve_exponent(tokens: dict, target_entropy: float | None = None, max_epochs: float | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] nearest to 0 (most even weights) within the repetition limit, or that of the target entropy.

    Entropy falls and the most repeated source's epochs fall as the exponent grows; both are met
    by bisection. A target out of reach gives the nearer end of [0, 1].
    """
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give target_entropy or max_epochs")

    def even(a: float) -> bool:
        """Whether a may grow no more: its weights are already as peaked as asked for."""
        w = weights(tokens, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        total = least_budget(tokens, w) if budget is None else budget
        return max((x * total / tokens[s] for s, x in w.items()), default=0) <= max_epochs + 1e-9

    lo, hi = 0.0, 1.0
    if even(lo) or not even(hi):
        return lo if even(lo) else hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if even(mid) else (mid, hi)
    return hi


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_epochs: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_hash: bool = False) -> DataFrame:
    """(id, source, n_tokens, epoch, block, block_rank, place): one row each time a row is dealt; with_hash adds text_hash.

    A token is a run of non-white-space; an empty or null text counts as one token, so that every
    row can be dealt. With budget None the total is the least at which each source is passed over
    once, so no row is lost. Null sources form one source of their own. In each epoch a source's
    blocks follow a permutation of their own (block_rank), and rows in a block another (place). A
    part epoch ends with the row that reaches the budget. Rows that repeat an id and text have one place, and each is dealt
    for itself: a part epoch may deal some of them and not the others. An empty table gives no rows. Other columns play no part. Totals per source pass through the driver; blocks hold about block_tokens.
    """
    n_tokens = F.greatest(F.lit(1), F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^ \\t-\\r]+")), F.lit(1))).cast("long")
    name = F.coalesce(F.col(source_col).cast("string"), F.lit("\0null"))
    id_, out_id = F.col(id_col), id_col
    slim = common.cut(docs.select(id_.alias("_id"), common.text_hash(text_col).alias("text_hash"), name.alias("s"), n_tokens.alias("n_tokens")), "mix")
    id_col = "_id"  # fixed names inside, whatever the id's is
    tokens = {r["s"]: int(r["t"]) for r in slim.groupBy("s").agg(F.sum("n_tokens").alias("t")).collect()}
    a = solve_exponent(tokens, target_entropy, max_epochs, budget) if tokens else 1.0
    w = weights(tokens, a)
    total = least_budget(tokens, w) if budget is None else budget
    plan = []
    for s, x in w.items():
        due = x * total
        whole = math.floor(due / tokens[s] + 1e-9)
        plan.append((s, whole, max(0, round(due - whole * tokens[s])), max(1, math.ceil(tokens[s] / block_tokens))))
    spark = docs.sparkSession
    plan_df = F.broadcast(spark.createDataFrame(plan, "s string, whole int, part long, blocks int"))  # one row a source
    rows = slim.join(plan_df, "s").withColumn("block", F.pmod(F.xxhash64(id_col, "text_hash", F.lit(seed)), F.col("blocks")).cast("int"))
    # the part epoch: blocks in permuted order until the budget, then rows of the last block
    per_block = rows.groupBy("s", "block", "whole", "part").agg(F.sum("n_tokens").alias("bt"))
    # running sums over a source's blocks in two levels, ranges of the permutation and blocks in a range, so no task has all of a source's
    rank = F.xxhash64("s", "block", "whole", F.lit(seed + 1))
    per_block = common.cut(per_block.withColumn("rank", rank).withColumn("range", F.shiftright(rank, 64 - RANGE_BITS)), "blocks")
    ranges = per_block.groupBy("s", "range").agg(F.sum("bt").alias("rt"))
    ranges = ranges.withColumn("lower", F.sum("rt").over(Window.partitionBy("s").orderBy("range")) - F.col("rt")).drop("rt")  # 2^RANGE_BITS rows a source at most
    by_rank = Window.partitionBy("s", "range").orderBy("rank", "block")
    before = per_block.withColumn("upto", F.sum("bt").over(by_rank) - F.col("bt")).join(ranges, ["s", "range"]).select("s", "block", (F.col("lower") + F.col("upto")).alias("before"))
    inside = Window.partitionBy("s", "block").orderBy(F.xxhash64(id_col, "text_hash", "whole", F.lit(seed + 2)), id_col, "text_hash")
    rows = rows.withColumn("run", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    rows = rows.join(before, ["s", "block"])
    times = F.col("whole") + F.when(F.col("before") + F.col("run") < F.col("part"), 1).otherwise(0)
    dealt = rows.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.expr("sequence(0, times - 1)")))
    return dealt.select(
        F.col(id_col).alias(out_id), *["text_hash"] * with_hash, F.when(F.col("s") != "\0null", F.col("s")).alias(source_col), "n_tokens", "epoch", "block",
        F.xxhash64("s", "block", "epoch", F.lit(seed + 1)).alias("block_rank"), F.xxhash64(id_col, "text_hash", "epoch", F.lit(seed + 2)).alias("place"),
    )
