"""K-d tree partitioning of documents into shards of nearly equal bytes.

Coordinates are metadata of the text. Each level takes every node's widest dimension and splits
the node at the weighted median there, found by distributed histograms over ever finer digits of
an order key. Equal texts have equal keys, so they stay together, except for groups so heavy that
a shard could not be balanced with them whole: those are cut at the median by document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIMS = ("d_bytes", "d_words", "d_lines", "d_density")
DIGIT = 15
#: Lists of nodes up to this length are broadcast; longer ones are joined by a shuffle.
MOST_NODES = 100_000
ROWS_A_SLOT_TASK = 20_000


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    return docs.select(
        F.col(id_col), (size + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 24).alias("tie"), F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << DIGIT)).alias("fine"),
        F.log1p(size).alias("d_bytes"),
        F.log1p(F.length(text) - F.length(F.translate(text, " ", ""))).alias("d_words"),
        F.log1p(F.length(text) - F.length(F.translate(text, "\n", ""))).alias("d_lines"),
        ((F.length(text) + 1) / (size + 1)).alias("d_density"),
        F.lit(0).alias("node"), F.lit(False).alias("divided"),
    )


def medians(points: DataFrame, digit, goal: str) -> dict[int, tuple[int, int, int]]:
    """For each node: the digit where the running weight reaches goal, the weight before it and in it."""
    order = Window.partitionBy("node").orderBy("digit")
    sums = points.groupBy("node", goal, digit.alias("digit")).agg(F.sum("size").alias("w")).withColumn("cum", F.sum("w").over(order))
    found = sums.where(f"cum >= {goal}").groupBy("node").agg(F.min(F.struct("digit", (F.col("cum") - F.col("w")).alias("before"), "w")).alias("m"))
    return {r["node"]: tuple(r["m"]) for r in found.collect()}  # one row a node


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_NODES else df


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, heavy: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, divided): shards numbered from 0, slots gapless from 0 in each.

    Give the number of shards, or target_bytes and get the least number of leaves under which no
    leaf's share passes it. size is the text's UTF-8 bytes plus 1, 1 for null and empty texts. Rows of
    equal texts stay in one shard; only a group that weighs more than `heavy` of a shard and lies on
    a median is cut there, by document, and its rows have divided true where some lie on either side. An empty table gives an empty result; repeated rows each get a slot of their own. One row a node
    passes through the driver, so memory there grows with the number of shards alone.
    """
    spark = docs.sparkSession
    points = common.cut(describe(docs, id_col, text_col), "points")
    held = points
    total = points.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, math.ceil(total / target_bytes))
    heavy = heavy * total / n_shards
    scale = points.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).first()
    width = {0: (0, n_shards)}  # node: first shard, number of shards
    while any(k > 1 for _, k in width.values()):
        seen = {r["node"]: r for r in points.groupBy("node").agg(F.sum("size").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in DIMS], *[F.max(d).alias(f"hi_{d}") for d in DIMS]).collect()}
        plan = []
        for node, (_, k) in width.items():
            if k > 1 and node in seen:
                r = seen[node]
                _, dim = max(((r[f"hi_{d}"] - r[f"lo_{d}"]) / (scale[d] or 1), -i) for i, d in enumerate(DIMS))
                d = DIMS[-dim]
                plan.append((node, -dim, float(r[f"lo_{d}"]), float(max(r[f"hi_{d}"] - r[f"lo_{d}"], 1e-12)), (int(r["w"]) * (k // 2) + k - 1) // k))
        if plan:
            params = spark.createDataFrame(plan, "node int, dim int, lo double, span double, goal long")
            value = F.element_at(F.array(*[F.col(d) for d in DIMS]), F.col("dim") + 1)
            # the order key: 20 bits of the coordinate, then 40 of the text's hash
            key = F.shiftleft(F.floor((value - F.col("lo")) / F.col("span") * ((1 << 20) - 1)), 40).bitwiseOR(F.col("tie"))
            keyed = points.join(small(params, len(plan)), "node").select("node", "goal", "size", "fine", key.alias("key"))
            cuts = {p[0]: 0 for p in plan}
            goals = {p[0]: p[4] for p in plan}
            weight: dict[int, int] = {}
            for step in range(4):
                shift = 60 - DIGIT * (step + 1)
                state = spark.createDataFrame([(n, cuts[n], goals[n]) for n in cuts], "node int, high long, left long")
                at = keyed.join(small(state, len(plan)), "node").where(F.shiftright("key", shift + DIGIT) == F.col("high"))
                for n, (digit, before, w) in medians(at, F.shiftright("key", shift).bitwiseAND((1 << DIGIT) - 1), "left").items():
                    cuts[n] = cuts[n] << DIGIT | digit
                    goals[n] -= before
                    weight[n] = w
            fine = {n: (1 << DIGIT if 2 * goals[n] >= weight[n] else -1) for n in cuts}  # the nearer side of the group
            big = [n for n in cuts if weight[n] > heavy]
            if big:
                state = spark.createDataFrame([(n, cuts[n], goals[n]) for n in big], "node int, high long, left long")
                at = keyed.join(small(state, len(plan)), "node").where("key = high")
                for n, (digit, before, w) in medians(at, F.col("fine"), "left").items():
                    fine[n] = digit if 2 * (goals[n] - before) >= w else digit - 1
            parted = set()
            if big:  # a heavy group is divided only where it has rows on both sides
                state = spark.createDataFrame([(n, cuts[n], fine[n]) for n in big], "node int, high long, cut_fine int")
                sides = keyed.join(small(state, len(plan)), "node").where("key = high").groupBy("node").agg(F.min(F.col("fine") - F.col("cut_fine")).alias("lo"), F.max(F.col("fine") - F.col("cut_fine")).alias("hi"))
                parted = {r["node"] for r in sides.where("lo <= 0 and hi > 0").collect()}  # one row a node
            rows = [(*p, cuts[p[0]], fine[p[0]], p[0] in parted) for p in plan]
            done = spark.createDataFrame(rows, "node int, dim int, lo double, span double, goal long, cut long, cut_fine int, by_document boolean")
            right = (key > F.col("cut")) | ((key == F.col("cut")) & (F.col("fine") > F.col("cut_fine")))
            split = points.join(small(done, len(plan)), "node", "left")
            deeper = F.when(F.col("cut").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + right.cast("int"))
            points = split.select(id_col, "size", "text_crc32", "tie", "fine", *DIMS, deeper.alias("node"), (F.col("divided") | F.coalesce(F.col("by_document") & (key == F.col("cut")), F.lit(False))).alias("divided"))
        else:
            points = points.withColumn("node", F.col("node") * 2)
        split_nodes = {p[0] for p in plan}
        width = {c: v for n, (s, k) in width.items() for c, v in (((2 * n, (s, k // 2)), (2 * n + 1, (s + k // 2, k - k // 2))) if n in split_nodes else ((2 * n, (s, k if n in seen else 1)),))}
        points, old = common.cut(points.withColumn("node", F.col("node").cast("int")), "points"), held
        common.drop(old)
        held = points
    names = spark.createDataFrame([(n, s) for n, (s, _) in width.items()], "node int, shard int")
    placed = points.join(small(names, len(width)), "node").select(id_col, "size", "text_crc32", "shard", "tie", "fine", "divided")
    rows = points.count()
    parts = max(1, math.ceil(rows / n_shards / ROWS_A_SLOT_TASK))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(id_col, "tie"), F.lit(parts)).cast("int"))
    held = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("shard").orderBy("part")) - F.col("held")).drop("held")
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "tie", "fine"))
    return placed.withColumn("rank", rank).join(before, ["shard", "part"]).select(id_col, "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "divided")
