"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

The tree is rebuilt and broadcast each round. Each vector searches it best first: of its open nodes
that with the least possible distance is next, until none can hold a centroid as near as the best
so far. Searches of a batch of vectors go on side by side in numpy. Distances are exact integers; the
triangle inequality only decides, with a margin for rounding, which nodes are looked at.
"""

from __future__ import annotations

import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAF = 4
AT_ONCE = 4096
#: Integers beyond this would make a squared distance pass 64 bits.
MOST = 1 << 27
SLACK = 1e-9


def Node(ids: np.ndarray) -> SimpleNamespace:  # noqa: N802  a class of this package could not be broadcast to workers without it
    """ids: the vantage point, or a leaf's centroids. below: (node, least and most distance of its centroids from the vantage point)."""
    return SimpleNamespace(ids=ids, below=[])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of c, in 64-bit integers."""
    d = x[:, None, :] - c[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def build(centroids: np.ndarray) -> list[SimpleNamespace]:
    """Nodes, the root first. The vantage point is that of the node's centroids from which the others' distances vary most; the nearer half goes to one side."""
    nodes: list[SimpleNamespace] = []
    far = np.sqrt(squared(centroids, centroids).astype(np.float64))

    def grow(ids: np.ndarray) -> int:
        at = len(nodes)
        if len(ids) <= LEAF:
            nodes.append(Node(np.sort(ids)))
            return at
        own = far[np.ix_(ids, ids)]
        v = int(own.var(axis=1).argmax())
        rest = np.delete(ids, v)
        d = far[ids[v], rest]
        rest, d = rest[np.argsort(d, kind="stable")], np.sort(d, kind="stable")
        nodes.append(Node(ids[v : v + 1]))
        half = len(rest) // 2
        for part, reach in ((rest[:half], d[:half]), (rest[half:], d[half:])):
            nodes[at].below.append((grow(part), float(reach[0]), float(reach[-1])))
        return at

    grow(np.arange(len(centroids)))
    return nodes


def nearest(x: np.ndarray, centroids: np.ndarray, nodes: list[SimpleNamespace]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smallest number), its squared distance, and how many distances were computed."""
    n, looked = len(x), 0
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids), np.int32)
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0
    active = np.arange(n)
    while len(active):
        pick = bound[active].argmin(axis=1)
        # inclusive: a node at exactly the best distance may hold an equal centroid with a smaller number
        go = bound[active, pick] <= np.sqrt(best[active].astype(np.float64)) * (1 + SLACK)
        active, pick = active[go], pick[go]
        order = np.argsort(pick, kind="stable")
        ends = np.searchsorted(pick[order], np.arange(len(nodes) + 1))
        for k in np.unique(pick):
            rows, node = active[order[ends[k] : ends[k + 1]]], nodes[k]
            open_at = bound[rows, k]
            bound[rows, k] = np.inf
            d = squared(x[rows], centroids[node.ids])
            looked += d.size
            first = d.argmin(axis=1)
            least, name = d[np.arange(len(rows)), first], node.ids[first]
            better = (least < best[rows]) | ((least == best[rows]) & (name < who[rows]))
            best[rows[better]], who[rows[better]] = least[better], name[better]
            if node.below:
                away = np.sqrt(d[:, 0].astype(np.float64))
                for child, lo, hi in node.below:
                    gap = np.maximum(lo - away, away - hi) - SLACK * (away + hi)
                    bound[rows, child] = np.maximum(open_at, gap)
    return who, best, looked


def integers(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(scale * component) of the vectors with exactly dims components, all finite."""
    finite = F.forall(vec_col, lambda x: F.abs(x.cast("double")) < float("inf"))  # false for NaN, null for null
    scaled = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("v", lambda x: F.abs(x) <= MOST)
    rows = vectors.where((F.size(vec_col) == dims) & finite).select(F.col(id_col).alias("id"), F.when(F.forall(vec_col, lambda x: F.abs(x.cast("double")) * scale < MOST), scaled).alias("v"))
    return rows.select("id", F.when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}: squared distances would not fit into 64 bits"))).alias("v"))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly dims components, none null or non-finite; each component becomes
    floor(scale * component), an error beyond 2^27. Centroids start as the k kept vectors with the
    smallest hex sha256 of seed and id, in that order (a null id counts as empty text, ties go by the vector), or as
    all vectors where there are fewer. Each of the rounds assigns every vector to its nearest centroid by squared
    distance (ties: the smaller number) and moves every centroid that has vectors to their
    componentwise floor(sum / count). Then all are assigned once more. Sums are exact; what passes
    through the driver is k rows a round. Repeated rows and ids are vectors of their own. No kept
    vector: an empty result.
    """
    spark = vectors.sparkSession
    id_kind = vectors.schema[id_col].dataType.simpleString()
    kept = common.cut(integers(vectors, dims, scale, id_col, vec_col), "vectors")
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    out = f"id {id_kind}, cluster int, distance long"
    if not first:
        assigned = spark.createDataFrame([], out)
        return named(assigned, np.zeros((0, dims), np.int64), id_col)
    centroids = np.array([r["v"] for r in first], np.int64)

    def sums(sent):
        def run(batches):
            c, nodes = sent.value
            n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), dims)
                for a in range(0, len(x), AT_ONCE):
                    part = x[a : a + AT_ONCE]
                    who, _, _ = nearest(part, c, nodes)
                    n += np.bincount(who, minlength=len(c))
                    order = np.argsort(who, kind="stable")
                    there, begin = np.unique(who[order], return_index=True)
                    total[there] += np.add.reduceat(part[order], begin, axis=0)
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        return run

    def places(sent):
        def run(batches):
            c, nodes = sent.value
            for batch in batches:
                x = matrix(batch.column(1), dims)
                for a in range(0, len(x), AT_ONCE):
                    who, best, _ = nearest(x[a : a + AT_ONCE], c, nodes)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, AT_ONCE), pa.array(who), pa.array(best)], ["id", "cluster", "distance"])

        return run

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((centroids, build(centroids)))
        partial = kept.select("v").mapInArrow(sums(sent), "cluster int, n long, total array<long>")
        # decimals: a sum of many tasks' longs may pass 64 bits
        exact = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("total"))
        centroids = centroids.copy()
        for r in exact.collect():  # at most k rows
            centroids[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        sent.unpersist()
    sent = spark.sparkContext.broadcast((centroids, build(centroids)))
    assigned = common.cut(kept.select("id", "v").mapInArrow(places(sent), out), "assigned")
    return named(assigned, centroids, id_col)


def named(assigned: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """assigned with its clusters' inertia, that of all, and the digests of the centroids."""
    own = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(own.values())
    rows = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in own.items()]
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
