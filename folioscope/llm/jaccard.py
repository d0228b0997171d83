"""N-gram Jaccard join by token-combination prefixes.

A token is a distinct 4-word shingle of a text. Every token's exact document frequency puts tokens
into classes: those of one text only, rare ones and frequent ones. Tokens are ordered by frequency,
so texts that link (Jaccard >= t) share at least k tokens of their (n - ceil(t n) + k)-prefixes.
Prefix tokens of the rare class are indexed one by one, those of the frequent class as k-token
combinations, both split by size classes and cut where the tokens left could not make a link. Texts
that share an index entry are candidates, and all are verified exactly. Chains
of entries make clusters; up to MOST_CLUSTERED texts, a cluster is verified as a whole, in tiles.
In larger ones, where chains say little, only texts that share an entry are: first each with one of
them, then the pairs that the links found so far do not connect. Texts with one set are one vertex,
whose key is a digest of the set.

Data moves as packed arrays, a row for each bucket of hashes and slice of text, so rows shuffled
stay few. Buckets grow with the input. A token that would fill a bucket by itself needs no exact
frequency and skips the count; a set with very many copies is dealt from one of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textvec import SLICE_BYTES, Words, binary, mix, slices, spread, windows

K = 2
FREQUENT = 16
MOST_COMBINED = 24
BLOCK = 1024
#: Text bytes for each bucket of the count, which is one task.
BUCKET_BYTES = 16 << 20
#: A token in so many sets, and in more than this share of all, skips the count. So there are at most 4 / HOT_TOKENS.
HOT_SETS, HOT_TOKENS = 100_000, 1e-6
#: A set of this share of all rows, and of over 1,000, is dealt from one row. So there are at most its inverse.
COPIED = 1e-5
#: Lists of candidates up to this length give their pairs; longer ones are verified in tiles.
SHORT = 32
#: Clusters up to this many sets are verified whole.
MOST_CLUSTERED = 32 * BLOCK


def sets(w: Words, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each row, and a 63-bit digest of each set (0: empty)."""
    h = w.hashes()
    s, at = windows(h, w.doc, words)
    cut = np.searchsorted(at, w.first)
    out, keys = [], np.zeros(len(w.off) - 1, np.int64)
    for i in range(len(keys)):
        a, b = cut[i], cut[i + 1]
        if b > a:
            x = np.unique(s[a:b])
        elif w.first[i + 1] > w.first[i]:
            own = h[w.first[i] : w.first[i + 1]]
            x = mix(np.array([(own * spread(len(own), 23)).sum() + np.uint64(len(own))]))
        else:
            x = s[:0]
        out.append(x)
        if len(x):
            keys[i] = (int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big") >> 1) or 1
    return out, keys


def members(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", least: int = 1 << 30) -> DataFrame:
    """(id, text_hash, key, n_shingles, seen) of every row; key is null where there is no word.

    seen: tokens that at least `least` distinct sets of one slice of text have, and how many, packed
    in the slice's first row.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                x, keys = sets(Words(part.column(1)), words)
                _, first = np.unique(keys, return_index=True)
                seen = [None] * len(x)
                if len(first) >= least:
                    tok, n = np.unique(np.concatenate([x[i] for i in first]), return_counts=True)
                    if (n >= least).any():
                        seen[0] = np.concatenate([tok[n >= least], n[n >= least].astype(np.uint64)]).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, mask=keys == 0), pa.array([len(a) for a in x], pa.int64()), pa.array(seen, pa.binary())], [id_col, "text_hash", "key", "n_shingles", "seen"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, common.text_hash(text_col).alias("text_hash")).mapInArrow(run, f"`{id_col}` {kind}, text_hash long, key long, n_shingles long, seen binary")


def hot_tokens(rows: DataFrame, sets_: float) -> np.ndarray:
    """Sorted tokens that slices saw in many sets. Being hot changes where a token is counted, never a result."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                tok, n = np.split(np.frombuffer(x, np.uint64), 2)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    seen = rows.where("seen is not null").select("seen").mapInArrow(run, "token long, n long")
    found = seen.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= sets_ / 4).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], np.int64).view(np.uint64))


def shared_tokens(docs: DataFrame, words: int, percent: int, buckets: int, hot: np.ndarray, copied: dict, id_col: str, text_col: str) -> DataFrame:
    """(key, n, tokens, dfs) of the sets that could link: at least percent of n tokens occur in other sets.

    hot: sorted tokens that go to their sets uncounted, as the most frequent of all. copied: keys of
    sets with very many copies, each with the id of the rows that stand for all.
    """
    bits = max(1, (buckets - 1).bit_length())
    shift, n_buckets = np.uint64(64 - bits), 1 << bits
    sent = docs.sparkSession.sparkContext.broadcast((hot, copied))

    def bucket_rows(b, keys, sizes, tok, own):
        """A row for each bucket: the sets with tokens in it, their sizes, how many tokens each has there, and these."""
        order = np.argsort(b, kind="stable")
        b, tok, own = b[order], tok[order], own[order]
        edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
        heads = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (b[1:] != b[:-1])]))
        who = own[heads]
        ends = np.searchsorted(heads, edges[1:])
        counts = np.diff(np.append(heads, len(own))).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(b[edges[:-1]].astype(np.int32)), binary(keys[who], ends), binary(sizes[who].astype(np.uint32), ends), binary(counts, ends), binary(tok, edges[1:])], ["bucket", "keys", "ns", "counts", "tokens"])

    def deal(batches):
        hot, copied = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                x, keys = sets(Words(part.column(1)), words)
                first = {}
                ids = part.column(0).to_pylist() if copied else None
                for i, k in enumerate(keys.tolist()):
                    if k and not (copied and k in copied and copied[k] != ids[i]):
                        first.setdefault(k, i)
                rows = list(first.values())
                if not rows:
                    continue
                sizes, own_keys = np.array([len(x[i]) for i in rows]), keys[rows]
                tok, own = np.concatenate([x[i] for i in rows]), np.repeat(np.arange(len(rows), dtype=np.uint32), sizes)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok
                    q = n_buckets + (mix(own_keys.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                    if is_hot.any():
                        yield bucket_rows(q[own[is_hot]], own_keys, sizes, tok[is_hot], own[is_hot])
                    tok, own = tok[~is_hot], own[~is_hot]
                if len(tok):
                    yield bucket_rows((tok >> shift).astype(np.uint16 if bits <= 16 else np.uint32), own_keys, sizes, tok, own)

    def flat(t: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

    def count(t: pa.Table) -> pa.Table:
        """Exact frequencies of one bucket's tokens; those of a single set go."""
        c = flat(t, "counts", np.uint32)
        uncounted = len(t) > 0 and t.column("bucket")[0].as_py() >= n_buckets
        key, n, tok = np.repeat(flat(t, "keys", np.int64), c), np.repeat(flat(t, "ns", np.uint32), c), flat(t, "tokens", np.uint64)
        if uncounted:
            return by_set(key, n, tok, np.full(len(tok), 1 << 31, np.uint32))
        order = np.argsort(tok)
        s = tok[order]
        same = s[1:] == s[:-1]
        kept = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(s) else order
        key, n, tok = key[kept], n[kept], tok[kept]
        order = np.lexsort((key, tok))
        key, n, tok = key[order], n[order], tok[order]
        if len(tok):
            own = np.concatenate([[True], (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])])  # one set met in several slices
            key, n, tok = key[own], n[own], tok[own]
        _, back, df = np.unique(tok, return_inverse=True, return_counts=True)
        df = df[back] if len(tok) else df
        return by_set(key[df > 1], n[df > 1], tok[df > 1], df[df > 1].astype(np.uint32))

    def by_set(key, n, tok, df) -> pa.Table:
        q = (mix(key.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(q, kind="stable")
        q = q[order]
        ends = np.flatnonzero(np.concatenate([q[1:] != q[:-1], [True]])) + 1 if len(q) else np.zeros(0, np.int64)
        return pa.table({"q": pa.array(q[ends - 1]), "keys": binary(key[order], ends), "ns": binary(n[order], ends), "tokens": binary(tok[order], ends), "dfs": binary(df[order], ends)})

    def gather(t: pa.Table) -> pa.Table:
        """Sets with enough shared tokens, each with its shared tokens, least frequent first."""
        key, n, tok, df = flat(t, "keys", np.int64), flat(t, "ns", np.uint32), flat(t, "tokens", np.uint64), flat(t, "dfs", np.uint32)
        order = np.lexsort((tok, df, key))
        if len(order):
            order = order[np.concatenate([[True], (tok[order][1:] != tok[order][:-1]) | (key[order][1:] != key[order][:-1])])]  # hot tokens of a set met in several slices
        key, n, tok, df = key[order], n[order], tok[order], df[order]
        _, back, c = np.unique(key, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(c[back] * 100 >= percent * n.astype(np.int64)) if len(key) else back
        key, n, tok, df = key[kept], n[kept], tok[kept], df[kept]
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1 if len(key) else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(key[ends - 1]), "n": pa.array(n[ends - 1].astype(np.int64)), "tokens": binary(tok, ends), "dfs": binary(df, ends)})

    dealt = docs.select(id_col, text_col).mapInArrow(deal, "bucket int, keys binary, ns binary, counts binary, tokens binary")
    counted = dealt.repartitionById(2 * n_buckets, "bucket").groupBy("bucket").applyInArrow(count, "q int, keys binary, ns binary, tokens binary, dfs binary")
    return counted.repartitionById(n_buckets, "q").groupBy("q").applyInArrow(gather, "key long, n long, tokens binary, dfs binary")


def least_shared(n: np.ndarray | int, percent: int):
    """ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def size_classes(percent: int, most: int) -> np.ndarray:
    """First size of each class; the sizes from percent of n up to n lie in two of them at most."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts)


def index_entries(sets_: DataFrame, percent: int) -> DataFrame:
    """(entry, wide, gives, key): hashed index entries of each set's extended prefix, by size class.

    Rare tokens stand alone. Frequent ones are combined by K; a set with more than MOST_COMBINED
    of them, or one that may link by fewer than K tokens, is `wide` instead: all sets also index each
    frequent token alone under another name, and such an entry counts only if a wide set has it, so
    a wide set meets both kinds.

    Two sets that link meet at their first common token, where all that they share is still to come:
    a set of n tokens with r from there on links with no set larger than (100 + percent) r / percent - n.
    So at each token it looks for partners of its own size or less down to percent of it, in these sizes'
    classes, and gives itself to others, in its own class, only where a partner of its own size could be. A list in which no set gives itself has no pairs.
    """

    def run(batches):
        starts = size_classes(percent, 1 << 40)
        for batch in batches:
            e, wide, gives, keys = [], [], [], []
            for key, n, tok, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                t, d = np.frombuffer(tok, np.uint64), np.frombuffer(df, np.uint32)
                p = len(t) - least_shared(n, percent) + K  # tokens of one set alone come first in the prefix
                largest = (100 + percent) * (len(t) - np.arange(len(t))) // percent - n
                t, d, largest = t[:p], d[:p], largest[:p]
                least = least_shared(n, percent)
                # largest falls along the set, so able tokens come first; a pair's second token may be one further on, as all but one shared are still to come there
                able = largest >= least
                able = np.concatenate([[True], able[:-1]]) & able[:1]
                t, d, largest = t[able], d[able], largest[able]
                is_rare = d <= FREQUENT
                many, many_largest = t[~is_rare], largest[~is_rare]
                is_wide = len(many) > MOST_COMBINED or least_shared(n, percent) < K
                a, b = np.triu_indices(0 if is_wide else len(many), 1)
                combined = mix(many[a] * np.uint64(0x9E3779B97F4A7C15) + many[b]) if len(a) else many[:0]
                alone = mix(many ^ np.uint64(0x5DEECE66D1234567))
                entry = np.concatenate([t[is_rare], combined, alone])
                most = np.minimum(np.concatenate([largest[is_rare], many_largest[a], many_largest]), n)
                counts = np.repeat([1, 1, int(is_wide)], [int(is_rare.sum()), len(combined), len(alone)])
                can = most >= least
                entry, most, counts = entry[can], most[can], counts[can]
                low, own = np.searchsorted(starts, [least, n], "right") - 1
                high = np.searchsorted(starts, most, "right") - 1
                for c in range(low, own + 1):
                    here = high >= c
                    e.append(mix(entry[here] ^ np.uint64((c + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                    wide.append(counts[here])
                    gives.append((most[here] == n) & (c == own))
                    keys.append(np.full(int(here.sum()), key))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e).view(np.int64)), pa.array(np.concatenate(wide).astype(np.int32)), pa.array(np.concatenate(gives).astype(np.int32)), pa.array(np.concatenate(keys).astype(np.int64))], ["entry", "wide", "gives", "key"])

    return sets_.select("key", "n", "tokens", "dfs").mapInArrow(run, "entry long, wide int, gives int, key long")


def tile_links(percent: int):
    """The function that verifies tiles: rows (tile, side, key, n, tokens), each set of side 0 with each of side 1; a set of side 2 is on both.

    It returns (a, b) keys that link, a spanning forest for each tile. Shared tokens are counted by
    products of 0/1 matrices, or by look-up where side 0 has one set.
    """

    def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        size = [len(t) for t in right]
        flat = np.concatenate(right)
        known = np.unique(np.concatenate(left))
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == flat) if len(known) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(right)), size)[hit]
        if len(left) == 1:
            return np.bincount(row, minlength=len(right))[None, :]
        col = at[hit]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        lcol = np.searchsorted(known, np.concatenate(left))
        lrow = np.repeat(np.arange(len(left)), [len(t) for t in left])
        lorder = np.argsort(lcol, kind="stable")
        lcol, lrow = lcol[lorder], lrow[lorder]
        both, step = np.zeros((len(left), len(right)), np.float32), 2048
        for a in range(0, len(known), step):
            (x, y), (u, v) = np.searchsorted(col, [a, a + step]), np.searchsorted(lcol, [a, a + step])
            if x == y:
                continue
            l_, r_ = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
            l_[lrow[u:v], lcol[u:v] - a] = 1
            r_[row[x:y], col[x:y] - a] = 1
            both += l_ @ r_.T
        return np.rint(both).astype(np.int64)

    def run(t: pa.Table) -> pa.Table:
        tile, side, key, n = (t.column(c).to_numpy() for c in ("tile", "side", "key", "n"))
        toks = t.column("tokens").to_pylist()
        order = np.lexsort((key, side, tile))
        edges = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        out_a, out_b = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = order[a:b]
            left, right = own[side[own] != 1], own[side[own] != 0]
            if not len(left) or not len(right):
                continue
            inter = shared([np.frombuffer(toks[i], np.uint64) for i in left], [np.frombuffer(toks[i], np.uint64) for i in right])
            i, j = np.nonzero(100 * inter >= percent * (n[left][:, None] + n[right][None, :] - inter))
            up: dict[int, int] = {}

            def top(v, up=up):
                while up.setdefault(v, v) != v:
                    up[v] = up[up[v]]
                    v = up[v]
                return v

            for x, y in zip(key[left[i]].tolist(), key[right[j]].tolist(), strict=True):
                ra, rb = top(x), top(y)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
                    out_a.append(x)
                    out_b.append(y)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def verify_tiles(rows: DataFrame, found: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) in tiles: rows are about `size` (tile, side, key), found has the sets of the keys."""
    rows = rows.join(found.select("key", "n", "tokens"), "key")
    groups = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 4096)
    return rows.withColumn("g", F.pmod("tile", F.lit(groups))).groupBy("g").applyInArrow(tile_links(percent), "a long, b long")


def verify_clusters(clusters: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links within clusters (cluster, key, c sets): pairs of blocks of about BLOCK sets, in different tasks."""
    block = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")
    rows = clusters.withColumn("nb", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")).withColumn("own", block).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    tile = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return verify_tiles(rows.select(tile.alias("tile"), side.alias("side"), "key"), found, percent, clusters.count())


def verify_pairs(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links among distinct pairs (a, b). A set's partners are verified in blocks of about BLOCK, so none is too much for a task."""
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    dealt = common.skew_join(pairs, n, "a", common.hot_keys(pairs, "a"))
    dealt = dealt.withColumn("tile", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))))
    left = dealt.select("tile", F.lit(0).alias("side"), F.col("a").alias("key")).distinct()
    return verify_tiles(left.union(dealt.select("tile", F.lit(1), "b")), found, percent, pairs.count())


def open_pairs(listed: DataFrame, near: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links of the pairs that share an entry and that no links connect yet.

    listed: (entry, key); near: components (node, root) of the links so far. Of equal lists one
    is enough. Short lists give their pairs; of a long one, all sets outside its largest component
    are verified against all others, in tiles.
    """
    rows = listed.join(near.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = common.cut(rows, "listed")
    h = F.xxhash64("key")
    lists = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"))
    lists = common.cut(lists.where("lo <> hi").groupBy("c", "x", "s").agg(F.min("entry").alias("entry")).select("entry", "c"), "lists")
    short = rows.join(lists.where(F.col("c") <= SHORT), "entry").select("entry", "key", "root")
    other = short.select("entry", F.col("key").alias("b"), F.col("root").alias("root_b"))
    pairs = common.cut(short.join(other, "entry").where("key < b and root <> root_b").select(F.col("key").alias("a"), "b").distinct(), "pairs")
    links = verify_pairs(pairs, found, percent)
    long = lists.where(F.col("c") > SHORT).select("entry")
    if not long.isEmpty():
        long = common.cut(rows.join(long, "entry").select("entry", "key", "root"), "long")
        size = long.groupBy("entry", "root").agg(F.count(F.lit(1)).alias("k"))
        blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
        size = size.groupBy("entry").agg(F.max_by("root", F.struct("k", "root")).alias("major"), blocks(F.sum("k")).alias("right"), F.greatest(F.lit(1), blocks(F.sum("k") - F.max("k"))).alias("left"))
        long = common.skew_join(long, size, "entry", common.hot_keys(long, "entry"))
        part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
        minor = long.where("root <> major").withColumn("i", part("left")).withColumn("j", F.explode(F.expr("sequence(0, right - 1)")))
        whole = long.withColumn("j", part("right")).withColumn("i", F.explode(F.expr("sequence(0, left - 1)")))
        tile = F.xxhash64("entry", "i", "j").alias("tile")
        links = links.union(verify_tiles(minor.select(tile, F.lit(0).alias("side"), "key").union(whole.select(tile, F.lit(1), "key")), found, percent, long.count()))
    return links


def jaccard_classes(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, root) of every row: rows with one root are connected by links; root is null without words."""
    docs = docs.select(id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4, 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length())
    many = max(HOT_SETS, HOT_TOKENS * size / 6)
    rows = common.cut(members(docs, words, id_col, text_col, max(2, min(4, HOT_SETS), int(many * SLICE_BYTES / max(1, size) / 4))), "members")
    n_rows = rows.count()
    copies = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("id")).where(F.col("n") > max(1000, COPIED * n_rows))
    copied = {r["key"]: r["id"] for r in copies.collect()}
    found = common.cut(shared_tokens(docs, words, percent, buckets, hot_tokens(rows, many), copied, id_col, text_col), "sets")
    entries = index_entries(found, percent)
    heads = entries.groupBy("entry").agg(F.min("key").alias("head"), F.max("key").alias("last"), F.max("wide").alias("any"), F.max("gives").alias("given")).where("head < last and any = 1 and given = 1").select("entry", "head")
    starred = entries.drop("wide", "gives").join(heads, "entry")
    stars = starred.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    near = common.components(stars)
    near = common.cut(near.union(near.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("key"), F.col("root").alias("cluster")), "near")
    size = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"))
    clusters = common.cut(common.skew_join(near, size, "cluster", common.hot_keys(near, "cluster")), "clusters")
    links = verify_clusters(clusters.where(F.col("c") <= MOST_CLUSTERED), found, percent)
    large = clusters.where(F.col("c") > MOST_CLUSTERED).select("key")
    if not large.isEmpty():
        listed = common.cut(starred.select("entry", "key", "head").distinct().join(large, "key"), "entries")
        first = listed.groupBy("key").agg(F.min("head").alias("a")).where("a <> key").select("a", F.col("key").alias("b"))
        sure = common.cut(verify_pairs(first, found, percent), "links")
        links = links.union(sure).union(open_pairs(listed.select("entry", "key"), common.components(sure), found, percent))
    near = common.components(links)
    keyed = rows.drop("seen")
    return common.skew_join(keyed, near.withColumnRenamed("node", "key"), "key", list(copied), "left").select(id_col, "text_hash", "n_shingles", F.coalesce("root", "key").alias("root"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): least id of the rows that links connect.

    Rows link when 100 * intersection >= percent * union of their distinct word shingles. A row
    with fewer words has its whole sequence as its one shingle; a null or wordless text is empty,
    links with nothing and is its own component. Repeated rows and ids keep their rows; a null id
    never names a component that has another id. An empty table gives an empty result, and other
    columns play no part. No cap, sample or prefix of a text: every pair over the threshold is found.
    """
    rows = common.cut(jaccard_classes(docs, words, percent, id_col, text_col), "classes")
    own = rows.where("root is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    rows = rows.where("root is not null")
    least = rows.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return common.skew_join(rows, least, "root", common.hot_keys(rows, "root")).select(id_col, "n_shingles", "component_id").union(own)
