"""Hidden Markov language model with Baum-Welch counts aggregated across partitions.

A text is its words and one end token. The model emits a code for each token: the end, a frequent
word, or a class of other words by their form (ending or, if short, the word itself). Inside a
class a word is drawn by its training count, or is unknown with a Good-Turing probability, so

    log10 P(text) = log10 P(codes) + sum over class words of log10 P(word | class).

Codes' likelihood is exact, by the scaled forward recursion over the whole text. Word counts are
gathered from the whole training corpus by hash buckets; texts get back only sums. Words that would
fill a bucket by themselves are warm: they are counted once and scored where they stand.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textvec import Words, binary, buffers, mix, slices

FORMS = 1024
#: A word is frequent from this share of all training words on; so there are at most its inverse.
HOT = 5e-4
SEGMENT = 128
MOST_CANDIDATES = 4_000_000
#: Text bytes for each bucket of words, which is one task.
BUCKET_BYTES = 32 << 20
#: No list of words that is sent to the tasks has words of a smaller share; so there are at most its inverse.
LEAST_SHARE = 1e-6


def forms(w: Words, h: np.ndarray) -> np.ndarray:
    """The form class of each word, 0 to FORMS - 1: the word itself if short, else its ending and length class."""
    size = w.end - w.start
    tail = np.zeros(len(h), np.uint64)
    for j in range(1, 4):
        tail = tail << np.uint64(8) | w.data[np.maximum(w.end - j, 0)]
    key = np.where(size <= 4, h, mix(tail * np.uint64(4) + np.minimum(size // 6, 3).astype(np.uint64)))
    return (mix(key + np.uint64(77)) % np.uint64(FORMS)).astype(np.int64)


def encode(w: Words, h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Codes: 1 to len(hot) are the frequent words (hot holds their sorted hashes), then the forms."""
    code = forms(w, h) + 1 + len(hot)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        code = np.where(hot[at] == h, at + 1, code)
    return code


def among(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the hashes that are among sorted words, and where there."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    own = np.flatnonzero(words[at] == h)
    return own, at[own]


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("i").agg(F.sum("x").alias("x"))


def word_counts(batches, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a task's texts, sorted, and their exact counts."""
    u, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, text_col):
            h, n = np.unique(Words(part.column(0)).hashes(), return_counts=True)
            u, back = np.unique(np.concatenate([u, h]), return_inverse=True)
            c = np.bincount(back, np.concatenate([c, n]), len(u)).astype(np.int64)
    return u, c


def frequent_words(train: DataFrame, text_col: str, share: float = HOT) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the words that are at least `share` of all training words, their counts, and the number of all.

    The result does not depend on how rows are dealt. A word that frequent is so in some task, so the first pass lists each task's frequent words, and
    the second counts just these in all tasks. Its tasks get the list broadcast while it has at most
    MOST_CANDIDATES words; a longer one is joined by a shuffle.
    """

    def candidates(batches):
        u, c = word_counts(batches, text_col)
        yield pa.RecordBatch.from_arrays([pa.array(u[c >= share * c.sum()].view(np.int64))], ["i"])

    texts = train.select(text_col)
    listed = common.cut(texts.mapInArrow(candidates, "i long").distinct(), "hot")
    few = listed.count() <= MOST_CANDIDATES
    sent = train.sparkSession.sparkContext.broadcast(np.sort(np.array([r["i"] for r in listed.collect()], np.int64).view(np.uint64)) if few else None)

    def count(batches):
        u, c = word_counts(batches, text_col)
        n = float(c.sum())
        if sent.value is not None:
            own = np.isin(u, sent.value, assume_unique=True)
            u, c = u[own], c[own]
        # the number of all words goes with a null
        yield pa.RecordBatch.from_arrays([pa.array([None, *u.view(np.int64).tolist()], pa.int64()), pa.array([n, *c.tolist()], pa.float64())], ["i", "x"])

    counts = texts.mapInArrow(count, "i long, x double")
    if not few:
        counts = counts.join(listed, "i", "left_semi").union(counts.where("i is null"))
    found = common.cut(totals(counts), "hot")
    n = found.where("i is null").agg(F.sum("x")).first()[0] or 0
    rows = found.where(F.col("i").isNotNull() & (F.col("x") >= share * n)).collect() if n else []  # 1 / share words at most
    common.drop(listed)
    common.drop(found)
    words = np.array([r["i"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["x"] for r in rows], np.float64)[order], int(n)


def coded(docs: DataFrame, hot: np.ndarray, warm: np.ndarray, warm_count: np.ndarray, text_col: str) -> DataFrame:
    """docs with the text replaced by its codes, as packed 16-bit numbers with the end's 0 last.

    warm_codes are those of its warm words; warm_base and warm_log sum their log10(c + 0.5) and log10(c).
    """
    keep = [c for c in docs.columns if c != text_col]
    sent = docs.sparkSession.sparkContext.broadcast((hot, warm, warm_count))  # at most 1 / LEAST_SHARE words

    def run(batches):
        hot, warm, warm_count = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                w = Words(part.column(part.schema.get_field_index(text_col)))
                h = w.hashes()
                code = encode(w, h, hot)
                n = len(w.off) - 1
                own, at = among(h, warm)
                sums = [np.bincount(w.doc[own], f(warm_count[at]), n).astype(np.float64) for f in (lambda c: np.log10(c + 0.5), np.log10)]
                warm_ends = np.cumsum(np.bincount(w.doc[own], minlength=n))
                ends = w.first[1:] + np.arange(1, n + 1)
                flat = np.zeros(len(code) + n, np.uint16)
                flat[np.arange(len(code)) + w.doc] = code
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), binary(flat, ends), binary(code[own].astype(np.uint16), warm_ends), *map(pa.array, sums)], [*keep, "codes", "warm_codes", "warm_base", "warm_log"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{kinds}, codes binary, warm_codes binary, warm_base double, warm_log double")


def code_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off, data = buffers(col)
    return off // 2, np.frombuffer(data.tobytes(), np.uint16).astype(np.int64)


@dataclass
class Model:
    """Broadcast as a tuple of arrays, since executors need not have this class."""

    hot: np.ndarray
    count: np.ndarray  # training tokens of each code
    first: np.ndarray  # K
    resume: np.ndarray  # K: state at the head of a later segment, in training only
    move: np.ndarray  # K x K
    emit: np.ndarray  # codes x K


def segments(off: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in rows of SEGMENT codes, their lengths, and which begin a text."""
    n = np.diff(off)
    k = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), k)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    begin = off[doc] + nth * SEGMENT
    size = np.minimum(SEGMENT, off[doc + 1] - begin)
    at = begin[:, None] + np.arange(SEGMENT)
    return code[np.minimum(at, max(0, len(code) - 1))], size, nth == 0


def expected_counts(m: Model, off: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of texts: first, resume, move, emit, and the log likelihood of the segments."""
    seg, size, head = segments(off, code)
    order = np.argsort(-size, kind="stable")
    seg, size, head = seg[order], size[order], head[order]
    k = len(m.first)
    live = np.searchsorted(-size, -np.arange(SEGMENT), "left")
    n = len(seg)
    alpha, scale = np.zeros((SEGMENT, n, k), np.float32), np.ones((SEGMENT, n), np.float32)
    emit, move = m.emit.astype(np.float32), m.move.astype(np.float32)
    for t in range(SEGMENT):
        a = live[t]
        if not a:
            break
        p = np.where(head[:a, None], m.first, m.resume).astype(np.float32) if t == 0 else alpha[t - 1, :a] @ move
        p = p * emit[seg[:a, t]]
        s = p.sum(axis=1)
        scale[t, :a] = s
        alpha[t, :a] = p / s[:, None]
    beta = np.ones((n, k), np.float32)
    moved, gamma = np.zeros((k, k)), np.zeros((SEGMENT, n, k), np.float32)
    for t in range(SEGMENT - 1, -1, -1):
        a = live[t]
        if not a:
            continue
        gamma[t, :a] = alpha[t, :a] * beta[:a]
        if t:
            b = emit[seg[:a, t]] * beta[:a] / scale[t, :a, None]
            moved += alpha[t - 1, :a].T.astype(np.float64) @ b
            beta[:a] = b @ move.T
    used = np.arange(SEGMENT)[:, None] < size
    g, c = gamma[used], seg.T[used]
    out = np.stack([np.bincount(c, g[:, j], len(emit)) for j in range(k)], axis=1)
    return gamma[0][head].sum(axis=0), gamma[0][~head].sum(axis=0), moved * m.move, out, float(np.log(scale[used]).sum())


def train(rows: DataFrame, hot: np.ndarray, states: int = 8, rounds: int = 4, seed: int = 0) -> Model:
    """Baum-Welch on the coded training texts, every text in every round.

    For training, texts are cut into segments of SEGMENT tokens; later segments begin in states
    drawn from `resume`. Each task adds up its texts' counts; the driver sees one row an index.
    """
    spark = rows.sparkSession
    n_codes = 1 + len(hot) + FORMS

    def histogram(batches):
        total = np.zeros(n_codes)
        for batch in batches:
            for part in slices(batch, "codes", 1 << 20):
                total += np.bincount(code_arrays(part.column(0))[1], minlength=n_codes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_codes)), pa.array(total)], ["i", "x"])

    def filled(df, n):
        out = np.zeros(n)
        for r in df.collect():
            out[r["i"]] = r["x"]
        return out

    rows = rows.select("codes")
    count = filled(totals(rows.mapInArrow(histogram, "i long, x double")), n_codes)
    g = np.random.default_rng(seed)
    prior = (count + 0.5) / (count.sum() + 0.5 * n_codes)
    emit = prior[:, None] * np.exp(g.standard_normal((n_codes, states)))
    stay = 0.8 * np.eye(states) + 0.2 / states
    m = Model(hot, count, np.full(states, 1 / states), np.full(states, 1 / states), stay, emit / emit.sum(axis=0))
    size = 2 * states + states * states + n_codes * states
    for _ in range(rounds if count.sum() else 0):
        sent = spark.sparkContext.broadcast(astuple(m))

        def step(batches, sent=sent):
            m, total = Model(*sent.value), np.zeros(size)
            for batch in batches:
                for part in slices(batch, "codes", 1 << 19):
                    a, b, c, d, _ = expected_counts(m, *code_arrays(part.column(0)))
                    total += np.concatenate([a, b, c.ravel(), d.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "x"])

        x = filled(totals(rows.mapInArrow(step, "i long, x double")), size)
        first, resume, move, emit = np.split(x, np.cumsum([states, states, states * states]))
        unit = lambda v, axis=0: v / v.sum(axis=axis, keepdims=True)
        m = Model(hot, count, unit(first + 0.1), unit(resume + 0.1), unit(move.reshape(states, states) + 0.1, 1), unit(emit.reshape(n_codes, states) + 10 * prior[:, None]))
    return m


def forward(m: Model, off: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact natural log likelihood of each text's codes."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    begin, size = off[:-1][order], n[order]
    out, p = np.zeros(len(n)), np.tile(m.first, (len(n), 1))
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for t, a in enumerate(live):
        p = (p[:a] if t == 0 else p[:a] @ m.move) * m.emit[code[begin[:a] + t]]
        s = p.sum(axis=1)
        out[:a] += np.log(s)
        p /= s[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def rare_sums(docs: DataFrame, hot: np.ndarray, warm: np.ndarray, count: np.ndarray, buckets: int, key_col: str, train_col: str, text_col: str) -> DataFrame:
    """(key, base, known, inside, kinds, once) by summing over the words that are neither frequent nor warm.

    For a key: sums over its rows' words of log10(c + 0.5), of 1 where c > 0, and there of
    log10(c / training words of the class). Rows with a null key hold the number of distinct
    training words and of those met once. A word's hash keeps 48 bits besides its bucket's. A bucket
    is one group in memory, so buckets grow with the texts; a word has one row a text and 255 times.
    """
    bits = max(1, (buckets - 1).bit_length())
    n_buckets, shift = 1 << bits, np.uint64(64 - bits)
    first_form = 1 + len(hot)
    base_of = np.log10(np.maximum(count, 1))

    def deal(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                w = Words(part.column(2))
                h = w.hashes()
                code = encode(w, h, hot)
                rare = code >= first_form
                rare[among(h, warm)[0]] = False
                rare = np.flatnonzero(rare)
                h, code, doc = h[rare], code[rare], w.doc[rare]
                order = np.lexsort((h, doc))
                h, code, doc = h[order], code[order], doc[order]
                if not len(h):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
                times = np.diff(np.append(edge, len(h)))
                more = -(-times // 255)  # a word met over 255 times takes several entries
                times = np.where(np.arange(more.sum()) == np.repeat(np.cumsum(more) - 1, more), np.repeat((times - 1) % 255 + 1, more), 255).astype(np.uint8)
                edge = np.repeat(edge, more)
                h, code, doc = h[edge], code[edge].astype(np.uint16), doc[edge]
                b = (h >> shift).astype(np.uint16 if bits <= 16 else np.uint32)
                order = np.argsort(b, kind="stable")
                b, h, code, doc, times = b[order], h[order], code[order], doc[order], times[order]
                edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
                ends = edges[1:]
                keys, trains = np.asarray(part.column(0)), np.array(part.column(1).to_pylist(), bool)
                run_ = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (b[1:] != b[:-1])]))
                size = np.diff(np.append(run_, len(doc)))
                more = -(-size // 32767)  # as many heads as a text's entries in the bucket need
                who = np.repeat(doc[run_], more)
                size = np.where(np.arange(more.sum()) == np.repeat(np.cumsum(more) - 1, more), np.repeat((size - 1) % 32767 + 1, more), 32767)
                heads = (size | trains[who] << 15).astype(np.uint16)
                own = np.searchsorted(np.repeat(b[run_], more), b[edges[:-1]], "right")
                yield pa.RecordBatch.from_arrays([pa.array(b[edges[:-1]].astype(np.int32)), binary(keys[who], own), binary(heads, own), binary(h.astype(np.uint32), ends), binary((h >> np.uint64(32)).astype(np.uint16), ends), binary(code, ends), binary(times, ends)], ["bucket", "keys", "heads", "low", "mid", "codes", "times"])

    def flat(t: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

    def add(t: pa.Table) -> pa.Table:
        heads = flat(t, "heads", np.uint16)
        key, is_train = np.repeat(flat(t, "keys", np.int64), heads & 32767), np.repeat(heads >> 15, heads & 32767)
        word = flat(t, "low", np.uint32).astype(np.uint64) | flat(t, "mid", np.uint16).astype(np.uint64) << np.uint64(32)
        code, times = flat(t, "codes", np.uint16), flat(t, "times", np.uint8).astype(np.float64)
        order = np.argsort(word)
        edge = np.concatenate([[True], word[order][1:] != word[order][:-1]]) if len(word) else np.zeros(0, bool)
        kind = np.empty(len(word), np.int64)
        kind[order] = np.cumsum(edge) - 1
        n = np.bincount(kind, times * is_train, int(edge.sum()))
        own = n[kind]
        known = own > 0
        base, inside = times * np.log10(own + 0.5), times * np.where(known, np.log10(np.maximum(own, 1)) - base_of[code], 0)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
        who = key[order][edge]
        add_up = lambda v: np.add.reduceat(v[order], edge) if len(edge) else v
        cols = [who, add_up(base), add_up(times * known).astype(np.float32), add_up(inside).astype(np.float32)]
        q = (mix(who.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
        by = np.argsort(q, kind="stable")
        q, cols = q[by], [x[by] for x in cols]
        ends = np.flatnonzero(np.concatenate([q[1:] != q[:-1], [True]])) + 1 if len(q) else np.zeros(0, np.int64)
        out = pa.table({"q": pa.array(q[ends - 1]), "keys": binary(cols[0], ends), "base": binary(cols[1], ends), "known": binary(cols[2], ends), "inside": binary(cols[3], ends)})
        stats = pa.table({"q": pa.array([-1], pa.int32()), "keys": pa.array([b""], pa.binary()), "base": pa.array([np.array([(n > 0).sum()], np.float64).tobytes()], pa.binary()), "known": pa.array([np.array([(n == 1).sum()], np.float64).tobytes()], pa.binary()), "inside": pa.array([b""], pa.binary())})
        return pa.concat_tables([out, stats])

    def gather(t: pa.Table) -> pa.Table:
        if t.column("q")[0].as_py() < 0:
            return pa.table({"key": pa.array([None], pa.int64()), "base": pa.array([flat(t, "base", np.float64).sum()]), "known": pa.array([flat(t, "known", np.float64).sum()]), "inside": pa.array([0.0])})
        key = flat(t, "keys", np.int64)
        u, inv = np.unique(key, return_inverse=True)
        return pa.table({"key": pa.array(u), **{c: pa.array(np.bincount(inv, flat(t, c, kind), len(u))) for c, kind in (("base", np.float64), ("known", np.float32), ("inside", np.float32))}})

    dealt = docs.select(key_col, train_col, text_col).mapInArrow(deal, "bucket int, keys binary, heads binary, low binary, mid binary, codes binary, times binary")
    added = dealt.repartitionById(n_buckets, "bucket").groupBy("bucket").applyInArrow(add, "q int, keys binary, base binary, known binary, inside binary")
    return added.repartitionById(n_buckets, "q").groupBy("q").applyInArrow(gather, "key long, base double, known double, inside double")


def score(docs: DataFrame, train_col: str, states: int = 8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", warm_share: float | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Rows whose boolean train_col is true are the training corpus; with none, every word is
    unknown. A null text is empty: one token, the end. score is the model's log10 probability of
    the text, base_score that of an add-half unigram model. Repeated rows are scored alike, and
    count in training as often as they occur. A word is warm from warm_share of the training words
    on, by default an eighth of what a bucket holds on average.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, F.coalesce(F.col(train_col), F.lit(False)).alias(train_col), F.xxhash64(id_col, text_col).alias("key"), text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4, 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length())
    share = min(HOT, max(LEAST_SHARE, 1 / (8 * buckets) if warm_share is None else warm_share))
    words, counts, n_words = frequent_words(docs.where(train_col), text_col, share)
    is_hot = counts >= HOT * n_words
    hot, warm, warm_count = words[is_hot], words[~is_hot], counts[~is_hot]
    rows = common.cut(coded(docs, hot, warm, warm_count, text_col), "codes")
    m = train(rows.where(train_col), hot, states, rounds)
    sums = common.cut(rare_sums(docs, hot, warm, m.count, buckets, "key", train_col, text_col), "sums")
    got = sums.where("key is null").agg(F.sum("base"), F.sum("known")).first()
    kinds, once = (got[0] or 0.0) + len(warm), (got[1] or 0.0) + int((warm_count == 1).sum())
    hot_end = 1 + len(hot)
    n_train, n_rare = m.count.sum(), m.count[hot_end:].sum()
    vocab = kinds + (m.count[:hot_end] > 0).sum()
    unknown = min(0.5, max(once, 0.5) / max(n_rare, 1.0)) if n_rare else 0.5
    sent = spark.sparkContext.broadcast(astuple(m))
    norm = math.log10(n_train + 0.5 * (vocab + 1))

    def run(batches):
        m = Model(*sent.value)
        base, known = np.log10(m.count + 0.5), (m.count > 0).astype(float)
        base[hot_end:] = known[hot_end:] = 0
        base_of = np.log10(np.maximum(m.count, 1))
        for batch in batches:
            for part in slices(batch, "codes", 1 << 20):
                off, code = code_arrays(part.column(2))
                add_up = lambda v: np.add.reduceat(v[code], off[:-1])  # noqa: B023, E731  no text is without codes
                warm_off, warm_code = code_arrays(part.column(3))
                n_warm = np.diff(warm_off)
                warm_sum = np.concatenate([[0], np.cumsum(base_of[warm_code])])
                inside = np.asarray(part.column(5)) - (warm_sum[warm_off[1:]] - warm_sum[warm_off[:-1]])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(off)), pa.array(add_up(base) + np.asarray(part.column(4))), pa.array(add_up(known)), pa.array(n_warm), pa.array(inside), pa.array(np.add.reduceat((code >= hot_end).astype(np.int64), off[:-1])), pa.array(forward(m, off, code) / math.log(10))], [id_col, "key", "n_tokens", "b", "k", "n_warm", "warm_inside", "n_rare", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = rows.select(id_col, "key", "codes", "warm_codes", "warm_base", "warm_log").mapInArrow(run, f"`{id_col}` {kind}, key long, n_tokens long, b double, k double, n_warm long, warm_inside double, n_rare long, f double")
    # rows of one key have one text, and each added its words to the key's sums
    same = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    per_key = sums.where("key is not null").join(same, "key").select("key", *[(F.col(c) / F.col("times")).alias(c) for c in ("base", "known", "inside")])
    all_ = common.skew_join(own, per_key, "key", common.hot_keys(rows, "key"), "left").na.fill(0.0, ["base", "known", "inside"])
    rare_known, n_hot = F.round("known") + F.col("n_warm"), F.col("k")
    n_known = n_hot + rare_known
    return all_.select(
        F.col(id_col), "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("b") + F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("f") + F.col("inside") + F.col("warm_inside") + rare_known * math.log10(1 - unknown) + (F.col("n_rare") - rare_known) * math.log10(unknown)).alias("score"),
    )
