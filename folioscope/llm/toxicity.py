"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word's input joins a hashed word embedding with the mean of its hashed character trigrams'
embeddings. All overlapping windows of a text run through both directions; attention pools a
window's states to a logit, and a smooth maximum over windows gives the text's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textvec import Words, mix, slices

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 15, 12
DW, DC, H, DA = 8, 8, 8, 8
SHARP = 2.0
AT_ONCE = 2048
TABLE_RATE = 1000.0


class Inputs:
    """Distinct words of a column (0 is the pad) and all overlapping windows as rows of word numbers."""

    def __init__(self, col: pa.Array):
        w = Words(col)
        h = w.hashes()
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.word = np.concatenate([[0], (u & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)])
        # trigrams over "<word>", of distinct words only
        a, size = w.start[first], (w.end - w.start)[first]
        n = size + 2
        end = np.cumsum(n)
        flat = np.full(int(end[-1]) + 2 if len(end) else 2, 60, np.uint64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(end - n, size) + 1 + at] = w.data[np.repeat(a, size) + at]
        flat[end - 1] = 62
        gram = flat[:-2] | flat[1:-1] << np.uint64(8) | flat[2:] << np.uint64(16)
        starts = np.repeat(end - n, size) + at
        self.gram = (mix(gram[starts]) & np.uint64((1 << CHAR_BITS) - 1)).astype(np.int64)
        self.gram_word = np.repeat(np.arange(1, len(u) + 1), size)
        self.gram_size = np.concatenate([[1], size])
        count = np.diff(w.first)
        per_doc = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(len(count)), per_doc)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        begin = w.first[self.doc] + k * STRIDE
        left = np.minimum(WINDOW, w.first[self.doc + 1] - begin)
        self.mask = np.arange(WINDOW) < left[:, None]
        number = np.concatenate([inverse.ravel() + 1, np.zeros(WINDOW, np.int64)])
        self.windows = np.where(self.mask, number[np.minimum(begin[:, None] + np.arange(WINDOW), len(number) - 1)], 0)
        self.n_docs = len(count)

    def embed(self, p: dict) -> np.ndarray:
        """(distinct words + 1, DW + DC) inputs; the pad's are 0."""
        e = np.zeros((len(self.word), DW + DC), np.float32)
        e[1:, :DW] = p["word"][self.word[1:]] * p["seen"][self.word[1:], None]
        c = np.zeros((len(self.word), DC), np.float32)
        if len(self.gram):
            edges = np.concatenate([[0], np.cumsum(self.gram_size[1:])[:-1]])
            c[1:] = np.add.reduceat(p["char"][self.gram], edges, axis=0)
        e[:, DW:] = c / self.gram_size[:, None]
        return e


def start(seed: int) -> dict:
    g = np.random.default_rng(seed)
    r = lambda *s, k=0.3: (g.standard_normal(s) * k).astype(np.float32)
    p = {"word": r(1 << WORD_BITS, DW, k=0.3), "char": r(1 << CHAR_BITS, DC, k=0.6), "A": r(2 * H, DA), "v": r(DA), "w": r(2 * H), "b": np.full(1, -2, np.float32), "seen": np.ones(1 << WORD_BITS, np.float32)}
    for d in "fb":
        p |= {f"W{d}": r(DW + DC, 3 * H), f"U{d}": r(H, 3 * H), f"c{d}": np.zeros(3 * H, np.float32)}
    return p


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _recur(gates: np.ndarray, idx: np.ndarray, u: np.ndarray, back: bool, keep: list | None):
    """States (WINDOW, n, H) of one direction; keep gets what the gradient needs."""
    n = len(idx)
    out, h = np.empty((WINDOW, n, H), np.float32), np.zeros((n, H), np.float32)
    for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
        x, hu = gates[idx[:, t]], h @ u
        zr = _sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
        new = h + z * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * H :]))
        out[t] = h = new
    return out


def _pool(p: dict, states: np.ndarray, mask: np.ndarray):
    a = np.tanh(states @ p["A"])
    s = np.where(mask.T, a @ p["v"], -1e9)
    s = np.exp(s - s.max(axis=0))
    alpha = s / s.sum(axis=0)
    pooled = (alpha[:, :, None] * states).sum(axis=0)
    return a, alpha, pooled, pooled @ p["w"] + p["b"][0]


def window_logits(p: dict, x: Inputs) -> np.ndarray:
    e = x.embed(p)
    gates = {d: e @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
    out = np.zeros(len(x.windows), np.float32)
    for a in range(0, len(out), AT_ONCE):
        idx, mask = x.windows[a : a + AT_ONCE], x.mask[a : a + AT_ONCE]
        states = np.concatenate([_recur(gates["f"], idx, p["Uf"], False, None), _recur(gates["b"], idx, p["Ub"], True, None)], axis=2)
        out[a : a + AT_ONCE] = _pool(p, states, mask)[3]
    return out


def text_logits(logits: np.ndarray, doc: np.ndarray, n: int, empty: float) -> np.ndarray:
    """A smooth maximum of each text's window logits; `empty` for texts without words."""
    out = np.full(n, empty, np.float64)
    if len(doc):
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top = np.maximum.reduceat(logits, edge)
        own = np.repeat(top, np.diff(np.append(edge, len(doc))))
        out[doc[edge]] = top + np.log(np.add.reduceat(np.exp(SHARP * (logits - own)), edge)) / SHARP
    return out


def _sum_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    i = index[order]
    if len(i):
        edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        out[i[edge]] = np.add.reduceat(values[order], edge, axis=0)
    return out


def gradient(p: dict, x: Inputs, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted mean log loss of the texts and its gradient."""
    e = x.embed(p)
    idx, mask, doc = x.windows, x.mask, x.doc
    gates = {d: e @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
    kept = {"f": [], "b": []}
    states = np.concatenate([_recur(gates["f"], idx, p["Uf"], False, kept["f"]), _recur(gates["b"], idx, p["Ub"], True, kept["b"])], axis=2)
    a, alpha, pooled, logits = _pool(p, states, mask)
    z = text_logits(logits, doc, x.n_docs, 0.0)
    prob = 1 / (1 + np.exp(-z))
    has = np.bincount(doc, minlength=x.n_docs) > 0
    weight = weight * has / max(1e-9, (weight * has).sum())
    loss = float((weight * (np.logaddexp(0, z) - label * z)).sum())
    dz = (weight * (prob - label))[doc] * np.exp(SHARP * (logits - z[doc]))
    dz = dz.astype(np.float32)
    g = {"w": pooled.T @ dz, "b": dz.sum(keepdims=True)}
    dpooled = dz[:, None] * p["w"]
    dalpha = (states * dpooled).sum(axis=2)
    ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    da = ds[:, :, None] * p["v"] * (1 - a * a)
    g["v"] = (a * ds[:, :, None]).sum(axis=(0, 1))
    g["A"] = np.tensordot(states, da, ((0, 1), (0, 1)))
    dstates = alpha[:, :, None] * dpooled + da @ p["A"].T
    de = np.zeros_like(e)
    for k, d in enumerate("fb"):
        dh, du = np.zeros((len(idx), H), np.float32), np.zeros_like(p[f"U{d}"])
        dx = np.empty((WINDOW, len(idx), 3 * H), np.float32)
        for t, h, zt, r, c, hc in reversed(kept[d]):
            dh = dh + dstates[t][:, k * H : (k + 1) * H]
            dc = dh * zt * (1 - c * c)
            dzt = dh * (c - h) * zt * (1 - zt)
            dr = dc * hc * r * (1 - r)
            dx[t] = np.concatenate([dzt, dr, dc], axis=1)
            dhu = np.concatenate([dzt, dr, dc * r], axis=1)
            du += h.T @ dhu
            dh = dh * (1 - zt) + dhu @ p[f"U{d}"].T
        dgates = _sum_by(idx.T.ravel(), dx.reshape(-1, 3 * H), len(e))
        g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = du, e.T @ dgates, dgates.sum(axis=0)
        de += dgates @ p[f"W{d}"].T
    g["word"] = _sum_by(x.word[1:], de[1:, :DW] * p["seen"][x.word[1:], None], 1 << WORD_BITS)
    g["char"] = _sum_by(x.gram, (de[:, DW:] / x.gram_size[:, None])[x.gram_word], 1 << CHAR_BITS)
    return loss, g


def common_words(texts: list[str], least: int) -> np.ndarray:
    """1 for each word slot that at least `least` texts have, else 0."""
    n = np.zeros(1 << WORD_BITS, np.int64)
    for t in texts:
        n[np.unique(Inputs(pa.array([t])).word[1:])] += 1
    return (n >= min(least, max(1, len(texts) // 20))).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, steps: int = 400, batch: int = 32, rate: float = 0.02, seed: int = 0, max_words: int = 12_000, min_texts: int = 3, table_rate: float = TABLE_RATE, counts: tuple[int, int] | None = None) -> dict:
    """Adam over random batches of whole texts; half of each batch is drawn from each label where both exist.

    A batch closes early at max_words words, or holds one longer text. Words of fewer than
    min_texts texts have no embedding of their own, only their characters'. The tables move by
    plain gradients, so a word counts by how often it occurs and texts aren't learnt by heart.
    counts: labels 0 and 1 in all the rows that texts are a sample of; the texts' own if not given.
    """
    g = np.random.default_rng(seed)
    p = start(seed)
    labels = np.asarray(labels, float)
    clean, toxic = counts or (len(labels) - labels.sum(), labels.sum())
    p["empty"] = np.array([np.log((toxic + 0.5) / (clean + 0.5))], np.float64) if clean + toxic else np.array([-2.0])
    live = [i for i, t in enumerate(texts) if t and t.strip()]
    groups = [np.array([i for i in live if labels[i] == y]) for y in (0, 1)]
    groups = [x for x in groups if len(x)]
    if not groups:
        return p
    size = np.array([len((t or "").split()) for t in texts])
    names = [k for k in p if k not in ("empty", "seen")]
    p["seen"] = common_words([texts[i] for i in live], min_texts)
    m, v = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    queue = [[] for _ in groups]
    for step in range(1, steps + 1):
        rows, words = [], 0
        while len(rows) < batch and words < max_words:
            k = len(rows) % len(groups)
            if not queue[k]:
                queue[k] = list(g.permutation(groups[k]))
            rows.append(queue[k].pop())
            words += size[rows[-1]]
        # batches are balanced; weights give the rates of all rows back in part
        share = toxic / (clean + toxic) if len(groups) > 1 else 0.5
        y = labels[rows]
        weight = np.where(y == 1, share**0.25, (1 - share) ** 0.25)
        _, d = gradient(p, Inputs(pa.array([texts[i] for i in rows])), y, weight)
        lr = rate * min(1, step / 20) * (0.1 + 0.9 * (1 - step / steps))
        for k in names:
            m[k] += 0.1 * (d[k] - m[k])
            v[k] += 0.01 * (d[k] ** 2 - v[k])
            p[k] -= lr * table_rate * m[k] if k in ("word", "char") else lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list, tuple[int, int]]:
    """At most about max_rows labelled texts, half of each label where there are enough, by a hash of the id; and how many labels 0 and 1 there are in all.

    Texts are whole; in the order of the hash, those after max_bytes / 2 of a label's texts are left out.
    """
    own = labels.select(id_col, F.col(label_col).alias("y")).where("y in (0, 1)").dropDuplicates([id_col])
    n = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(1 << 20))
    cap = lambda y: min(1 << 20, int(max_rows / 2 / max(1, n.get(y, 0)) * (1 << 20)))
    own = own.where(part < F.when(F.col("y") == 1, F.lit(cap(1))).otherwise(F.lit(cap(0))))
    rows = docs.select(id_col, text_col).join(F.broadcast(own), id_col)  # about max_rows labels
    size = F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).over(Window.partitionBy("y").orderBy(F.xxhash64(id_col, F.lit(9)), id_col).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(id_col, text_col, "y", size.alias("_held")).where(F.col("_held") <= max_bytes / 2)
    return rows.orderBy(id_col).collect(), (n.get(0, 0), n.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2400, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **kw) -> dict:
    """A network trained on a bounded sample: max_rows labelled rows in expectation, of max_bytes of text at most.

    Null and empty texts train nothing, but their labels count in the rates. Labels other than 0 and
    1 and labels of no document are left out; of repeated labels of an id one counts. Without any label
    the network stays as it was started.
    """
    rows, counts = labelled_sample(docs, labels, max_rows, max_bytes, id_col, text_col, label_col)
    return train([r[text_col] for r in rows], np.array([r["y"] for r in rows]), counts=counts, **kw)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_windows) of every whole text; null and empty texts get the rate of all labels."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = sent.value
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                x = Inputs(part.column(1))
                z = text_logits(window_logits(p, x), x.doc, x.n_docs, float(p["empty"][0]))
                n = np.bincount(x.doc, minlength=x.n_docs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60)))), pa.array(n)], [id_col, "score", "n_windows"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, n_windows long")
