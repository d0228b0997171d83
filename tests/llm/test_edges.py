"""Plain versions of network, filters, tree and exponent, and each operator on one table of edge rows."""

import base64
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, common, flac, hmm, jaccard, langid, mixing, packing, shards, templates, textvec, toxicity

from .test_llm import ITEM, prose, speech, table


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(p, words):
    """The network's logit of one window of words, one state and unit at a time."""
    inputs = []
    for word in words:
        slot = int(textvec.Words(pa.array([word])).hashes()[0]) % (1 << toxicity.WORD_BITS)
        b = f"<{word}>".encode()
        grams = [int(textvec.mix(np.array([b[i] | b[i + 1] << 8 | b[i + 2] << 16], np.uint64))[0]) % (1 << toxicity.CHAR_BITS) for i in range(len(b) - 2)]
        inputs.append([*(p["word"][slot] * p["seen"][slot]), *(sum(p["char"][x][j] for x in grams) / len(grams) for j in range(toxicity.DC))])
    n = toxicity.H
    both = []
    for d in "fb":
        h, states = [0.0] * n, []
        for x in inputs if d == "f" else inputs[::-1]:
            a = [sum(x[i] * p[f"W{d}"][i][j] for i in range(len(x))) + p[f"c{d}"][j] for j in range(3 * n)]
            u = [sum(h[i] * p[f"U{d}"][i][j] for i in range(n)) for j in range(3 * n)]
            z, r = ([sigmoid(a[o + j] + u[o + j]) for j in range(n)] for o in (0, n))
            c = [math.tanh(a[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
            h = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(n)]
            states.append(h)
        both.append(states if d == "f" else states[::-1])
    states = [a + b for a, b in zip(*both, strict=True)]
    weight = [math.exp(sum(v * math.tanh(sum(s[i] * p["A"][i][j] for i in range(2 * n))) for j, v in enumerate(p["v"]))) for s in states]
    pooled = [sum(w * s[i] for w, s in zip(weight, states, strict=True)) / sum(weight) for i in range(2 * n)]
    return sum(x * w for x, w in zip(pooled, p["w"], strict=True)) + p["b"][0]


def test_network_against_plain_loops():
    p = toxicity.start(3)
    p["seen"] = (np.arange(1 << toxicity.WORD_BITS) % 3 > 0).astype(np.float32)
    texts = ["one", "a few words é here", " ".join(f"w{i % 50}" for i in range(75))]
    x = toxicity.Inputs(pa.array(texts))
    got = toxicity.window_logits(p, x)
    expect, owner = [], []
    for i, t in enumerate(texts):
        words = t.split()
        for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            expect.append(plain_logit(p, words[a : a + toxicity.WINDOW]))
            owner.append(i)
    assert x.doc.tolist() == owner and np.allclose(got, expect, atol=1e-4)
    soft = [math.log(sum(math.exp(toxicity.SHARP * e) for e, o in zip(expect, owner, strict=True) if o == i)) / toxicity.SHARP for i in range(3)]
    assert np.allclose(toxicity.text_logits(got, x.doc, 3, -1.0), soft, atol=1e-4)


def plain_grams(text):
    b = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode())
    b = b"  " + b + b"  "
    return [g for g in (b[i : i + 4] for i in range(len(b) - 3)) if g != b"    "]


def test_language_scores_against_sets(spark):
    """Sets of n-grams without hashes: the same languages, and scores apart by false hits alone."""
    train = {k: speech(k, 80, i) for i, k in enumerate(("de", "en", "fr"))}
    count = {k: Counter(g for t in texts for g in plain_grams(t)) for k, texts in train.items()}
    count = {k: {g: n for g, n in c.items() if n >= 3} for k, c in count.items()}
    total = {k: sum(c.values()) for k, c in count.items()}
    most = Counter()
    for k, c in count.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[k])
    held = {k: {g for g, n in c.items() if n / total[k] >= 0.35 * most[g]} for k, c in count.items()}
    model = langid.fit(table(spark, sum(train.values(), []), [k for k in train for _ in range(80)]))
    texts = [t for i, k in enumerate(train) for t in speech(k, 20, 50 + i)]
    got = {r["doc_id"]: r for r in langid.predict(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        hits = {k: sum(g in held[k] for g in plain_grams(t)) for k in held}
        best = max(sorted(hits), key=hits.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - hits[best] / sum(hits.values())) < 0.03 and abs(got[i]["coverage"] - hits[best] / len(plain_grams(t))) < 0.03


def plain_tree(points, scale, first, k):
    """{doc_id: shard} by sorting each node's points along its widest dimension."""
    if k == 1 or not points:
        return {p["doc_id"]: first for p in points}
    span = [max(p[d] for p in points) - min(p[d] for p in points) for d in shards.DIMS]
    d = max(range(len(span)), key=lambda i: (span[i] / (scale[i] or 1), -i))
    low = min(p[shards.DIMS[d]] for p in points)
    place = lambda p: (math.floor((p[shards.DIMS[d]] - low) / max(span[d], 1e-12) * ((1 << 20) - 1)), p["tie"])
    goal, before = sum(p["size"] for p in points) * (k // 2) / k, 0
    left = set()
    for key in sorted({place(p) for p in points}):
        own = sum(p["size"] for p in points if place(p) == key)
        if before + own < goal or 2 * (math.ceil(goal) - before) >= own:
            left.add(key)
        before += own
        if before >= goal:
            break
    a, b = ([p for p in points if (place(p) in left) == side] for side in (True, False))
    return plain_tree(a, scale, first, k // 2) | plain_tree(b, scale, first + k // 2, k - k // 2)


@pytest.mark.parametrize("n_shards", [5, 8])
def test_kd_shards_against_a_plain_tree(spark, n_shards):
    texts = [None, "", "same", "same", "tie\n", "\ntie"] + prose(300, 21)
    docs = table(spark, texts)
    points = [r.asDict() for r in shards.describe(docs, "doc_id", "text").collect()]
    scale = [max(p[d] for p in points) - min(p[d] for p in points) for d in shards.DIMS]
    got = {r["doc_id"]: r["shard"] for r in shards.kd_shards(docs, n_shards=n_shards, heavy=1e9).collect()}
    assert got == plain_tree(points, scale, 0, n_shards)


def test_exponent_against_a_grid():
    tokens = {"a": 90_000, "b": 1_000, "c": 700, "d": 3}
    for limit in (2.0, 5.0, 40.0):
        most = lambda a: max((t / 90_003.0) ** (a - 1) for t in tokens.values()) / min((t / 90_003.0) ** (a - 1) for t in tokens.values())  # noqa: E731  least repeated: once
        grid = next(a for a in np.linspace(0, 1, 20_001) if most(a) <= limit)
        assert abs(mixing.solve_exponent(tokens, max_epochs=limit) - grid) < 1e-4


CLASHING = ("score", "n_windows", "lang_pred", "coverage", "held", "y", "key", "s", "block", "row", "times", "shard", "slot", "epoch", "text_hash", "n_tokens", "media", "root", "codes", "range", "_id", "_hash", "_held", "n", "digit")
LONG = " ".join(f"word{i % 997}" for i in range(150_000))
EDGES = [None, "", " \n\t", LONG, "the same text twice", "the same text twice", "zwölf böse 漢字 \U0001f600", "12 34 !", ITEM]


@pytest.fixture(scope="module")
def edges(spark):
    """Null, empty, wordless, very long and equal texts; repeated rows and null ids; null lang and source; clashing columns."""
    docs = table(spark, EDGES, [None] * len(EDGES), [None] * len(EDGES)).withColumns({c: F.lit(1) for c in CLASHING})
    more = docs.where("doc_id in (3, 4, 8)")
    docs = docs.unionAll(more).unionAll(docs.where("doc_id in (0, 4)").withColumn("doc_id", F.lit(None).cast("long")))
    docs = common.cut(docs, "edges")
    return docs, Counter(r["doc_id"] for r in docs.select("doc_id").collect())


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def equal_rows(rows, of, *columns):
    """Rows of one id have one result."""
    assert len({tuple(r[c] for c in columns) for r in rows if r["doc_id"] == of}) == 1


def test_toxicity_of_edge_rows(spark, edges):
    docs, n = edges
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (0, 1), (99, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels, steps=3)).collect()
    assert ids(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    equal_rows(rows, 4, "score", "n_windows")
    assert {r["n_windows"] for r in rows if r["doc_id"] == 3} == {1 + math.ceil((150_000 - toxicity.WINDOW) / toxicity.STRIDE)}


def test_language_of_edge_rows(spark, edges):
    docs, n = edges
    for model in (langid.fit(docs), langid.fit(docs.withColumn("lang", F.lit("en")))):  # no label at all; ids and texts null
        rows = langid.predict(docs, model).collect()
        assert ids(rows) == n and {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 7)} == {langid.UNKNOWN}
        equal_rows(rows, 3, "lang_pred", "score")
        assert langid.predict(docs, model, carry=True).select("row.*").columns == docs.columns


def test_mixture_and_shards_of_edge_rows(spark, edges):
    docs, n = edges
    rows = mixing.mix_sources(docs, max_epochs=2.0).where("epoch = 0").collect()
    assert ids(rows) == n and {r["source"] for r in rows} == {None}
    rows = shards.kd_shards(docs, n_shards=3).collect()
    assert ids(rows) == n and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(3))


def test_decontamination_of_edge_rows(spark, edges):
    docs, n = edges
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, ITEM)], "item_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    got = {(r["doc_id"], r["item_id"]) for r in templates.decontaminate(docs, items).collect()}
    assert got == {(8, 1), (8, None)}


def test_packing_of_edge_rows(spark, edges, tmp_path):
    docs, n = edges
    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    rows = packing.pack_documents(docs, str(path), length=4096, end_id=300, pad_id=301).collect()
    size = Counter()
    for r in rows:
        for i, a, b in zip(r["ids"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            size[i] += b - a
    expect = Counter()
    for i, k in n.items():
        if i is not None:
            expect[i] = k * (len((EDGES[i] or "").encode()) + 1)
    expect[None] = 1 + len(EDGES[4]) + 1
    assert size == expect


def test_models_and_media_of_edge_rows(spark, edges):
    docs, n = edges
    rows = hmm.score(docs.withColumn("trains", common.fold() != 1), "trains", states=2, rounds=1).collect()
    assert ids(rows) == n and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 3} == {150_001}
    rows = flac.digests(flac.encode_texts(docs)).collect()
    assert ids(rows) == n and {r["n_bytes"] for r in rows if r["doc_id"] == 3} == {len(LONG)}
    equal_rows(rows, 4, "payload_sha256", "media_sha256", "feature")
    rows = jaccard.jaccard_components(docs).collect()
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4} and {r["n_shingles"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}


def test_conversations_of_edge_rows(spark):
    rows = [(1, 0, "user", "a" * 300_000 + "</turn>"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (1, None, None, None), (2, 5, "assistant", ""), (None, 0, "assistant", "### User: ~"), (3, 1, "as~:sis\ntant", "\\")]
    table_ = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "loss", "turns", "n_turns")})
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table_)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, 2: 1, None: 1, 3: 1}
    assert [got[k]["loss_chars"] for k in (1, 2, None, 3)] == [0, 0, len("### User: ~"), 0]
    assert chat.digests(chat.format_conversations(table_.limit(0))).count() == 0
