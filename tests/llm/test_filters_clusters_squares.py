"""Filter audit, centroid tree and packing by squared counts against plain versions and exact round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscope.llm import interactions, squares, vantage

from .test_llm import DOC, prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- 11: filter audit ----------------------------------------------------------------------------


def plain_failures(docs):
    """{row number: letters failed} of (doc_id, text) rows."""
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        out.append(fails + ("E" if i is not None and any(j is not None and j < i and (s or "") == t for j, s in docs) else ""))
    return out


def plain_audit(rows, letters="ABCDE", orders=None):
    """rows: (part, fails, good, toxic); every order applied step by step."""
    out, listed = {}, orders or ["".join(p) for p in itertools.permutations(letters)]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = defaultdict(int)
        for order in listed:
            alive = own
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(alive), len(gone), len(failing) - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audit_table(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def filter_texts():
    g = random.Random(5)
    long = [" ".join(g.choice(["Word", "word"]) + str(g.randint(0, k)) for _ in range(n)) for n, k in ((250, 2000), (200, 90), (199, 1000), (300, 40))]
    return [*prose(12, 3), *long, *long[:2], None, "", "", " \t", "100 % #", "A" * 5, "ÄÖÜ" + "a" * 7, "w" + " x" * 150_000, "a\x1cb \xa0c"]


def test_audit_against_every_order(spark):
    texts = filter_texts()
    g = random.Random(6)
    docs = [(i if i != 3 else None, t, "en", g.choice(["a", "b", None, ""]), 0, "x", 1, 2) for i, t in enumerate(texts)]
    docs += [docs[12], docs[12], (None, *docs[13][1:]), (3, *docs[12][1:])]  # repeated rows; no id; a smaller id with the same text
    labels = [(i, g.choice([0, 1, None]), g.choice([0, 1])) for i in range(0, len(texts), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    rows = interactions.failures(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = plain_failures([d[:2] for d in docs])
    assert {f for x in fails for f in x} == set("ABCDE")
    got = audit_table(interactions.audit(rows, lost={"good_lost": "good", "toxic_lost": "toxic"}))
    want = plain_audit([(d[3] or "", f, d[0] in good, d[0] in toxic) for d, f in zip(docs, fails, strict=True)])
    assert got == want and len(got) == 600 * 3  # parts a, b and the empty one


def test_audit_of_rules_and_names(spark):
    g = random.Random(7)
    rows = [(g.choice("pq"), *[g.choice([True, False, None]) for _ in range(3)], g.randint(0, 4)) for _ in range(40)]
    df = spark.createDataFrame(rows, "part string, short boolean, odd boolean, copy boolean, n long")
    orders = [o for o in itertools.permutations(["short", "odd", "copy"]) if o.index("short") < o.index("copy")]
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in interactions.audit(df, ["short", "odd", "copy"], after={"copy": ["short"]}).collect()}
    short = {"short": "S", "odd": "O", "copy": "C"}
    flat = [(p, "".join(k for k, v in zip("SOC", f, strict=True) if v), 0, 0) for p, *f, n in rows for _ in range(n)]
    want = plain_audit(flat, orders=["".join(short[f] for f in o) for o in orders])
    assert got == {(p, "".join(k for c in o for k, v in short.items() if v == c), s): (v[0], v[1], v[6]) for (p, o, s), v in want.items()}
    for n, after in ((4, {}), (4, {2: [0], 3: [2]}), (3, {0: [1, 2]})):
        reach, leave = interactions.path_counts(n, after)
        allowed = [o for o in itertools.permutations(range(n)) if all(o.index(b) < o.index(f) for f, bs in after.items() for b in bs)]
        seen = defaultdict(set)
        for o in allowed:
            for k in range(n + 1):
                seen[sum(1 << f for f in o[:k])].add((o[:k], o[k:]))
        for s, pairs in seen.items():
            assert reach[s] == len({a for a, _ in pairs}) and leave[s] == len({b for _, b in pairs})
    with pytest.raises(ValueError):
        interactions.audit(df, ["short", "odd"], after={"short": ["odd"], "odd": ["short"]})
    with pytest.raises(ValueError):
        interactions.audit(df, [f"f{i}" for i in range(7)])


def test_audit_of_an_empty_table(spark):
    rows = interactions.failures(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert interactions.audit(rows).count() == 0


# --- 12: centroid tree ---------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "dims", "reach"), [(1, 3, 5), (4, 2, 3), (5, 2, 3), (40, 64, 120), (64, 3, 4), (97, 2, 1000), (30, 4, 1 << 27)])
def test_tree_finds_the_nearest(k, dims, reach):
    g = np.random.default_rng(k)
    c = g.integers(-reach, reach + 1, (k, dims))
    c[k // 2] = c[0]  # equal centroids: the smaller number wins
    x = np.concatenate([g.integers(-reach, reach + 1, (500, dims)), c, (c + np.roll(c, 1, 0)) // 2])
    who, d, looked = vantage.nearest(x, c, vantage.build(c))
    all_ = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x], dtype=object)
    assert d.tolist() == all_.min(axis=1).tolist() and who.tolist() == [row.tolist().index(m) for row, m in zip(all_, all_.min(axis=1), strict=True)]
    if (k, dims) == (97, 2):
        assert looked < 0.4 * all_.size  # most of the tree is never opened


def plain_clusters(rows, k, rounds, dims, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if j in own else m for j, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, j, d in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (40, 2), (500, 1), (3, 0)])
def test_clusters_against_plain_rounds(spark, k, rounds):
    g = np.random.default_rng(3)
    rows = [(i, (g.normal(size=6) + i % 4).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])]  # equal vectors, repeated rows, one id twice, no id
    odd = [(300, None), (301, []), (302, [0.0] * 5), (303, [0.0] * 7), (304, [0.0] * 5 + [None]), (305, [float("nan")] * 6), (306, [float("inf"), *[0.0] * 5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, label string, cluster int").repartition(3)
    got = sorted((tuple(r) for r in vantage.cluster(df, k, rounds, 6).collect()), key=repr)
    assert got == plain_clusters(rows, k, rounds, 6, "2:")


def test_clusters_of_no_vectors_and_of_wide_ones(spark):
    kind = "vec_id long, embedding array<float>"
    out = vantage.cluster(spark.createDataFrame([(1, [1.0])], kind))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(PySparkException, match="would not fit"):
        vantage.cluster(spark.createDataFrame([(1, [1e30, 0.0])], kind), dims=2).collect()


# --- 13: sum of squares --------------------------------------------------------------------------


def plain_squares(sizes, length):
    """Sequences as lists of sizes: every open one tried, the sum of squared counts taken over all gaps."""
    rows = []
    for s in sorted(sizes, reverse=True):
        gaps = [length - sum(r) for r in rows]

        def cost(i, gaps=gaps, s=s):
            after = [g - s * (j == i) for j, g in enumerate(gaps)]
            return sum(after.count(g) ** 2 for g in set(after) - {0}), gaps[i]

        room = [i for i, g in enumerate(gaps) if g >= s]
        if room:
            rows[min(room, key=cost)].append(s)
        else:
            rows.append([s])
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("seed", range(6))
def test_squares_against_the_definition(seed):
    g = random.Random(seed)
    length = g.choice([10, 31, 64])
    sizes = [g.randint(1, length) if g.random() < 0.5 else g.choice([1, 3, length // 2]) for _ in range(90)]
    row, at = squares.pack(np.array(sizes), length)
    held = defaultdict(list)
    for r, a, s in sorted(zip(row.tolist(), at.tolist(), sizes, strict=True)):
        assert a == sum(held[r])
        held[r].append(s)
    assert all(sum(v) <= length for v in held.values())
    assert sorted(map(sum, held.values())) == sorted(map(sum, plain_squares(sizes, length)))


def test_squares_need_few_sequences():
    g = np.random.default_rng(1)
    sizes = np.minimum(2047, g.lognormal(6.3, 0.9, 16_384).astype(np.int64) + 1)
    assert squares.pack(sizes, 2048)[0].max() + 1 <= 1.001 * math.ceil(sizes.sum() / 2048)


def test_encoder_against_the_library():
    with open(VOCABULARY, encoding="utf-8") as f:
        text = f.read()
    exact = tokenizers.Tokenizer.from_str(text)
    exact.encode_special_tokens = True
    assert squares.ranks_of(text)
    encode = squares.encoder("test", text, squares.ranks_of(text))
    marks = [f"a{c}b {c} {c}{c}1{c} \n{c}'s  {c}\t" for c in map(chr, range(0x250))]
    texts = [*marks, "".join(marks), "<|endoftext|> it's 12ab'LL  x\n\n y ", "日本語 und ქართ é́ 🎉🎉", "", *prose(20)]
    for t in texts:
        assert encode(t) == exact.encode(t, add_special_tokens=False).ids


def test_packing_gives_every_id_back(spark):
    with open(VOCABULARY, encoding="utf-8") as f:
        exact = tokenizers.Tokenizer.from_str(f.read())
    texts = [*prose(60, 4), None, "", " ", "é 日", " ".join(f"w{i}" for i in range(30_000)), *["one copy of a text " * 8] * 30]
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    length = 128
    for n in (length, length + 1, 2 * length):  # exactly one piece, one id more, exactly two
        text = " a" * (n - 1)
        ids[len(texts)] = [*exact.encode(text, add_special_tokens=False).ids, 0]
        texts.append(text)
        assert len(ids[len(texts) - 1]) == n
    rows = [(i, t, "en", "s", 0, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (None, *rows[6][1:])], DOC)
    packed = squares.pack_squares(docs, VOCABULARY, length, with_ids=True, pool_rows=100)
    got = packed.collect()
    own = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= length and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        own[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    assert set(own) == {*ids, None}
    for i, pieces in own.items():
        pieces.sort(key=lambda x: x[:2])
        times = 2 if i == 5 else 1
        pieces = pieces[::times]
        want = ids[6 if i is None else i]
        assert [x for p in pieces for x in p[2]] == want and [p[0] for p in pieces] == list(range(len(pieces)))
        assert [p[1] for p in pieces] == list(itertools.accumulate([len(p[2]) for p in pieces], initial=0))[:-1]
        assert all(len(p[2]) == length for p in pieces[1:])
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    rows = {r["sequence_id"]: r for r in squares.sequences(packed).collect()}
    assert set(rows) == set(held)
    for s, parts in held.items():
        parts.sort()
        ends = list(itertools.accumulate([n for _, n, _ in parts], initial=0))
        assert [a for a, _, _ in parts] == ends[:-1] and ends[-1] <= length
        assert rows[s]["cu_seqlens"] == ends and rows[s]["input_ids"] == [x for _, _, t in parts for x in t]
    plain = squares.pack_squares(docs, VOCABULARY, length, pool_rows=100)
    assert "ids" not in plain.columns and plain.count() == len(got)
    pools = packed.select(F.shiftright("sequence_id", 32)).distinct().count()
    assert pools > 1 and len(held) <= math.ceil(sum(r["length"] for r in got) / length) + pools


def test_packing_an_empty_table(spark):
    assert squares.pack_squares(spark.createDataFrame([], DOC), VOCABULARY).count() == 0
