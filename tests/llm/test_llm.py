"""The training-data operators against brute force, exact round trips and held-out accuracy, with edge rows in each table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, common, flac, hmm, jaccard, langid, mixing, packing, shards, templates, textvec, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, entry string, node int, size long"


def table(spark, texts, lang="en", source="s"):
    """documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, lang if isinstance(lang, str) else lang[i], source if isinstance(source, str) else source[i], 0, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(n, seed=0, words=400):
    g = random.Random(seed)
    return [" ".join(g.choice("abcdefgh") * g.randint(1, 3) + str(g.randint(0, words)) for _ in range(g.randint(5, 120))) for _ in range(n)]


# --- words -------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["Ab  cd\n", None, "", " ", "ab cd\x0bEF", "éÀ\x1cz\xa0y"]
    w = textvec.Words(pa.array(texts))
    got = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    want = [t.encode().lower().split() if t else [] for t in texts]
    assert got == [x for t in want for x in t] and list(np.diff(w.first)) == [len(t) for t in want]
    h = dict(zip(got, w.hashes(), strict=True))
    assert len(set(h.values())) == len(set(got)) and w.hashes()[0] == w.hashes()[2]
    assert textvec.Words(pa.array([], pa.string())).hashes().size == 0


# --- 4: n-gram Jaccard join ----------------------------------------------------------------------


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def test_pages_of_one_template_are_no_candidates(spark):
    """Pages that share five sixths of their words, in one passage or two, and none of whose pairs links; among them some copies."""
    head, tail = " ".join(f"h{i}" for i in range(215)), " ".join(f"t{i}" for i in range(215))
    pages = [f"{head} {' '.join(f'own{i}x{j}' for j in range(70))} {tail}" for i in range(400)]
    texts = [*pages, *[p.replace("x5 ", "y5 ") for p in pages[:20]]]
    sets = jaccard.shared_tokens(table(spark, texts), 4, 85, 4, np.zeros(0, np.uint64), {}, "doc_id", "text")
    entries = jaccard.index_entries(sets, 85)
    lists = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.max("wide").alias("any"), F.max("gives").alias("given")).where("n > 1 and any = 1 and given = 1")
    assert (lists.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) < 0.01 * len(texts) ** 2 / 2
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert got == {i: i if i < 400 else i - 400 for i in range(420)}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (4, 50), (2, 40)])
def test_jaccard_join_is_exact(spark, words, percent):
    g = random.Random(3)
    base = prose(30, 1)
    texts = list(base) + [None, "", "  ", "one two", "ONE two", "one two three four", "one two three"]
    for b in base[:12]:
        for _ in range(12):
            w = b.split()
            for _ in range(g.randint(0, 3)):
                w[g.randrange(len(w))] = f"new{g.randint(0, 5)}"
            texts.append(" ".join(w) if g.random() < 0.8 else " ".join(w).upper())
    passage = " ".join(f"p{i}" for i in range(40))  # one passage in many texts, above the frequent class
    texts += [passage + f" tail{i % 6} {i % 3}" for i in range(60)] + [passage] * 20
    got = jaccard.jaccard_components(table(spark, texts), words, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, words, percent)


def test_jaccard_join_of_blocks_and_wide_prefixes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "MOST_COMBINED", 3)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(40):
        w = list(base)
        w[i % 9 * 10] = f"x{i}"
        texts.append(" ".join(w + [f"y{i}"] * (i % 5)))
    got = jaccard.jaccard_components(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 4, 85)


@pytest.mark.parametrize(("short", "percent"), [(2, 85), (32, 60)])
def test_jaccard_join_of_hot_tokens_copies_and_open_lists(spark, monkeypatch, short, percent):
    """Tokens and sets above tiny limits, texts in chains whose ends don't link, and entries of texts that no link connects."""
    monkeypatch.setattr(jaccard, "HOT_SETS", 6)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "MOST_CLUSTERED", 8)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    g = random.Random(17)
    pool = [" ".join(f"q{k}x{i}" for i in range(12)) for k in range(9)]
    texts = [" ".join(g.sample(pool, 4)) for _ in range(120)]
    for s in range(5):  # each text is a word or two from the one before
        w = [f"c{s}w{i}" for i in range(60)]
        for i in range(12):
            w[5 * i : 5 * i + 2] = [f"n{s}{i}a", f"n{s}{i}b"]
            texts.append(" ".join(w))
    texts += ["one very common text of a few words"] * 1100
    got = jaccard.jaccard_components(table(spark, texts), 4, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(list(texts[:181]), 4, percent) | {i: (5, 180) for i in range(180, len(texts))}


def test_jaccard_join_at_the_edge_of_the_threshold(spark, monkeypatch):
    """A text and its last 85 of 100 words, all frequent: of what they share, the first word alone leaves enough words for a link."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    texts = [" ".join(f"t{i}" for i in range(100)), " ".join(f"t{i}" for i in range(15, 100))]
    texts += [" ".join([f"t{i}" for i in range(k, k + 10)] + [f"own{k}x{n}x{j}" for j in range(20)]) for k in range(0, 100, 10) for n in range(4)]
    got = jaccard.jaccard_components(table(spark, texts), 1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 1, 85)
    assert {r["doc_id"]: r["component_id"] for r in got}[1] == 0


def test_jaccard_join_of_entries_of_two_texts(spark, monkeypatch):
    """In large clusters, an entry of two texts may be the only one where they meet, while each has met another text first."""
    monkeypatch.setattr(jaccard, "MOST_CLUSTERED", 1)
    texts = []
    for i in range(40):
        q, s = [f"q{i}x{j}" for j in range(40)], [f"s{i}x{j}" for j in range(37)]
        texts += [" ".join([*q[3:], *[f"p{i}x{j}" for j in range(3)]]), " ".join(q), " ".join(q[:3] + s)]
        texts += [" ".join(q[3:] + s + [f"j{i}x{n}x{j}" for j in range(60)]) for n in range(3)]
    got = jaccard.jaccard_components(table(spark, texts), 1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 1, 85)


def test_jaccard_join_of_small_sets_at_low_thresholds(spark):
    """Sets that link by a single shingle which many sets have."""
    texts = [f"a b c {i}" for i in range(20)] + ["a b c"]
    got = jaccard.jaccard_components(table(spark, texts), 3, 50).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 50) and {r["component_id"] for r in got} == {0}


def test_jaccard_join_of_repeated_null_and_text_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), ("x", "a b c d"), ("x", "a b c d"), ("y", None), (None, "")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"] or "") for r in got) == [("", 0, ""), ("", 1, "x"), ("", 1, "x"), ("x", 1, "x"), ("x", 1, "x"), ("y", 0, "y")]


def test_jaccard_join_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    got = jaccard.jaccard_components(table(spark, [long, long + " end", long[: len(long) // 2]])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2}


def test_jaccard_join_of_nothing(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    assert {r["component_id"] for r in jaccard.jaccard_components(table(spark, [None, ""])).collect()} == {0, 1}


def test_components(spark):
    g = random.Random(5)
    pairs = [(g.randrange(200), g.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    up = {}
    for a, b in pairs:
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


# --- 5: language ID ------------------------------------------------------------------------------

WORDS = {"en": "the and with that this from have would there which about".split(), "de": "der und mit dass dies von haben würde dort welche über".split(), "fr": "le et avec que cette depuis avoir serait là quelle à".split()}


def speech(lang, n, seed):
    g = random.Random(seed)
    return [" ".join(g.choices(WORDS[lang], k=g.randint(3, 40))) for _ in range(n)]


def test_language_id(spark):
    langs = [k for k in WORDS for _ in range(60)]
    texts = [t for i, k in enumerate(WORDS) for t in speech(k, 60, i)]
    model = langid.fit(table(spark, texts, langs))
    assert model.langs == ["de", "en", "fr"]
    held = [t for i, k in enumerate(WORDS) for t in speech(k, 20, 100 + i)] + [None, "", "12 34 !", "zzz"]
    got = {r["doc_id"]: r for r in langid.predict(table(spark, held), model).collect()}
    assert [got[i]["lang_pred"] for i in range(60)] == [k for k in WORDS for _ in range(20)]
    assert [got[i]["lang_pred"] for i in range(60, 63)] == ["und"] * 3 and got[60]["score"] == 0 and got[63]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.fit(table(spark, []))
    assert [r["lang_pred"] for r in langid.predict(table(spark, ["abc"]), none).collect()] == ["und"]
    whole = langid.predict(table(spark, held), model, carry=True).select("row.*")
    assert whole.columns == table(spark, held).columns and whole.count() == len(held)


def test_bloom_popcounts_against_sets(spark):
    """Masks hold every n-gram that was put in, and the correction takes off the expected false hits."""
    model = langid.fit(table(spark, speech("en", 50, 1) + speech("de", 50, 2), ["en"] * 50 + ["de"] * 50))
    ids, row = langid.grams(pa.array(["the and with", None, "a"]))
    assert list(np.bincount(row, minlength=3)) == [len("the and with") + 1, 0, 2]  # two spaces at both ends
    a, b, c = langid.slots(ids)
    hit = model.masks[0][a] & model.masks[0][b] & model.masks[0][c]
    assert ((hit[row == 0] >> np.uint64(model.langs.index("en"))) & np.uint64(1)).all()
    assert (model.chance < 0.01).all()


# --- 10: sharding --------------------------------------------------------------------------------


def test_kd_shards(spark):
    g = random.Random(2)
    texts = [None, ""] + ["x" * g.randint(1, 400) + " y" * g.randint(0, 30) + "\n" * g.randint(0, 5) for _ in range(800)] + ["same text of many"] * 700
    got = shards.kd_shards(table(spark, texts), n_shards=16).toPandas().sort_values("doc_id")
    size = [len((t or "").encode()) + 1 for t in texts]
    assert got["size"].tolist() == size and got["text_crc32"].tolist() == [zlib.crc32((t or "").encode()) for t in texts]
    by = got.groupby("shard")
    assert sorted(by.groups) == list(range(16))
    assert by["size"].sum().max() - by["size"].sum().min() <= 0.12 * sum(size) / 16
    assert all(sorted(x) == list(range(len(x))) for _, x in by["slot"])
    small = got.iloc[: len(texts) - 700].assign(t=[str(t) for t in texts[:-700]])
    assert small.groupby("t")["shard"].nunique().max() == 1 and not small["divided"].any()  # equal texts stay together unless too heavy
    heavy = got.iloc[len(texts) - 700 :]
    assert heavy["divided"].any() == (heavy["shard"].nunique() > 1)
    whole = shards.kd_shards(table(spark, texts), n_shards=16, heavy=100.0).toPandas()
    assert not whole["divided"].any() and whole[whole["doc_id"] >= len(texts) - 700]["shard"].nunique() == 1
    for got in (small, heavy, whole):  # marked rows are of groups that lie in several shards, and a row alone is in no group
        marked = got[got["divided"]]
        assert all(got[got["text_crc32"] == c]["shard"].nunique() > 1 for c in set(marked["text_crc32"]))
    few = shards.kd_shards(table(spark, [*[f"a text of its own {i} " * (i % 5 + 1) for i in range(64)], *["the same text here"] * 64]), n_shards=16).toPandas()
    assert few["divided"].sum() in (0, 64) and not few[few["doc_id"] < 64]["divided"].any()


def test_kd_shards_edges(spark):
    assert shards.kd_shards(table(spark, []), n_shards=4).count() == 0
    twice = table(spark, ["a", "b"]).unionAll(table(spark, ["a", "b"]))
    got = shards.kd_shards(twice, n_shards=2).collect()
    assert len(got) == 4 and sorted((r["shard"], r["slot"]) for r in got) in ([(0, 0), (0, 1), (1, 0), (1, 1)], [(0, i) for i in range(4)], [(1, i) for i in range(4)])
    n = shards.kd_shards(table(spark, prose(200)), target_bytes=5000).select("shard").distinct().count()
    assert n == math.ceil(sum(len(t) + 1 for t in prose(200)) / 5000)


# --- 1: mixing -----------------------------------------------------------------------------------


def test_exponent_meets_its_target():
    tokens = {"a": 1000, "b": 100, "c": 10}
    a = mixing.solve_exponent(tokens, target_entropy=0.7)
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - 0.7) < 1e-6
    a = mixing.solve_exponent(tokens, max_epochs=4.0)
    w = mixing.weights(tokens, a)
    total = mixing.least_budget(tokens, w)
    assert abs(max(w[s] * total / t for s, t in tokens.items()) - 4) < 1e-6
    assert mixing.solve_exponent(tokens, target_entropy=9.0) == 0 and mixing.solve_exponent({"a": 5}, max_epochs=2.0) == 0
    with pytest.raises(ValueError):
        mixing.solve_exponent(tokens)


def test_mixture_deals_its_budgets(spark):
    texts, source = [None, ""] + ["w " * 5] * 300 + ["w " * 5] * 40, [None, "b"] + ["a"] * 300 + ["b"] * 40
    got = mixing.mix_sources(table(spark, texts, source=source), max_epochs=3.0, block_tokens=60).toPandas()
    assert set(got["doc_id"]) == set(range(len(texts)))  # every row at least once
    tokens = {"a": 1500, "b": 201, None: 1}
    names = {"a": 1500, "b": 201, "\0null": 1}
    a = mixing.solve_exponent(names, max_epochs=3.0)
    w = mixing.weights(names, a)
    total = mixing.least_budget(names, w)
    dealt = got.assign(source=got["source"].fillna("\0null")).groupby("source")["n_tokens"].sum()
    for s in names:
        assert -1e-6 <= dealt[s] - w[s] * total < 6  # a part epoch ends with the row that reaches the budget
    assert tokens and not got.duplicated(["doc_id", "epoch"]).any()
    assert got["epoch"].max() == 2 and len(got.groupby(["source", "block"], dropna=False)) > 20
    first = got[(got["source"] == "b") & (got["epoch"] == got[got["source"] == "b"]["epoch"].max())]
    whole = got[(got["source"] == "b") & (got["epoch"] == 0)]
    assert len(first) <= len(whole)
    assert mixing.mix_sources(table(spark, []), max_epochs=2.0).count() == 0


# --- 3: decontamination --------------------------------------------------------------------------

ITEM = "A train leaves the old station in Boston at 40 km per hour and after 3 hours Alice asks how far the train in Boston has gone along the long track."


def brute_template(text):
    import re

    out, opens = [], True
    for line in (text or "").split("\n"):
        opens = True
        for word in line.split():
            last, bare = word[-1], re.sub(r"^[^0-9A-Za-z%\x80-\U0010ffff]+|[^0-9A-Za-z%\x80-\U0010ffff]+$", "", word) or word
            if bare[0].isdigit() or bare.lower() in templates.NUMBERS:
                out.append("<n>")
            elif bare.lower() in templates.UNITS:
                out.append("<u>")
            elif bare[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not opens and len(bare) > 1:
                out.append("<p>")
            else:
                out.append(bare.lower())
            opens = last in ".!?:"
    return out


def test_decontamination(spark):
    moved = ITEM.replace("Boston", "Paris").replace("40", "55").replace("Alice", "Bob")
    broken = ITEM.replace("in Boston at", "in Paris at")  # two values for one slot
    filler = " ".join(prose(3, 9))
    texts = [ITEM, f"{filler} {moved} {filler}", f"{filler}\n{broken} end", filler, None, "", ITEM.lower(), " ".join(ITEM.split()[:12]), f"{ITEM} {ITEM}"]
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "One two 3 4 5 6 7 8 9 10 km")], "item_id long, text string")
    got = {r["doc_id"]: r for r in templates.decontaminate(table(spark, texts), bench).collect()}
    assert sorted(got) == [0, 1, 2, 6, 8]  # 2: a copy with one other word where names are words
    cased = {r["doc_id"] for r in templates.decontaminate(table(spark, texts), bench, any_case=False).collect()}
    assert cased == {0, 1, 8}  # one slot can't have two values
    assert got[0]["n_changed"] == 0 and got[1]["n_changed"] == 3 and got[1]["coverage"] == 1.0
    assert templates.decontaminate(table(spark, []), bench).count() == 0
    shuffled = templates.decontaminate(table(spark, texts), bench, max_broadcast=0).collect()
    assert sorted(r["doc_id"] for r in shuffled) == [0, 1, 2, 6, 8]
    twice = templates.decontaminate(table(spark, texts).unionAll(table(spark, texts)), bench.unionAll(bench)).collect()
    assert {r["doc_id"]: tuple(r) for r in twice} == {i: tuple(r) for i, r in got.items()} and len(twice) == len(got)


def test_part_of_an_item_stays_a_part_when_it_is_repeated(spark):
    """Repeated rows and items are no more evidence than one; an id's other text neither."""
    w = ITEM.split()
    part, rest = " ".join(w[:14]), " ".join(w[14:])
    bench = spark.createDataFrame([(1, ITEM)] * 3, "item_id long, text string")
    rows = spark.createDataFrame([(5, part, "en", "s", 1, "x", 1, 2)] * 4 + [(5, rest, "en", "s", 1, "x", 1, 2)] * 2 + [(6, ITEM, "en", "s", 1, "x", 1, 2)] * 2 + [(None, ITEM, "en", "s", 1, "x", 1, 2)], DOC)
    got = {r["doc_id"]: r for r in templates.decontaminate(rows, bench).collect()}
    assert set(got) == {6, None} and got[6]["coverage"] == 1.0 and got[6]["n_windows"] == got[None]["n_windows"]
    two = templates.decontaminate(rows, spark.createDataFrame([(1, part), (1, rest)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in two} == {5, 6, None}  # texts of one item_id are judged each for itself


def brute_hits(texts, items, k=8, literals=4, least=0.5):
    """Rows that hold an item, by one reading and one shift at a time, in plain Python."""

    def tokens(text, names):
        out = []
        for t in brute_template(text) if names else ["lit"] * len((text or "").split()):
            out.append(t)
        words = [w.strip(".,!?") for w in (text or "").split()]
        return [(t if t.startswith("<") else w.lower(), w.lower()) for t, w in zip(out, words, strict=True)]

    hits = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = tokens(item, True), tokens(text, True)
            wins = [j for j in range(len(a) - k + 1) if sum(not t.startswith("<") for t, _ in a[j : j + k]) >= literals]
            for shift in range(-len(a), len(b)):
                live = [j for j in wins if 0 <= j + shift <= len(b) - k and [t for t, _ in a[j : j + k]] == [t for t, _ in b[j + shift : j + shift + k]]]
                pairs = {(a[p], b[p + shift][1]) for j in live for p in range(j, j + k) if a[p][0].startswith("<")}
                if wins and len(live) >= least * len(wins) and len({x for x, _ in pairs}) == len(pairs):
                    hits.add((d, i))
    return hits


def test_decontamination_against_brute_force(spark):
    g = random.Random(23)
    word = lambda: "".join(g.choices("bcdfghklmnprst", k=2)) + "a" + "".join(g.choices("bcdfghklmnprst", k=2))

    def item():
        w = [word() for _ in range(g.randint(16, 30))]
        for j in range(2, len(w) - 2, 5):  # never two slots in a row, so a slot is one word
            w[j] = g.choice(["Boston", "Alice", "7", "12", "km"])
        return " ".join(w)

    items, texts = [item() for _ in range(12)], []
    other = {"Boston": "Paris", "Alice": "Bob", "7": "8", "12": "31", "km": "miles"}
    for t in items * 4:
        w, way = t.split(), g.randrange(5)
        if way == 1:
            w = [other.get(x, x) for x in w]
        elif way == 2:
            w = [other.get(x, x) if g.random() < 0.5 else x for x in w]  # often two values for one
        elif way == 3:
            w = w[: len(w) // 2 + g.randint(-3, 5)]
        elif way == 4:
            w[g.randrange(4)] = word()
        texts.append(" ".join([word() for _ in range(g.randint(0, 20))] + w + [word() for _ in range(g.randint(0, 20))]))
    texts += texts[:6] + [None, "", " ".join(items[:3])]
    bench = spark.createDataFrame(list(enumerate(items)) * 2, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in templates.decontaminate(table(spark, texts), bench, any_case=False).collect()}
    want = brute_hits(texts, items)
    assert want and got >= want
    assert len(got - want) <= 0.2 * len(want)  # what else is found changes its shift within the item, which the plain version does not try


def test_canonical_templates_against_brute_force():
    texts = [ITEM, None, "", "He paid $5.50, (about 3 kg) To Mary Jones.\nNew York is big. Twenty miles!", "a -- b"]
    _, t, kind, _ = templates.canonical(pa.array(texts))
    names = {0: None, 1: "<n>", 2: "<p>", 3: "<u>"}
    want = [x for s in texts for x in brute_template(s)]
    assert [names[int(k)] or "lit" for k in kind] == [x if x.startswith("<") else "lit" for x in want]
    same = defaultdict(set)
    for x, v in zip(want, t, strict=True):
        same[x].add(v)
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


# --- 8: chat -------------------------------------------------------------------------------------


def test_chat_round_trip_of_hostile_texts():
    g = random.Random(1)
    bits = ["### Assistant: ", " </turn>\n", "</turn>", "### ", "#", "\\", "~", "\n", "ok", "<", "\\l", "### user~: ", ": ", "", "/turn>", " "]
    for _ in range(3000):
        turns = [(g.choice(["user", "assistant", "system", "a:b~%\n#", ""]), "".join(g.choices(bits, k=g.randint(0, 6)))) for _ in range(g.randint(0, 5))]
        text, spans = chat.format_turns(turns)
        assert [x[:2] for x in chat.parse(text)] == turns and [x[2:] for x in chat.parse(text)] == spans
    with pytest.raises(ValueError):
        chat.parse("### user: a")


def test_chat_query_columns(spark):
    rows = [(1, 2, "assistant", "b </turn> ### x"), (1, 1, "user", None), (1, 3, "assistant", "é\n"), (None, 1, None, "n"), (2, 1, "user", "u"), (2, 1, "user", "u")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    want = hashlib.sha256("user\n\nassistant\nb </turn> ### x\nassistant\né\n\n".encode()).hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["n_turns"] == 3
    assert got[1]["loss_sha256"] == hashlib.sha256("b </turn> ### xé\n".encode()).hexdigest() and got[1]["loss_chars"] == 17
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 9: FLAC -------------------------------------------------------------------------------------


def test_flac_round_trip():
    g = np.random.default_rng(0)
    payloads = [g.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes(), bytes(576), b"\xff" * 576 * 200, (b"\0" * 287 + b"\xff" * 289) * 2, bytes([0, 255]) * 288, b"\0" * 575 + b"\xff", ("the cat sat " * 480).encode()]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads
    assert len(media[-1]) < len(payloads[-1]) and all(m[:4] == b"fLaC" for m in media)
    for at in (90, 300):
        bad = bytearray(media[0])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def _bits(data):
    return np.unpackbits(np.frombuffer(data, np.uint8))


def test_flac_against_a_plain_reader():
    """A slow reader of the format, a bit at a time, gives the same samples."""
    payload = ("Some text, with words and 1234 numbers. " * 40).encode()[:1152]
    (media,) = flac.encode([payload])
    info, offsets, at = flac.parse_head(media)
    out = []
    for off in offsets:
        bits, pos = _bits(media[at + off :]), 0

        def take(n):
            nonlocal pos
            v = int("".join(map(str, bits[pos : pos + n])) or "0", 2)
            pos += n
            return v

        def signed(n):
            v = take(n)
            return v - (1 << n) if v >> (n - 1) else v

        assert take(15) == 0x7FFC and take(1) == 0
        take(16), take(8), take(8)
        kind = take(8) >> 1
        if kind == 0:
            out += [signed(8)] * 576
            continue
        order = kind - 8 if kind < 32 else kind - 31
        x = [signed(8) for _ in range(order)]
        coef, shift = [], 0
        if kind >= 32:
            precision, shift = take(4) + 1, take(5)
            coef = [signed(precision) for _ in range(order)]
        assert take(6) == 0
        k = take(4)
        while len(x) < 576:
            q = 0
            while not take(1):
                q += 1
            u = q << k | take(k)
            r = u >> 1 ^ -(u & 1)
            x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
        out += x
    assert bytes(v + 128 for v in out) == payload and info["samples"] == 1152
    assert hashlib.md5(np.array(out, np.int8).tobytes()).digest() == info["md5"]
    pcm, sample, byte = flac.decode_any(media)
    assert b"".join(pcm) == payload and sample == [0, 576] and byte == (offsets + at).tolist()


class Writer:
    """Writes FLAC frames a bit at a time, with features that the module's own writer does not use."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        return np.packbits(self.bits).tobytes()

    def residual(self, res, order, parts, block, method, escape):
        self.put(method, 2), self.put(parts, 4)
        at = 0
        for i in range(1 << parts):
            n = (block >> parts) - (order if i == 0 else 0)
            own, at = res[at : at + n], at + n
            if i in escape:
                self.put((1 << (4 + method)) - 1, 4 + method), self.put(20, 5)
                for v in own:
                    self.put(v & (1 << 20) - 1, 20)
                continue
            self.put(3, 4 + method)
            for v in own:
                u = v << 1 if v >= 0 else (-v << 1) - 1
                self.put(1, (u >> 3) + 1), self.put(u & 7, 3)


def foreign_stream(x, bits, channels, block, parts, mode="independent", order=2, method=0, escape=(), lpc=None, wasted=0):
    """A FLAC stream of samples x (n x channels) with frames of `block` samples, the last one shorter, and no seek table."""
    frames = b""
    for k, a in enumerate(range(0, len(x), block)):
        part = x[a : a + block].astype(int)
        n, w = len(part), Writer()
        w.put(0x7FFC, 15), w.put(0, 1), w.put(7, 4), w.put(0, 4), w.put({"independent": channels - 1, "left": 8, "right": 9, "mid": 10}[mode], 4), w.put(0, 3), w.put(0, 1)
        for b in chr(k).encode():
            w.put(b, 8)
        w.put(n - 1, 16)
        head = np.frombuffer(w.bytes(), np.uint8)
        w.put(int(flac.crc(head, np.array([0]), np.array([len(head)]), 7, 8)[0]), 8)
        cols = [part[:, c] for c in range(channels)]
        if mode != "independent":
            l, r = cols
            cols = {"left": [l, l - r], "right": [l - r, r], "mid": [(l + r) >> 1, l - r]}[mode]
        for c, col in enumerate(cols):
            b = bits + (mode != "independent" and c == (0 if mode == "right" else 1)) - wasted
            col = [int(v) >> wasted for v in col]
            taps, down = (lpc, 5) if lpc else (flac._FIXED[order], 0)
            o = len(taps)
            w.put(0, 1), w.put(31 + o if lpc else 8 + o, 6)
            w.put(1 << (wasted - 1) if False else (1 if wasted else 0), 1)
            if wasted:
                w.put(1, wasted)
            for v in col[:o]:
                w.put(v & (1 << b) - 1, b)
            if lpc:
                w.put(11, 4), w.put(down, 5)
                for v in lpc:
                    w.put(v & 4095, 12)
            res = [col[i] - (sum(t * col[i - 1 - j] for j, t in enumerate(taps)) >> down) for i in range(o, n)]
            p = parts if n % (1 << parts) == 0 and n >> parts >= o else 0
            w.residual(res, o, p, n, method, escape)
        frame = w.bytes()
        raw = np.frombuffer(frame, np.uint8)
        frames += frame + int(flac.crc(raw, np.array([0]), np.array([len(raw)]), 0x8005, 16)[0]).to_bytes(2, "big")
    wide = (bits + 7) // 8
    md5 = hashlib.md5(b"".join(int(v).to_bytes(wide, "little", signed=True) for v in x.ravel())).digest()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(x)).to_bytes(8, "big") + md5
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info + frames


def test_flac_reads_foreign_streams():
    g = np.random.default_rng(4)
    wave = lambda n, c, top: (np.cumsum(g.integers(-9, 10, (n, c)), axis=0).clip(-top, top - 1)).astype(np.int64)
    cases = [
        (wave(700, 1, 128), dict(bits=8, channels=1, block=256, parts=3)), (wave(1000, 2, 30000), dict(bits=16, channels=2, block=512, parts=2, mode="mid", method=1, escape=(1,))),
        (wave(600, 2, 30000), dict(bits=16, channels=2, block=256, parts=1, mode="left", order=3)), (wave(600, 2, 30000), dict(bits=16, channels=2, block=256, parts=0, mode="right", order=4, escape=(0,))),
        (wave(300, 3, 1 << 20), dict(bits=24, channels=3, block=192, parts=2, order=0, method=1)), (wave(400, 1, 2000), dict(bits=12, channels=1, block=200, parts=3, lpc=[40, -9, 2])), (wave(400, 1, 500) * 8, dict(bits=16, channels=1, block=128, parts=1, order=1, wasted=3)),
    ]
    for x, kw in cases:
        media = foreign_stream(x, **kw)
        pcm, sample, _ = flac.decode_any(media)
        wide = (kw["bits"] + 7) // 8
        want = b"".join((int(v) + 128).to_bytes(1, "little") if kw["bits"] == 8 else int(v).to_bytes(wide, "little", signed=True) for v in x.ravel())
        assert b"".join(pcm) == want and sample == list(range(0, len(x), kw["block"]))
        with pytest.raises(ValueError):
            flac.decode([media])
        bad = bytearray(media)
        bad[len(bad) // 2] ^= 4
        with pytest.raises(ValueError):
            flac.decode_any(bytes(bad))


def test_flac_seeks():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 576 * 5, dtype=np.uint8))
    (media,) = flac.encode([payload])
    for a, n in ((0, 1), (575, 2), (1000, 1500), (2879, 50), (5000, 3), (7, 0), (0, 9999)):
        assert flac.read_samples(media, a, n) == payload[a : a + n]


def test_flac_null_broken_foreign_and_long_media(spark):
    (good,), wave = flac.encode([b"abc" * 192]), np.arange(-100, 100)[:, None]
    long = flac.encode([b"the cat " * 72 * 4000])[0]
    broken = bytearray(good)
    broken[-4] ^= 1
    rows = [(1, good), (2, None), (3, bytes(broken)), (4, b""), (5, b"fLaC"), (6, foreign_stream(wave, 8, 1, 64, 2)), (1, good), (7, good[:50]), (8, long), (None, good)]
    media = spark.createDataFrame([(i, 3, None if m is None else bytearray(m)) for i, m in rows], "doc_id long, n_bytes long, media binary")
    got = flac.digests(media).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == [1, 1, 2, 3, 4, 5, 6, 7, 8, None]
    by = {r["doc_id"]: r for r in got}
    assert by[1]["payload_sha256"] == by[None]["payload_sha256"] == hashlib.sha256(b"abc" * 192).hexdigest() and by[1]["error"] is None
    assert by[2]["error"] == "null" and by[2]["media_bytes"] is None and by[3]["error"].startswith("CRC-16") and by[4]["error"] and by[5]["error"] and by[7]["error"]
    assert all(by[i]["payload_bytes"] is None and by[i]["feature"] is None for i in (2, 3, 4, 5, 7))
    assert by[6]["payload_bytes"] == 200 and by[8]["payload_sha256"] == hashlib.sha256(b"the cat " * 72 * 4000).hexdigest()
    assert flac.pcm_blocks(media).where("doc_id = 3").select("block", "pcm", "error").collect()[0]["pcm"] is None


def test_flac_query_columns(spark):
    texts = ["", None, "é" * 400, "x" * 576, "x" * 576]
    media = flac.encode_texts(table(spark, texts))
    got = {r["doc_id"]: r for r in flac.digests(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert all(r["error"] is None for r in got.values())
    assert got[3]["media_sha256"] == got[4]["media_sha256"] and got[3]["feature"] == got[4]["feature"]
    blocks = flac.pcm_blocks(media).where("doc_id = 2").orderBy("block").collect()
    assert b"".join(b["pcm"] for b in blocks)[:800] == ("é" * 400).encode() and [b["sample_offset"] for b in blocks] == [0, 576]
    assert flac.encode_texts(table(spark, [])).count() == 0


# --- 6: packing ----------------------------------------------------------------------------------


def brute_best_fit(sizes, length):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = min((r for r in range(len(rows)) if room[r] >= sizes[i]), key=lambda r: room[r], default=None)
        if fit is None:
            rows.append([])
            room.append(length)
            fit = len(rows) - 1
        rows[fit].append(i)
        room[fit] -= sizes[i]
    return sorted(room)


def test_best_fit_decreasing():
    g = np.random.default_rng(1)
    for n in (0, 1, 50, 400):
        sizes = g.integers(1, 65, n)
        rows = packing.best_fit_decreasing(sizes, 64)
        assert sorted(i for r in rows for i in r) == list(range(n))
        assert sorted(64 - int(sizes[r].sum()) for r in map(np.array, rows)) == brute_best_fit(sizes.tolist(), 64)


def test_packing_is_lossless(spark, tmp_path):
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257}
    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(k).decode()} {v}" for k, v in ranks.items()))
    texts = [None, "", "the cat", "x " * 500, "é" * 60, "the", "the"]
    got = packing.pack_documents(table(spark, texts), str(path), length=64, end_id=300, pad_id=301).collect()
    pieces = defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r["input_ids"], "<u2")
        assert len(ids) == 64 and (ids[r["n_tokens"] :] == 301).all() and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        for i, k, a, b in zip(r["ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            pieces[i][k] = ids[a:b]
    enc = packing.tokenizer(*packing.load_ranks(str(path)))
    other = tmp_path / "other"  # as many ranks, other ids
    other.write_text("\n".join(f"{base64.b64encode(k).decode()} {v}" for k, v in (ranks | {b"th": 257, b"the": 256}).items()))
    assert packing.tokenizer(*packing.load_ranks(str(other))).encode_ordinary("the") != enc.encode_ordinary("the")
    for i, t in enumerate(texts):
        whole = np.concatenate([pieces[i][k] for k in range(len(pieces[i]))])
        assert whole.tolist() == [*enc.encode_ordinary(t or ""), 300]
    assert packing.pack_documents(table(spark, []), str(path)).count() == 0


# --- 7: hidden Markov model ------------------------------------------------------------------------


def tiny_model(k=3, codes=6, seed=0):
    g = np.random.default_rng(seed)
    unit = lambda v, a: v / v.sum(axis=a, keepdims=True)
    return hmm.Model(np.zeros(0, np.uint64), np.ones(codes), unit(g.random(k), 0), unit(g.random(k), 0), unit(g.random((k, k)), 1), unit(g.random((codes, k)), 0))


def test_forward_and_counts_against_enumeration():
    import itertools

    m = tiny_model()
    seqs = [[1, 2, 5, 0], [0], [3, 3, 0]]
    off, code = np.cumsum([0, *map(len, seqs)]), np.concatenate(seqs)
    first, moved, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)), []
    for s in seqs:
        paths = {}
        for z in itertools.product(range(3), repeat=len(s)):
            p = m.first[z[0]] * m.emit[s[0], z[0]]
            for a, b, c in zip(z, z[1:], s[1:], strict=False):
                p *= m.move[a, b] * m.emit[c, b]
            paths[z] = p
        total = sum(paths.values())
        logs.append(math.log(total))
        for z, p in paths.items():
            first[z[0]] += p / total
            for a, b in zip(z, z[1:], strict=False):
                moved[a, b] += p / total
            for c, b in zip(s, z, strict=True):
                emit[c, b] += p / total
    assert np.allclose(hmm.forward(m, off, code), logs)
    a, b, c, d, like = hmm.expected_counts(m, off, code)
    assert np.allclose(a, first, atol=1e-5) and np.allclose(b, 0) and np.allclose(c, moved, atol=1e-5) and np.allclose(d, emit, atol=1e-5) and abs(like - sum(logs)) < 1e-4


@pytest.mark.parametrize("warm", [None, 1e-6, 4e-3])
def test_lm_scores(spark, monkeypatch, warm):
    if warm == 4e-3:  # words above it are warm, none frequent
        monkeypatch.setattr(hmm, "HOT", 0.5)
    texts = [t if i % 2 else t.replace("a", "m").replace("b", "n").replace("c", "o").replace("1", "z") for i, t in enumerate(prose(400, 4, 20))] + [None, "", "never seen words", "a1 " * 700]
    docs = table(spark, texts).withColumn("trains", common.fold() != 1)
    docs = docs.unionAll(docs.where("doc_id = 3"))  # a repeated row
    got = defaultdict(list)
    for r in hmm.score(docs, "trains", states=3, rounds=3, warm_share=warm).collect():
        got[r["doc_id"]].append(r)
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    times = Counter({i: 1 for i in tokens}) + Counter([3])
    c = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in t:
                c[w] += times[i]
    n, v = sum(c.values()), len(c)
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    for i, t in tokens.items():
        r = got[i][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 * max(1, abs(r["base_score"]))
        assert r["score"] < 0 and math.isfinite(r["score"])
    held = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(got[i][0]["score"] for i in held) > sum(got[i][0]["base_score"] for i in held)
    assert hmm.score(table(spark, []).withColumn("trains", F.lit(True)), "trains").count() == 0
    untrained = hmm.score(table(spark, ["a b", None]).withColumn("trains", F.lit(False)), "trains").collect()
    assert [r["n_known"] for r in untrained] == [0, 0] and all(math.isfinite(r["score"]) for r in untrained)


# --- 2: toxicity -----------------------------------------------------------------------------------


def test_network_gradient():
    x = toxicity.Inputs(pa.array(["a bad idiot word here", "", None, "nice day " * 30, "x"]))
    p = {k: v.astype(np.float64) for k, v in toxicity.start(1).items()}
    y, w = np.array([1, 0, 0, 0, 1.0]), np.ones(5)
    _, g = toxicity.gradient(p, x, y, w)
    for k in g:
        i, e = np.unravel_index(np.abs(g[k]).argmax(), p[k].shape), 1e-3
        old = p[k][i]
        p[k][i] = old + e
        up = toxicity.gradient(p, x, y, w)[0]
        p[k][i] = old - e
        down = toxicity.gradient(p, x, y, w)[0]
        p[k][i] = old
        assert abs((up - down) / 2 / e - g[k][i]) < 1e-4


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 48, 49, 200):
        x = toxicity.Inputs(pa.array([" ".join(f"w{i}" for i in range(n))]))
        seen = set(x.windows[x.mask].tolist())
        assert len(seen) == n and 0 not in seen
        assert len(x.windows) == 1 + max(0, -(-(n - 32) // 16))


def test_toxicity_learns(spark):
    g = random.Random(7)
    texts = prose(260, 8)
    labels = []
    for i, t in enumerate(texts):
        w = t.split()
        if i % 3 == 0:
            for _ in range(2):
                w.insert(g.randrange(len(w) + 1), g.choice(["idiot", "moron", "scum"]))
        texts[i] = " ".join(w)
        labels.append((i, int(i % 3 == 0)))
    docs = table(spark, texts + [None, ""])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 200"), steps=150)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = range(200, 260)
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.9
    assert got[260] == got[261] < 0.5 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(2), none).count() == 2
    assert toxicity.score(table(spark, []), model).count() == 0
