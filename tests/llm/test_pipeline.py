"""The pipeline's stages against plain versions on a small corpus, and op8 against its SQL twin."""

import os
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from folioscope.llm import mixing, queries
from tests.llm.test_llm import WORDS, brute_components, speech

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    g = random.Random(11)
    # words with numbers of their own, so that clean texts share no window
    clean = [(k, " ".join(w + "aeiou"[g.randrange(5)] * g.randrange(4) if g.random() < 0.6 else w for w in t.split() * 2)) for i, k in enumerate(WORDS) for t in speech(k, 40, 50 + i)]
    item = "the quick river ran past an old mill where seven grey geese slept under a broken willow tree until late in the autumn evening"
    rows = list(clean)
    rows += [("en", None), ("en", ""), ("en", "12 34 -- !"), ("en", "1")]  # no letter
    base = clean[0][1] + " " + clean[1][1] + " " + clean[2][1]
    rows += [("en", base), ("en", base), ("en", base + " tail"), ("en", base.upper())]  # near copies
    rows += [("en", f"{clean[5][1]} {item} {clean[7][1]}")]  # a leak
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, k, "big" if i % 3 else f"small{i % 2}", len(t or "")) for i, (k, t) in enumerate(rows)]
    spark.createDataFrame(docs, KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, len(clean)


def test_stages_keep_and_drop_what_they_should(spark, corpus):
    d, docs, n_clean = corpus
    text = {r[0]: r[1] for r in docs}
    df, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, d)
        assert df.columns == [c.split()[0] for c in KIND.split(", ")]
        rows = df.collect()
        assert all(r["text"] == text[r["doc_id"]] for r in rows)
        kept[name] = sorted(r["doc_id"] for r in rows)
        df = spark.createDataFrame(rows, KIND)
    every = set(text)
    lettered = {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    assert set(kept["language_id"]) == lettered
    order = sorted(lettered)
    groups = brute_components([text[i] for i in order], 5, 80)
    assert kept["near_duplicates"] == [i for k, i in enumerate(order) if groups[k][1] == k]
    leak = max(every)
    assert kept["decontamination"] == [i for i in kept["near_duplicates"] if i != leak] and set(range(n_clean)) - set(kept["near_duplicates"]) == {order[k] for k in groups if groups[k][1] != k} & set(range(n_clean))
    # the mixture: each row once, and those of small sources again as the plan has it
    times = Counter(kept["mixture"])
    assert set(times) == set(kept["decontamination"]) and max(times.values()) <= 2
    source = {r[0]: r[3] for r in docs}
    tokens = Counter()
    for i in times:
        tokens[source[i]] += len(text[i].split())
    w = mixing.weights(tokens, mixing.solve_exponent(tokens, max_epochs=2.0))
    total = mixing.least_budget(tokens, w)
    for s in tokens:
        dealt = sum(len(text[i].split()) * k for i, k in times.items() if source[i] == s)
        assert -1e-6 <= dealt - w[s] * total <= 120
    last = corpus_pipeline.STAGES[4][1](spark, df, d).toPandas()
    assert Counter(last["doc_id"]) == times and set(last["shard"]) <= set(range(16))
    assert all(sorted(x) == list(range(len(x))) for _, x in last.groupby("shard")["slot"])


def test_run_and_empty_tables(spark, corpus, tmp_path):
    d, docs, _ = corpus
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "divided"] and got.count() > 0.8 * len(docs)
    e = str(tmp_path)
    spark.createDataFrame([], KIND).write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{e}/benchmark.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_op8_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLE["op8_chat_format"]).df()
    got = queries.QUERIES["op8_chat_format"](spark, sf).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].astype(str).values.tolist())) == sorted(map(tuple, want[cols].astype(str).values.tolist()))


def frame(spark, rows):
    """documents with columns whose names the stages use themselves."""
    kind = KIND + ", _id string, _hash long, _drop boolean, _times int, n long, times int, root long, key long, text_hash long, s string, block int, row string, lang_pred string"
    return spark.createDataFrame([(*r, "i", 1, True, 5, 6, 7, 8, 9, 10, "s", 11, "r", "p") for r in rows], kind)


def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, corpus):
    d, docs, _ = corpus
    prose = [r[1] for r in docs[:60]]
    copy = " ".join(prose[:4])
    leak = f"{prose[9]} {spark.read.parquet(f'{d}/benchmark.parquet').first()['text']} {prose[11]}"
    rows = [(i, t, "en", "big" if i % 3 else None, 1) for i, t in enumerate(prose[20:60])]
    rows += [(1000, copy, "en", "big", 1), (1000, copy, "en", "big", 1), (None, copy, "en", "small", 1), (1001, copy + " tail", "en", "big", 1), (1002, copy, "en", "big", 1)]
    rows += [(7, leak, "en", "big", 1), (None, leak, "en", "big", 1)]  # doc_id 7 also has a clean text
    rows += [(None, prose[0], "en", "big", 1), (None, prose[1], "en", "big", 1), (2000, None, "en", "big", 1), (None, "", "en", "big", 1), (None, "", "en", "big", 1)]
    df = frame(spark, rows)
    kept = near = corpus_pipeline.near_duplicates(spark, df, d)
    assert near.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    texts = [r[1] for r in rows]
    groups = brute_components(texts, 5, 80)
    best = {}
    for k, (n, root) in groups.items():
        if n:
            order = (rows[k][0] is None, rows[k][0] or 0)
            best[root] = min(best.get(root, (order, k)), (order, k))
    want = Counter((rows[k][0], rows[k][1]) for _, k in best.values()) + Counter((r[0], r[1]) for r in rows if not (r[1] or "").strip())
    assert got == want and got[(1000, copy)] == 1 and got[(None, "")] == 2 and got[(7, leak)] + got[(None, leak)] == 1
    clean = corpus_pipeline.decontaminate(spark, df, d)
    assert clean.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((r[0], r[1]) for r in rows if r[1] != leak)
    mixed = corpus_pipeline.mixture(spark, df, d)
    times = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    once = Counter((r[0], r[1]) for r in rows)
    assert mixed.columns == df.columns and all(once[k] <= times[k] <= 2 * once[k] for k in once) and set(times) == set(once)
    lettered = corpus_pipeline.language(spark, df, d)
    assert lettered.columns == df.columns and not lettered.where("text is null or text = ''").count()
    assert corpus_pipeline.shard(spark, df, d).count() == len(rows)


def test_stages_of_an_empty_table(spark, corpus):
    df = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, df, corpus[0]).columns == df.columns and stage(spark, df, corpus[0]).count() == 0
    assert corpus_pipeline.shard(spark, df, corpus[0]).count() == 0
