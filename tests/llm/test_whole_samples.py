"""Fits on samples of large tables: every language, the rate of all labels."""

import numpy as np

import corpus_pipeline
from folioscope.llm import langid, toxicity
from tests.llm.test_llm import DOC, speech, table


def test_rare_language_stays_in_the_sample(spark):
    langs = ["en"] * 400 + ["de"] * 400 + ["fr"] * 6
    texts = [t for k, n in (("en", 400), ("de", 400), ("fr", 6)) for t in speech(k, n, 7)]
    model = langid.fit(table(spark, texts, langs), max_rows=60)
    assert model.langs == ["de", "en", "fr"]
    held = speech("fr", 5, 99)
    assert {r["lang_pred"] for r in langid.predict(table(spark, held), model).collect()} == {"fr"}


def test_parts_of_a_sample():
    got = langid.parts({"a": 1000, "b": 500, "c": 5, "d": 20}, 225)
    assert got == {"c": 5, "d": 20, "b": 100, "a": 100}
    assert langid.parts({"a": 3, "b": 4}, 100) == {"a": 3, "b": 4}


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 0, "x", 1, 2) for i, t in enumerate(["some words", None, "12 34", "über"])], DOC)
    got = corpus_pipeline.language(spark, docs.select(*corpus_pipeline.COLUMNS), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 3] and got.columns == list(corpus_pipeline.COLUMNS)


def test_empty_texts_get_the_rate_of_all_labels(spark):
    texts = [f"nice word {i}" for i in range(400)] + [f"bad idiot {i}" for i in range(100)]
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, texts), labels, max_rows=60, steps=2)
    assert np.isclose(model["empty"][0], np.log(100.5 / 400.5))
    got = toxicity.score(table(spark, ["", None, " "]), model).collect()
    assert all(abs(r["score"] - 0.2) < 0.01 for r in got)
