from pyspark.sql import functions as F

from folioscope.operators import evidence as V
from folioscope.operators import risks as K
from folioscope.operators import rules as R

BODY = "We depend on a few large customers in several markets. " + "many leave at times and this would hurt sales a great deal in the field. " * 6


def chunks(spark, text, title="RISK FACTORS"):
    return spark.createDataFrame([("d", 0, "c0", "s0", "risk_factor", title, text)], "document_id string, chunk_pos int, id string, section_id string, chunk_type string, title string, text string")


def test_split_by_openers_and_by_fallback(spark):
    three = BODY + BODY.replace("We depend", "Our group depends") + BODY.replace("We depend", "Any of us depends")
    got = K.split_risk_text(chunks(spark, three)).orderBy("item_pos").collect()
    assert [r["title"] for r in got][0] == "We depend on a few large customers in several markets" and len(got) >= 3 and {r["extraction_method"] for r in got} == {"sentence-heading-regex"}
    assert all(len(r["body"]) > 120 for r in got)
    rest = "x" * 121 + " Risks Related to Tax " + "y" * 110 + " Risk Related to War " + "z" * 20
    got = K.split_risk_text(chunks(spark, rest)).orderBy("item_pos").collect()
    assert [(r["item_pos"], r["title"][:20]) for r in got] == [(0, "Risk factor"), (1, "Risks Related to Tax")]
    assert K.split_risk_text(chunks(spark, "")).count() == 0 and K.split_risk_text(chunks(spark, None)).count() == 0


def test_classes_at_their_limits(spark):
    rows = [("RISK FACTORS", "A title", n) for n in (179, 180, 499, 500)] + [("Other", "A title", 900), (" RISK FACTORS ", "Risk Factors", 900), ("RISK FACTORS", "The unit, which", 900), ("RISK FACTORS", "Sold to Acme Inc", 900), ("RISK FACTORS", "Risk factor", 900), ("RISK FACTORS", "t" * 400, 559)]
    df = spark.createDataFrame([(i, a, b, "b" * n) for i, (a, b, n) in enumerate(rows)], "i int, chunk_title string, title string, body string")
    got = K.classify_risk(df).orderBy("i").collect()
    assert [r["risk_extraction_type"] for r in got] == ["heading_only", "fragment", "fragment", "full_text", "toc_entry", "toc_entry", "fragment", "fragment", "toc_entry", "fragment"]
    assert got[3]["confidence"] == "medium" and not got[3]["needs_review"] and got[4]["extraction_warning"].startswith('Extracted from "Other"')


def test_caps_interact(spark):
    rows = [("d", f"r{i}", i, t, c, s) for i, (t, c, s) in enumerate([("a", 1, 9), ("a", 1, 9), ("a", 2, 8), ("b", 1, 7), ("b", 2, 6), ("b", 3, 5), ("c", 2, 4), ("c", 2, 3)])]
    got = K.select_with_caps(spark.createDataFrame(rows, "document_id string, id string, pos int, theme string, chunk_id int, score int")).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["r0", "r1", "r4", "r5", "r6"]  # r2: theme full; r3: chunk full; r7: chunk full


def test_support_and_calibration(spark):
    s = ["Our satellites could fail in orbit and harm us.", "Short one.", "The weather was fine in the valley for most of the year.", "Failed satellites may cause material loss and delay in every one of our markets.", "You should buy now because the satellites are really cheap today."]
    df = spark.createDataFrame([(s, s[0])], "s array<string>, t string")
    assert df.select(K.supporting_sentences(F.col("s"), F.col("t"), r"\borbit\b")).first()[0] == [s[3]]
    df = spark.createDataFrame([(["T", s[2]], "T")], "s array<string>, t string")
    assert df.select(K.supporting_sentences(F.col("s"), F.col("t"), r"\borbit\b")).first()[0] == [s[2]]  # none related: the pool
    df = spark.createDataFrame([(True, 1, "ab 12"), (True, 1, "abcdef 12"), (False, 1, "abc"), (True, 0, "abc"), (True, 1, "")], "u boolean, n int, q string")
    c, _ = K.calibrate(F.col("u"), F.col("n"), F.col("q"))
    assert [x[0] for x in df.select(c).collect()] == ["low", "medium", "low", "low", "medium"]


def test_rules(spark):
    df = spark.createDataFrame([("regulatory cost",), ("we compete",), (None,), ("The AI",)], "t string")
    rules = [("reg", r"\bregulat\b"), ("comp", r"\b(compete|ai)\b")]
    assert [r[0] for r in df.select(R.classify_first_match(F.col("t"), rules)).collect()] == ["other", "comp", "other", "comp"]
    ids = spark.createDataFrame([("section-40-riskfactors",), ("risks",), ("section-2-RiskManagement",), ("",), (None,), ("x",)], "s string")
    once = ids.select(R.resolve_theme(F.col("s")).alias("s"))
    assert [r[0] for r in once.collect()] == ["risks", "risks", "risks", None, None, None]
    assert once.select(R.resolve_theme(F.col("s"))).collect() == once.collect()
    caps = spark.createDataFrame([("d", 0, "a", "no gate"), ("d", 1, "b", "the symbol for us"), ("e", 0, "c", "a symbol")], "document_id string, chunk_pos int, id string, text string")
    got = {r["document_id"]: (r["id"], r["value_text"], r["confidence"]) for r in R.extract_capture(caps, "symbol", r"symbol\s+([A-Z]{2,6})").collect()}
    assert got == {"d": ("b", "for", "medium"), "e": ("c", "a symbol", "low")}  # ordinary words are captured too


def test_quote_windows():
    text = "First one here. " + "word " * 60 + "the needle sits. " + "tail " * 200 + "End of it. More."
    at = text.index("needle")
    got = V.window(text, "NEEDLE")
    assert "needle sits." in got and got.startswith("word") and text[text.index(got) - 1] == " " and len(got) <= 140 + 760
    assert V.window("abc def", "zzz", 5) == "abc d"
    assert V.window("Needle first. Next", "needle") == "Needle first."
    assert V.window("One. Two needle. Three", "needle") == "Two needle. Three" and at
    assert V.window("Revenue ..... $4 needle", "needle").startswith("Revenue")


def test_quotes_and_gate(spark):
    ch = spark.createDataFrame([("c1", "s", "Business", "u1", "We make, and sell, things."), ("c2", "s", "Glossary of Terms", "u2", "words")], "id string, section_id string, title string, source_url string, text string")
    rec = spark.createDataFrame([("a", ["c1"], "make,  and"), ("b", ["c1"], "make and sell"), ("c", ["c9", "c1"], ""), ("d", ["c1", "c1"], None)], "id string, source_chunk_ids array<string>, source_quote string")
    assert {(r["id"], r["check"]) for r in V.verify_quotes(rec, ch).collect()} == {("b", "bad_quote"), ("c", "missing_chunk")}
    assert {(r["id"], r["check"]) for r in V.verify_quotes(rec, ch, "signature").collect()} == {("c", "missing_chunk")}
    kinds = "draft_pos int, topic string, title string, chunk_id string, quote_needle string, extracted_text string, plain_english string, why_it_matters string, confidence string, needs_review boolean, extraction_method string, required_terms array<string>, allowed_titles array<string>"
    row = lambda i, topic, chunk, needle, terms=None, plain="ok", allowed=None: (i, topic, f"T{i}", chunk, needle, "x", plain, "y", None, None, "m", terms, allowed)
    drafts = spark.createDataFrame([row(1, "business", "c1", "sell"), row(2, "business", "gone", "x", plain="candidate"), row(3, "business", "c2", "words"), row(4, "business", "c1", "sell", ["sell", "ROCKET"], "A candidate"), row(5, "other", "c1", "make", None, "ok", ["BUSINESS"])], kinds)
    policy = spark.createDataFrame([("business", ["business"])], "topic string, allowed_titles array<string>")
    ok, no = V.evidence_gate(drafts, ch, policy)
    assert {r["id"]: r["confidence"] for r in ok.collect()} == {"evidence-business-t1": "high", "evidence-other-t5": "high"}
    reasons = {r["title"]: r["reasons"] for r in no.collect()}
    assert reasons["T2"] == ["Source chunk not found."]
    assert reasons["T3"] == ["Weak citation section: Glossary of Terms.", 'Source section "Glossary of Terms" is not allowed for business.']
    assert reasons["T4"] == ['Source quote does not contain required term "ROCKET".', "Parser diagnostic or candidate language is not allowed in evidence cards."]
    cards = spark.createDataFrame([("a", "Cash was $4.694 billion", "and $12 and $7", "total 4,694 (in millions) 12")], "id string, title string, plain_english string, source_quote string")
    assert V.unbacked_figures(cards).count() == 0  # $7 has one digit
    assert [r["figure"] for r in V.unbacked_figures(cards.withColumn("source_quote", F.lit("469"))).orderBy("figure").collect()] == ["12", "4694"]


def test_caps_hold_for_no_theme_and_no_chunk(spark):
    rows = [("d", i, i, None if i < 6 else "t", i if i < 6 else None, 0) for i in range(9)] + [(None, 20 + i, i, "t", i, 0) for i in range(3)]
    got = K.select_with_caps(spark.createDataFrame(rows, "document_id string, id int, pos int, theme string, chunk_id int, score int"))
    assert sorted((str(r["document_id"]), r["rank"], r["id"]) for r in got.collect()) == [("None", 1, 20), ("None", 2, 21), ("d", 1, 0), ("d", 2, 1), ("d", 3, 6), ("d", 4, 7)]


def test_risks_without_a_title_or_a_place(spark):
    rows = [("d", 1, 0, "Risk Factor: A-B"), ("d", 2, 0, ""), ("d", 2, 1, None), ("d", 3, 0, " . "), ("d", None, 0, "Last")]
    got = K.number_records(spark.createDataFrame(rows, "document_id string, chunk_pos int, item_pos int, title string")).orderBy("pos")
    assert got.columns == ["document_id", "chunk_pos", "item_pos", "title", "pos", "id"]
    assert [r["id"] for r in got.collect()] == ["risk-1-risk-factor-ab", "risk-2-untitled", "risk-3-untitled", "risk-4-untitled", "risk-5-last"]


def test_chunk_without_a_text_is_not_missing(spark):
    ch = spark.createDataFrame([("c1", None), ("c2", "")], "id string, text string")
    rec = spark.createDataFrame([("a", ["c1", "c2", "c3"], "so"), ("b", ["c1", "c2"], "")], "id string, source_chunk_ids array<string>, source_quote string")
    for mode in ("exact", "signature"):
        assert {(r["id"], r["chunk_id"], r["check"]) for r in V.verify_quotes(rec, ch, mode).collect()} == {("a", "c2", "bad_quote"), ("a", "c3", "missing_chunk")}
