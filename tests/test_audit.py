from pyspark.sql import functions as F

from folioscope.operators import audit as Q
from folioscope.operators import brief as B
from folioscope.sources import tables as A


def test_reviewed_rows_replace_and_append(spark):
    g = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2")], "id string, pos int, v string")
    r = spark.createDataFrame([("b", 0, "x"), ("b", 1, "y"), ("n", 2, "p"), ("n", 3, "q")], "id string, pos int, v string")
    assert [(x["id"], x["v"]) for x in Q.merge_reviewed(g, r).orderBy("order").collect()] == [("a", "1"), ("b", "y"), ("n", "p"), ("n", "q")]


def test_duplicate_suffixes(spark):
    df = spark.createDataFrame([("d", "x", 0), ("d", "x", 4), ("d", "x", 7), ("e", "x", 9)], "document_id string, id string, pos int")
    assert [r["id"] for r in Q.suffix_duplicate_ids(df).orderBy("pos").collect()] == ["x", "x-4", "x-7", "x"]


def test_drift(spark):
    snap = lambda **k: spark.createDataFrame(list(k.items()), "metric string, value long")
    a = snap(sections=100, chunks=100, risks=0, facts=5, **{"flag:dilution": 1})
    b = snap(sections=125, chunks=126, risks=1, facts=4, **{"flag:dilution": 0})
    assert {(r["metric"], r["warning"]) for r in Q.snapshot_drift(a, b).collect()} == {("chunks", "count moved"), ("risks", "count moved"), ("facts", "facts fell"), ("flag:dilution", "coverage changed")}
    assert [r["warning"] for r in Q.snapshot_drift(a.limit(0), b).collect()] == ["no previous snapshot"]
    assert Q.snapshot_drift(a, a).count() == 0


def test_fingerprint_ignores_order(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("s"))
    one = Q.dataset_fingerprint(df).first()
    assert one == Q.dataset_fingerprint(df.orderBy(F.rand(1)).repartition(7)).first() and one["rows"] == 200
    assert one["fingerprint"] != Q.dataset_fingerprint(df.where("id > 0")).first()["fingerprint"]
    assert Q.dataset_fingerprint(df.limit(0)).first()["rows"] == 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("d", 1)], "document_id string, n int")
    Q_ = str(tmp_path / "out")
    A.write_artifacts({"facts": df, "facts_reviewed": df}, Q_, 4, ("facts_reviewed",))
    assert A.read_table(spark, f"{Q_}/facts", "document_id string, n int").collect() == df.collect()
    assert A.read_table(spark, f"{Q_}/facts_reviewed", "document_id string, n int").count() == 0
    (tmp_path / "x.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert A.read_table(spark, str(tmp_path / "x.json"), "id string, n int").count() == 2
    (tmp_path / "p.html").write_text("<p>é</p>")
    (r,) = A.read_files(spark, str(tmp_path / "*.html")).collect()
    assert (r["document_id"], r["html"], r["size_bytes"]) == ("p.html", "<p>é</p>", 9)


def cards(spark, *rows):
    base = dict(brief_id="b", source_section_id="s", source_chunk_ids=["c"], source_quote="$12 million", extracted_text="x", plain_english="It is so.", why_it_matters="y", confidence="high", needs_review=False, extraction_method="m", quality_warnings=[])
    data = [{**base, "id": f"e{i}", "card_pos": i, "topic": t, "title": n, **x} for i, (t, n, x) in enumerate(rows)]
    return spark.createDataFrame(data, "brief_id string, id string, card_pos int, topic string, title string, source_section_id string, source_chunk_ids array<string>, source_quote string, extracted_text string, plain_english string, why_it_matters string, confidence string, needs_review boolean, extraction_method string, quality_warnings array<string>")


def test_brief_routes_and_limits(spark):
    c = cards(spark, *[("proceeds", f"P{i}", {}) for i in range(10)], ("debt", "Total long-term debt", {}), ("dilution", "D", {"plain_english": "left blank"}), ("debt", "Other debt", {"confidence": "low"}), ("risk", "R", {}))
    items = B.assemble_brief(c)
    got = {}
    for r in items.orderBy("section_pos", "item_pos").collect():
        got.setdefault(r["section_id"], []).append((r["title"], r["id"], r["needs_review"]))
    assert [x[0] for x in got["use-of-proceeds"]] == [f"P{i}" for i in range(8)] and len(got["ten-things"]) == 10
    assert [x[0] for x in got["dilution-capitalization"]] == ["D", "Total long-term debt"] and [x[0] for x in got["debt-liquidity"]] == ["Other debt"]
    assert got["unclear-needs-review"] == [("D", "review-e11", True)] and got["ten-things"][0][1] == "notice-e0"
    assert {r["section_id"] for r in B.empty_sections(items).collect()} == {"what-it-does", "offering-mechanics", "financial-snapshot", "control-governance", "related-party-transactions", "lockup-share-overhang"}
    groups = [(r["group_id"], r["title"]) for r in B.reader_sections(items).orderBy("group_pos", "pos").collect()]
    assert groups[10:] == [("ownership", "D"), ("ownership", "Total long-term debt"), *[("capital", f"P{i}") for i in range(8)], ("capital", "Other debt"), ("risks", "R")]


def test_brief_checks_and_markdown(spark):
    c = cards(spark, ("financial", "Cash was $12 million", {}), ("business", "You should buy it", {"source_quote": "absent"}))
    items = B.assemble_brief(c)
    ch = spark.createDataFrame([("c", "Business", "so $12 million it is")], "id string, title string, text string")
    policy = spark.createDataFrame([("financial", ["Business"]), ("business", ["Summary"])], "topic string, allowed_titles array<string>")
    cites = items.select("id", F.lit(0).alias("cite_pos"), F.lit("c").alias("chunk_id"), F.lit("s").alias("section_id"), F.lit("a|b").alias("quote"))
    found = {(r["severity"], r["check"]) for r in B.validate_brief(items, c, ch, policy, cites, c.limit(0)).collect()}
    assert {("error", "too few cards"), ("error", "card bad_quote"), ("error", "item bad_quote"), ("error", "section not allowed for topic"), ("error", "advice"), ("error", "missing section"), ("error", "too few real values")} <= found
    assert ("warning", "figure not in quote") not in found
    briefs = spark.createDataFrame([("b", "Title", "None of it is advice.", {"form": "S-1"}), ("z", "Empty", "-", {})], "brief_id string, title string, disclaimer string, snapshot map<string,string>")
    md = {r["brief_id"]: r["markdown"] for r in B.render_markdown(items, cites, briefs).collect()}
    assert md["b"].startswith("# Title\n\nNone of it is advice.\n\n## Filing Snapshot\n\n- **form:** S-1\n") and '- c / s: "a\\|b"' in md["b"] and "## financial-snapshot" in md["b"]
    assert md["z"].startswith("# Empty")


def test_report_errors_and_order_free_fingerprint(spark):
    empty = lambda k: spark.createDataFrame([], k)
    docs, secs = empty("id string, type string, source_url string"), empty("id string, normalized_title string, source_url string, text string, title string")
    chunks = empty("id string, text string, title string, source_url string")
    facts = empty("id string, document_id string, category string, source_chunk_ids array<string>, source_quote string, plain_english string, investor_relevance string")
    risks = empty("id string, source_chunk_ids array<string>, source_quote string, source_section_id string, risk_extraction_type string, character_length int, title string")
    report = spark.createDataFrame([("error", "no index"), ("warning", "odd page")], "level string, message string")
    found = [(r["severity"], r["detail"]) for r in Q.validate_corpus(docs, secs, chunks, facts, risks, report).where("check like 'extraction report%'").collect()]
    assert found == [("error", "no index")]
    warned = Q.warn_corpus(secs, chunks, facts, risks, empty("section_id string"), report=report).where("check like 'extraction report%'").collect()
    assert [(r["severity"], r["detail"]) for r in warned] == [("warning", "odd page")]
    rows = [(i, None if i % 3 else "x|y", float(i)) for i in range(50)]
    kind = "a long, b string, c double"
    one, two = (Q.dataset_fingerprint(spark.createDataFrame(r, kind).repartition(n)).first() for r, n in ((rows, 1), (rows[::-1], 7)))
    assert one == two and one != Q.dataset_fingerprint(spark.createDataFrame([*rows[1:], (0, "x|z", 0.0)], kind)).first()


def test_capped_selection_against_a_plain_fold(spark):
    import random

    from folioscope.operators import risks as K

    g = random.Random(5)
    rows = [(f"d{i % 3}", i, i, g.randrange(4), g.randrange(5), g.randrange(6)) for i in range(400)]
    for caps in ((2, 2), (1, 3), (3, 1)):
        got = {(r["document_id"], r["id"]): r["rank"] for r in K.select_with_caps(spark.createDataFrame(rows, "document_id string, id int, pos int, theme int, chunk_id int, score int"), *caps).collect()}
        want = {}
        for d in ("d0", "d1", "d2"):
            themes, chunks = {}, {}
            for _, i, _, t, c, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[5], r[2])):
                if themes.get(t, 0) < caps[0] and chunks.get(c, 0) < caps[1]:
                    themes[t], chunks[c] = themes.get(t, 0) + 1, chunks.get(c, 0) + 1
                    want[d, i] = sum(themes.values())
        assert got == want


def test_tables_without_a_whole_word(spark):
    from folioscope.operators import sections as S

    secs = spark.createDataFrame([("d", 0, "s0", "alpha beta gamma"), ("d", 1, "s1", "xbetay gamma delta"), ("e", 0, "s2", "beta")], "document_id string, ord int, id string, text string")
    tabs = spark.createDataFrame([("d", i, t) for i, t in enumerate(["eta", "beta gamma", "a beta g", "gamma delta", "zz", "", "y gamma d"])], "document_id string, ord int, text string")
    got = {r["ord"]: r["section_id"] for r in S.associate_tables(tabs, secs).collect()}
    assert got == {0: "s0", 1: "s0", 2: "s0", 3: "s1", 4: None, 5: "s0", 6: "s1"}
