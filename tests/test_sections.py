from pyspark.sql import functions as F

from folioscope.operators import sections as S
from folioscope.sources import html as H


def test_blocks_follow_the_selection_rules():
    page = """<body><div>leaf<div><p>one</p> lost</div></div><div><span><p>both</p></span></div><table><tr><td><div>cell</div></td><td><p>in</p></td></tr></table>
      <script>if (a < b) '<p>no</p>'</script><p id=x>open <b>bold<br><p>next<noscript>n</noscript></body>"""
    got = [(tag, text) for tag, text, _ in H.blocks(page)]
    assert got == [("p", "one"), ("div", "both"), ("p", "both"), ("table", "cell in"), ("div", "cell"), ("p", "open bold"), ("p", "next")]
    assert [a for _, t, a in H.blocks(page) if t == "open bold"] == ["x"]
    assert H.blocks("") == []


def test_tables_and_inventory(spark):
    page = "<table class=tableFile><tr><th>h</th></tr><tr><td>1</td><td>Main</td><td><a href='/a/s1.htm'>x</a></td><td>S-1</td></tr><tr><td>0</td><td>d</td><td>f</td><td>t</td></tr><tr><td>2</td><td></td><td><a href='#'>x</a></td><td>EX</td></tr><tr><td>3</td><td></td><td>e.txt</td><td>EX-2.1</td></tr></table><table><tr><td></td></tr></table>"
    df = spark.createDataFrame([("k", page), ("n", None)], "document_id string, html string")
    assert [(r["ord"], r["text"]) for r in H.extract_tables(df).collect()] == [(0, "h 1 Main x S-1 0 d f t 2 x EX 3 e.txt EX-2.1")]
    got = H.filing_inventory(df, "u/").orderBy("sequence").collect()
    assert [(r["id"], r["filename"], r["source_url"]) for r in got] == [("1-s1", "s1.htm", "u/s1.htm"), ("3-ex21", "e.txt", "u/e.txt")]


def blocks(spark, *rows):
    return spark.createDataFrame([("d", i, tag, text, None) for i, (tag, text) in enumerate(rows)], "document_id string, pos int, tag string, text string, anchor string")


def test_headings_sections_and_parents(spark):
    rows = blocks(spark, ("p", "Risk Factors"), ("p", "text a."), ("h3", "Small"), ("p", "Item 4. Things to do"), ("p", "ALL CAPS"), ("p", "body"), ("p", " "))
    got = S.section_parents(S.sessionize_sections(S.mark_headings(rows))).orderBy("ord").collect()
    assert [(r["id"], r["level"], r["text"], r["parent_id"]) for r in got] == [
        ("section-1-riskfactors", 1, "text a.", None), ("section-2-small", 3, "", "section-1-riskfactors"), ("section-3-item4thingstodo", 1, "", None), ("section-4-allcaps", 2, "body", "section-3-item4thingstodo"),
    ]


def test_preamble_only_with_text(spark):
    got = S.sessionize_sections(S.mark_headings(blocks(spark, ("p", "before"), ("h1", "T")))).orderBy("ord").collect()
    assert [(r["id"], r["title"], r["text"]) for r in got] == [("section-document-preamble", "Document Preamble", "before"), ("section-1-t", "T", "")]
    assert S.sessionize_sections(S.mark_headings(blocks(spark, ("p", " ")))).count() == 0


def test_tiny_sections_fold_into_the_last_kept(spark):
    long = "x" * 130
    rows = [("d", 0, "a", "A", "a", 1, long), ("d", 1, "b", "B", "b", 2, "tiny"), ("d", 2, "c", "C", "c", 2, "also tiny"), ("d", 3, "e", "Dilution", "dilution", 2, "major"), ("d", 4, "f", "F", "f", 3, long)]
    df = spark.createDataFrame(rows, "document_id string, ord int, id string, title string, normalized_title string, level int, text string")
    got = S.merge_tiny_sections(df).orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["text"]) for r in got] == [(0, "a", long + " B tiny C also tiny"), (1, "e", "major"), (2, "f", long)]
    parents = df.withColumn("parent_id", F.when(F.col("id") == "f", "b"))
    assert [r["id"] for r in S.dangling_parents(S.merge_tiny_sections(parents)).collect()] == ["f"]


def test_packing_at_the_limit():
    a, b = "A" * 2999 + ".", "B" * 2998 + "."
    assert S.pack(f"{a} {b}", 6000) == [a, b]  # the leading space counts: 1 + 3000 + 1 + 2999 > 6000
    assert S.pack(f"{a} {b[1:]}", 6000) == [f"{a} {b[1:]}"]
    assert S.pack("no end " * 2000, 6000) == [("no end " * 2000).strip()]
    assert S.pack("", 6000) == []


def test_chunks(spark):
    df = spark.createDataFrame([("d", 0, "section-1-riskfactors", "RISK FACTORS", "One. Two."), ("d", 1, "s", "", "")], "document_id string, ord int, id string, title string, text string")
    (r,) = S.chunk_sections(df).collect()
    assert (r["id"], r["chunk_type"], r["token_estimate"]) == ("chunk-section1riskfactors-1", "risk_factor", 3)
    assert r["citation_label"] == 'RISK FACTORS (d, section 0), chunk 1: "One. Two."'


def test_main_document_and_labels(spark):
    df = spark.createDataFrame([("p", 1, "S-1/A", "a.htm"), ("p", 2, "s-1", "b.HTML"), ("p", 3, "S-1", "c.txt"), ("q", 1, "EX", "known.htm")], "package_id string, sequence int, type string, filename string")
    assert {r["package_id"]: r["filename"] for r in S.pick_main_document(df, r"known\.htm").collect()} == {"p": "b.HTML", "q": "known.htm"}
    ids = spark.createDataFrame([("section-40-riskfactors",), ("chunk-section9useofproceeds-2",), ("section-3-some_other",), ("section-7",)], "id string")
    titles = spark.createDataFrame([("riskfactors", "Risk Factors"), ("useofproceeds", "Use of Proceeds")], "slug string, title string")
    assert {r["id"]: r["label"] for r in S.section_label(ids, titles).collect()} == {"section-40-riskfactors": "Risk Factors", "chunk-section9useofproceeds-2": "Use of Proceeds", "section-3-some_other": "Some Other", "section-7": "Filing source"}


def test_parents_and_folding_over_blocks(spark):
    """Any block size gives what one look at the whole document gives."""
    import random

    g = random.Random(8)
    rows = []
    for d in ("a", "b", None):
        for o in range(60 if d != "b" else 1):
            title = "Risk Factors" if g.random() < 0.1 else f"Part {o}"
            rows.append((d, o + (d == "a"), f"{d}-{o}", title, title.lower(), g.randint(1, 6), "x" * g.choice([0, 10, 119, 120, 200])))
    df = spark.createDataFrame(rows, "document_id string, ord int, id string, title string, normalized_title string, level int, text string").repartition(4)
    parents, folded = {}, {}
    for d in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
        kept = []
        for k, r in enumerate(own):
            parents[r[2]] = next((p[2] for p in reversed(own[:k]) if p[5] < r[5]), None)
            if kept and len(r[6]) < 120 and r[5] > kept[-1][0][5] and r[3] != "Risk Factors":
                kept[-1][1].append(f"{r[3]}\n{r[6]}")
            else:
                kept.append((r, [r[6]]))
        folded |= {r[2]: (n, " ".join(" ".join(t).split())) for n, (r, t) in enumerate(kept)}
    for block in (1, 7, 4096):
        assert {r["id"]: r["parent_id"] for r in S.section_parents(df, block=block).collect()} == parents
        out = S.merge_tiny_sections(df.withColumn("extra", F.lit(1)), block=block)
        assert out.columns == [*df.columns, "extra"] and {r["id"]: (r["ord"], r["text"]) for r in out.collect()} == folded
    assert S.merge_tiny_sections(df.where("false")).count() == 0 and S.section_parents(df.where("false")).count() == 0


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    from folioscope.sources import html as H

    pages = ["<p>a &lt b<table><TR><td>1<td id='x'>2</table><br/>c&", "<div class=\"a b\">x<div>y</div></p></div>z", "a < b<p>c", "<p>x<title><b></title>y", "<!-- <p> -->q<h2 id=\"\">r</h2 >", "", "<p id='a' ID='b'>u</p/>v", "<ul><li>1<li>2</ul><a href='/x'/>w"]
    read = lambda: [(H.blocks(p), H._tables(H.parse(p))) for p in pages]
    assert [H.Tree(p).plain for p in pages] == [True, True, False, False, False, True, False, True]
    got = read()
    monkeypatch.setattr(H.Tree, "read_plain", lambda self, html: False)
    assert got == read()


def test_large_batches_are_parsed_in_parts(spark, monkeypatch):
    from folioscope.sources import html as H

    monkeypatch.setattr(H, "AT_ONCE", 64)
    pages = spark.createDataFrame([(None, "<p>n</p>"), *[(i, f"<p>{i} {'w' * (i % 90)}</p><p>b</p>") for i in range(300)], (301, None), (302, "")], "document_id long, html string").coalesce(1)
    got = [tuple(r) for r in H.html_blocks(pages).select("document_id", "pos", "text").collect()]
    assert got == [(None, 0, "n"), *[x for i in range(300) for x in ((i, 0, f"{i} {'w' * (i % 90)}".strip()), (i, 1, "b"))]]


def test_risk_titles_over_unusual_breaks(spark):
    """Each title's body runs to the next one, whatever characters are in it."""
    from folioscope.operators import risks

    text = "Intro. " + " ".join(f"We may lose customers of kind {c} in the market. Body {c}\u0085 {'word ' * 30}end." for c in "abcd")
    rows = risks.split_risk_text(spark.createDataFrame([("t", text)], "title string, text string")).orderBy("item_pos").collect()
    assert [r["title"] for r in rows] == [f"We may lose customers of kind {c} in the market" for c in "abcd"] and all(r["body"].endswith("end.") for r in rows)
