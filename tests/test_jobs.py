import datetime as dt

from pyspark.sql import functions as F

from folioscope.plans import jobs

RISK = "Our sales could decline and harm our results in every one of the markets that we serve today. many buyers leave at times and this would hurt sales in the field. " + "some of them have left before and may do so again in any quarter of a year. " * 6


RULES = dict(categories=[("sales", r"\bsales\b")], boilerplate=r"\bcould harm\b")


def pages(spark):
    a = f"<body><h1>RISK FACTORS</h1><p>{RISK}</p><p>{RISK.replace('Our sales', 'Any of our plants')}</p><p>{RISK.replace('Our sales', 'Certain of our ships')}</p><h1>Use of Proceeds</h1><p>{'we plan to build. ' * 20}</p><table><tr><td>a</td><td>1</td></tr></table></body>"
    return spark.createDataFrame([("a", "u/a", a), ("b", "u/b", "<p>x</p>"), ("c", "u/c", None)], "document_id string, url string, html string")


def test_ingestion_and_brief(spark):
    out = jobs.ingest(pages(spark), **RULES)
    counts = {r["metric"]: r["value"] for r in out["metrics"].collect()}
    assert counts["sections"] == 3 and counts["chunks"] == 3 and counts["tables"] == 1 and counts["risks"] >= 3
    assert [r["section_id"] for r in out["tables"].collect()] == ["section-2-useofproceeds"]
    full = out["risks"].where("risk_extraction_type = 'full_text'")
    assert {r["plain_english"] for r in full.where("category = 'sales'").collect()} == {"The filing flags this as a sales risk. Review the source text for exact wording before relying on a summary."}
    assert full.count() >= 1 and full.where("document_id <> 'a'").count() == 0
    policy = spark.createDataFrame([("risk", ["Risk Factors"])], "topic string, allowed_titles array<string>")
    brief = jobs.build_brief(out["chunks"], out["risks"], policy, RULES["categories"], r"\bmarkets\b", subjects=[("selling", r"\bsales\b")], reasons={"sales": "It bears on sales."})
    items = brief["items"].where("section_id = 'key-risk-themes'").collect()
    assert 1 <= len(items) <= 2 and all(i["title"].startswith(("Our sales", "Any of", "Certain")) for i in items)
    assert all(i["body"].startswith("This risk concerns selling.") and i["why_it_matters"] == "Tied to selling, this is one of the risks the company says could materially affect its business. It bears on sales." for i in items)


def test_risk_cards_quote_240_characters_and_count_follow_on_sentences(spark):
    from folioscope.operators import brief

    title = "Our sales could decline and harm our results in the markets."
    long = "Sales in many of the " + "very distant " * 30 + "markets may fall in a year."
    rows = [("r1", "d", 1, title, f"{title} {long}", "mixed", "full_text", ["c1"]), ("r2", "d", 2, title.replace("sales", "yield"), title.replace("sales", "yield") + " " + title.replace("sales", "yield"), "mixed", "full_text", ["c2"])]
    found = spark.createDataFrame(rows, "id string, document_id string, pos int, title string, original_text string, specificity string, risk_extraction_type string, source_chunk_ids array<string>")
    chunks = spark.createDataFrame([(r[7][0], "s", "d", "RISK FACTORS", r[4]) for r in rows], "id string, section_id string, document_id string, title string, text string")
    policy = spark.createDataFrame([("risk", ["RISK FACTORS"])], "topic string, allowed_titles array<string>")
    cards = {r["source_chunk_ids"][0]: r for r in brief.risk_cards(found, chunks, policy, [("sales", "sales")], "zzz")[0].collect()}
    first = cards["c1"]["plain_english"].split('states: "')[1]
    assert 200 < len(first) <= 242 and first.endswith('…"')
    assert cards["c1"]["confidence"] == "medium" and cards["c2"]["confidence"] == "low"  # a sentence equal to the title supports nothing
    assert cards["c1"]["why_it_matters"].endswith(brief.OTHER_REASON)


def test_only_changed_pages_run_again(spark):
    from folioscope.operators.audit import source_hashes

    p = pages(spark)
    manifest = source_hashes(p).select("document_id", F.when(F.col("document_id") == "b", "old").otherwise(F.col("sha256")).alias("sha256"), F.create_map(F.lit("parser"), F.lit("1")).alias("versions"))
    out = jobs.ingest(p, manifest, {"parser": "1"}, **RULES)
    assert {r["document_id"] for r in out["sections"].select("document_id").distinct().collect()} == {"b"}
    assert jobs.ingest(p, manifest, {"parser": "2"}, **RULES)["sections"].select("document_id").distinct().count() == 2


def test_feed(spark):
    t0 = dt.datetime(2024, 1, 1)
    threads = spark.createDataFrame([("t1", "a", "risks", "body", False, False, t0), ("t2", "a", "x", "body", False, False, t0), ("t3", "a", None, "body", True, False, t0)], "id string, author_id string, section_id string, body string, is_deleted boolean, is_locked boolean, created_at timestamp")
    profiles = spark.createDataFrame([("a", "ann", None, "member")], "id string, handle string, display_name string, role string")
    votes = spark.createDataFrame([(1, t0, "u", "thread", "t2", 1)], "event_id long, ts timestamp, user_id string, target_type string, target_id string, value int")
    events = spark.createDataFrame([("t1", "insert", False)], "thread_id string, op string, is_deleted boolean")
    got = jobs.forum_feed(threads, profiles, votes, events).orderBy(F.desc("score")).collect()
    assert [(r["id"], r["score"], r["reply_count"], r["theme"], r["has_more"]) for r in got] == [("t2", 1, 0, None, False), ("t1", 0, 1, "risks", False)]


def test_blocks_are_grouped_once(spark):
    """Parents are found twice over the sections; the blocks must not be read for each."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(60).select(F.concat(F.lit("d"), F.col("id") % 3).alias("document_id"), F.col("id").cast("int").alias("pos"), F.lit("p").alias("tag"), F.when(F.col("id") % 10 < 3, F.lit("ITEM HEAD")).otherwise(F.lit("Some words. " * 20)).alias("text"))
    out = jobs.ingest_blocks(rows.mapInArrow(count, rows.schema), categories=[], boilerplate="x")
    assert out["sections"].count() > 3 and seen.value == 60


def test_risks_are_split_of_risk_chunks_only(spark, capsys):
    """No filter on the split items may be moved to the chunks: it would split them all, and the risky ones twice."""
    from folioscope.operators import risks

    chunks = spark.range(4).selectExpr("'d' AS document_id", "CAST(id AS INT) AS chunk_pos", "CAST(id AS STRING) AS id", "'s' AS section_id", "if(id = 1, 'Risk Factors', 'Other') AS title", "if(id = 1, 'risk_factor', 'narrative') AS chunk_type", "concat('Risks Related to ', repeat('our many wares ', 20)) AS text")
    got = risks.extract_risks(chunks, [], "x")
    got.explain()
    filters = [line for line in capsys.readouterr().out.splitlines() if "Filter (" in line]
    assert filters and not any("regexp_extract_all" in line for line in filters)
    assert [r["source_chunk_ids"] for r in got.collect()] == [["1"]]


def test_packing_as_by_the_plain_split():
    import random
    import re

    from folioscope.operators.sections import pack

    def plain(text, n):
        out, buffer = [], ""
        for sentence in re.split(r"(?<=\.) +(?=[A-Z(])", text):
            if len(buffer) + 1 + len(sentence) > n and buffer.strip():
                out, buffer = [*out, buffer.strip()], ""
            buffer += " " + sentence
        return [*out, buffer.strip()] if buffer.strip() else out

    g = random.Random(3)
    for _ in range(3000):
        text = "".join(g.choice((" ", ".", "A", "b", "(", ". A")) for _ in range(g.randrange(40)))
        for n in (1, 9, len(text), len(text) + 1, 60):
            assert pack(text, n) == plain(text, n)
