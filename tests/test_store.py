"""Artefacts as they are stored: damaged files, stores that runs change in part, nested briefs and their checks."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import audit
from folioscope.plans import jobs
from folioscope.sources import briefs, tables

RULES = dict(categories=[("money", "cash")], boilerplate="generally")


def test_damaged_files(spark, tmp_path):
    files = {
        "good.json": '[{"id": "a", "n": 1}, {"n": 2}, {"id": "é\\n", "n": null, "more": [1]}]', "typed.json": '[{"id": "c", "n": 1}, {"id": "d", "n": "x"}, 7, null, {"id": {"x": 1}, "n": 3}]', "cut.json": '[{"id": "f", "n": 1}, {"id": "g", "n"',
        "empty.json": "", "none.json": " [] ", "object.json": '{"id": "h", "n": 7}', "text.json": "nothing",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, damaged = tables.read_checked(spark, str(tmp_path), "id string, n int")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("a", 1), (None, 2), ("é\n", None), ("c", 1), ('{"x":1}', 3)], key=str)
    got = sorted((r["file"].split("/")[-1], r["entry"], r["problem"]) for r in damaged.collect())
    assert got == [("cut.json", -1, "cut off"), ("object.json", -1, "cut off"), ("text.json", -1, "cut off"), ("typed.json", 1, "wrong type"), ("typed.json", 2, "no object"), ("typed.json", 3, "no object")]
    assert {r["record"] for r in damaged.where("problem = 'wrong type'").collect()} == {'{"id":"d","n":"x"}'}
    lines, bad = tables.read_checked(spark, str(tmp_path / "good.json"), "id string, n int", whole=False)
    assert lines.count() == 3 and bad.count() == 0
    for name in ("cut.json", "typed.json"):
        with pytest.raises(Exception, match="FAILED_READ_FILE"):
            tables.read_table(spark, str(tmp_path / name), "id string, n int").collect()
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "good.json"), "id string, n int").collect()] == [("a", 1), (None, 2), ("é\n", None)]
    assert tables.read_table(spark, str(tmp_path / "missing.json"), "id string").count() == 0


def stored(spark, path, name="t"):
    return sorted((tuple(r) for r in tables.stored_artifacts(spark, path)[name].drop("bucket").collect()), key=str)


def test_merging_keeps_what_a_run_does_not_hold(spark, tmp_path):
    path, kind = str(tmp_path), "document_id string, v int"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    tables.merge_artifacts({"t": rows(("a", 1), ("b", 2), ("b", 3), (None, 4))}, path, ids("a", "b", None), 4)
    assert stored(spark, path) == sorted([("a", 1), ("b", 2), ("b", 3), (None, 4)], key=str)
    before = set(glob.glob(f"{path}/t/bucket=*/*.parquet"))
    touched = tables.merge_artifacts({"t": rows(("b", 9))}, path, ids("b"), 4)
    assert stored(spark, path) == sorted([("a", 1), ("b", 9), (None, 4)], key=str)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= set(glob.glob(f"{path}/t/bucket=*/*.parquet"))  # other buckets' files are the same
    tables.merge_artifacts({"t": rows()}, path, ids("b", None), 4)  # their last rows go, and maybe a whole bucket
    assert stored(spark, path) == [("a", 1)]
    tables.merge_artifacts({"t": rows()}, path, ids("a"), 4)
    assert stored(spark, path) == []
    tables.merge_artifacts({"t": rows(("x", 1))}, path, ids(), 4)  # nobody's rows are replaced, so none are written
    assert stored(spark, path) == []
    with pytest.raises(ValueError, match="buckets and columns"):
        tables.merge_artifacts({"t": rows()}, path, ids("a"), 8)
    with pytest.raises(ValueError, match="buckets and columns"):
        tables.merge_artifacts({"t": rows().withColumn("w", F.lit(1))}, path, ids("a"), 4)
    tables.merge_artifacts({"notes": spark.range(2), "t": rows(("a", 5))}, path, ids("a"), 4, reviewed=("t",))
    assert spark.read.parquet(f"{path}/notes").count() == 2 and stored(spark, path) == []


def page(words: str, table: bool = False):
    return f"<h1>Risk Factors</h1><p>{words} could fall and harm us all. {'More text of it. ' * 12}</p>" + ("<table><tr><td>a</td><td>1</td></tr></table>" if table else "") + f"<h2>NOTES ON IT</h2><p>{words} again.</p>"


def snapshot(out):
    return {k: sorted((tuple(r) for r in df.drop("bucket", "run").collect()), key=str) for k, df in out.items() if k != "metrics"}


def test_two_runs_equal_one(spark, tmp_path):
    kind = "document_id string, url string, html string"
    was = [("a", "u", page("Cash", True)), ("b", "u", page("Sales")), ("c", "u", page("Debt", True)), ("e", "u", "")]
    now = [("a", "u", page("Cash", True)), ("b", "u", page("Costs", True)), ("d", "u", page("Rent")), ("e", "u", page("Late"))]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    whole = snapshot(jobs.run_ingestion(spark.createDataFrame(now, kind), one, {"parser": "2"}, 4, **RULES))
    jobs.run_ingestion(spark.createDataFrame(was, kind), two, {"parser": "2"}, 4, **RULES)
    parsed = []
    plain, tables.merge_artifacts = tables.merge_artifacts, lambda t, path, replaced, *a: (parsed.append(sorted(r[0] for r in replaced.collect())), plain(t, path, replaced, *a))[1]
    try:
        pages = spark.createDataFrame(now, kind)
        assert snapshot(jobs.run_ingestion(pages, two, {"parser": "2"}, 4, **RULES)) == whole
        assert parsed == [["b", "c", "d", "e"]] * 4  # one changed, one gone, one new, one no longer empty
        assert snapshot(jobs.run_ingestion(pages, two, {"parser": "2"}, 4, **RULES)) == whole and len(parsed) == 4  # nothing to do
        # a run that stopped before the manifest is made good by the next
        tables.read_table(spark, f"{two}/manifest", "document_id string, sha256 string, size_bytes bigint, versions map<string,string>").where("document_id <> 'b'").coalesce(1).write.parquet(f"{two}/held")
        spark.read.parquet(f"{two}/held").write.mode("overwrite").parquet(f"{two}/manifest")
        assert snapshot(jobs.run_ingestion(pages, two, {"parser": "2"}, 4, **RULES)) == whole and parsed[-1] == ["b"]
        again = jobs.run_ingestion(pages, two, {"parser": "3"}, 4, **RULES)
        assert parsed[-1] == ["a", "b", "d", "e"] and {tuple(r["versions"].items()) for r in again["manifest"].collect()} == {(("parser", "3"),)}
    finally:
        tables.merge_artifacts = plain
    gone = jobs.run_ingestion(spark.createDataFrame([], kind), two, {"parser": "3"}, 4, **RULES)
    assert all(df.count() == 0 for k, df in gone.items() if k != "metrics") and {r["value"] for r in gone["metrics"].collect()} == {0}
    assert os.listdir(f"{two}/sections") == [x for x in os.listdir(f"{two}/sections") if not x.startswith("bucket=")]


def test_one_parse_gives_blocks_and_tables(spark):
    from folioscope.sources import html

    pages = spark.createDataFrame([("a", page("Cash", True)), ("b", None), ("c", "<table><tr><td></td></tr></table><table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>")], "document_id string, html string")
    parts = html.page_parts(pages)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(parts.where("kind = 'block'").select("document_id", "pos", "tag", "text")) == rows(html.html_blocks(pages).drop("anchor"))
    assert rows(parts.where("kind = 'table'").select("document_id", "pos", "text")) == rows(html.extract_tables(pages))


def flat(spark, items, cites=(), sections=(("b1", "s1", 1), ("b1", "s2", 0)), ids=("b1", "b2")):
    return dict(
        briefs=spark.createDataFrame([(i, "T", None, None, "S-1", None, None, "https://x", "d", None) for i in ids], "brief_id string, title string, generated_at string, company_name string, form_type string, accession_number string, filing_date string, source_url string, disclaimer string, warnings array<string>"),
        snapshot=spark.createDataFrame([("b1", "n", "1.50"), ("b1", "t", '"x \\" y"'), ("b1", "u", None), ("b1", "z", "true")], "brief_id string, key string, value string"),
        sections=spark.createDataFrame([(*s, s[1].upper(), "", ["w"]) for s in sections], "brief_id string, section_id string, section_pos int, title string, summary string, warnings array<string>"),
        items=spark.createDataFrame(list(items), "brief_id string, section_id string, item_pos int, id string, title string, body string, why_it_matters string, confidence string, needs_review boolean"),
        citations=spark.createDataFrame(list(cites), "brief_id string, section_id string, id string, cite_pos int, chunk_id string, cited_section_id string, source_url string, quote string"),
        diagnostics=spark.createDataFrame([("b1", "cards", 2)], "brief_id string, metric string, value long"),
    )


ITEMS = [("b1", "s1", 5, "i1", "One", "b\n\"q\" é", None, "high", True), ("b1", "s1", 2, "i2", "Two", "", "w", "low", False), ("b1", "s1", 5, "i1", "Same id", "x", None, None, None), ("b9", "s1", 1, "lost", "t", "b", None, "high", False)]
CITES = [("b1", "s1", "i2", 9, "c1", None, "https://x", "q"), ("b1", "s1", "i2", 3, "c2", "s", "u", ""), ("b1", "s9", "i2", 1, "lost", None, None, None), ("b1", "s1", "none", 1, "lost", None, None, None)]


def test_nested_briefs_and_back(spark, tmp_path):
    path = str(tmp_path / "briefs")
    briefs.write_briefs(briefs.nest_briefs(**flat(spark, ITEMS, CITES)), path)
    docs = {d["id"]: d for d in (json.loads(r["value"]) for r in spark.read.text(path).collect())}
    assert set(docs) == {"b1", "b2"} and docs["b2"]["sections"] == [] and docs["b2"]["snapshot"] == {} and docs["b2"]["diagnostics"] == {"counts": {}, "warnings": []}
    one = docs["b1"]
    assert one["snapshot"] == {"n": 1.5, "t": 'x " y', "u": None, "z": True} and one["filing"] == {"formType": "S-1", "sourceUrl": "https://x"} and "generatedAt" not in one
    assert [s["id"] for s in one["sections"]] == ["s2", "s1"] and one["sections"][0]["items"] == []
    assert [(i["id"], i["title"], len(i["citations"])) for i in one["sections"][1]["items"]] == [("i2", "Two", 2), ("i1", "One", 0), ("i1", "Same id", 0)]
    assert [c["chunkId"] for c in one["sections"][1]["items"][0]["citations"]] == ["c2", "c1"]
    back = briefs.flatten_briefs(briefs.read_briefs(spark, path))
    rows = lambda name: sorted((tuple(r) for r in back[name].collect()), key=str)
    assert rows("items") == sorted([("b1", "s1", 1, *ITEMS[1][3:]), ("b1", "s1", 2, *ITEMS[0][3:]), ("b1", "s1", 3, *ITEMS[2][3:])], key=str)
    assert rows("citations") == [("b1", "s1", "i2", 1, "c2", "s", "u", ""), ("b1", "s1", "i2", 2, "c1", None, "https://x", "q")]
    assert rows("sections") == [("b1", "s1", 2, "S1", "", ["w"]), ("b1", "s2", 1, "S2", "", ["w"])] and rows("diagnostics") == [("b1", "cards", 2)]
    assert rows("snapshot") == [("b1", "n", "1.5"), ("b1", "t", '"x \\" y"'), ("b1", "u", None), ("b1", "z", "true")] and {r[0] for r in rows("briefs")} == {"b1", "b2"}
    again = briefs.flatten_briefs(briefs.nest_briefs(**back))  # the inverse of an inverse
    assert all(sorted(map(str, again[k].collect())) == sorted(map(str, back[k].collect())) for k in briefs.TABLES)
    assert briefs.nest_briefs(**flat(spark, [], ids=())).count() == 0


def test_nested_violations(spark):
    kind = "id int, tags array<string>, s struct<a: string, xs: array<struct<n: int, m: map<string, string>>>>"
    rows = [(1, ["ok", None, "no"], ("u", [(1, {"k": "http://x"}), (11, {"k": "x", "l": None}), None])), (2, [], (None, [])), (3, None, None), (4, ["ok"], ("", None))]
    spec = {
        "tags": {"required": True, "non_empty": True, "items": {"required": True, "enum": ["ok"]}},
        "s": {"required": True, "fields": {"a": {"required": True, "min_length": 1}, "xs": {"required": True, "non_empty": True, "items": {"required": True, "fields": {"n": {"min": 1, "max": 10}, "m": {"values": {"required": True, "url": True}}}}}}},
    }
    got = sorted(map(tuple, audit.nested_violations(spark.createDataFrame(rows, kind), spec).collect()))
    assert got == sorted([
        (1, "tags[1]", "missing"), (1, "tags[2]", "not in enum"), (1, "s.xs[1].n", "too large"), (1, "s.xs[1].m[k]", "not a URL"), (1, "s.xs[1].m[l]", "missing"), (1, "s.xs[2]", "missing"),
        (2, "tags", "empty list"), (2, "s.a", "missing"), (2, "s.xs", "empty list"), (3, "tags", "missing"), (3, "s", "missing"), (4, "s.a", "too short"), (4, "s.xs", "missing"),
    ])
    plan = audit.nested_violations(spark.createDataFrame(rows, kind), spec)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1
