"""Queries of artefacts as they are stored: checked reading, runs that change parts of a store, nested briefs and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import audit as Q
from folioscope.plans import jobs
from folioscope.plans.queries_text import _TINY, FRAGMENT_RULES, LINES, line_head
from folioscope.plans.registry import Tables, dealt, query, ws
from folioscope.sources import briefs as N
from folioscope.sources import html as H
from folioscope.sources import tables as A
from folioscope.sources.scratch import cut, new_path

# --- checked reading ---------------------------------------------------------------------------


def artefact(t: Tables) -> str:
    """Documents as records of JSON arrays of a hundred; some records have a number of the wrong type, some arrays are cut off."""
    d, k = t.documents, F.col("doc_id")
    record = F.concat(F.lit('{"id": '), k, F.lit(', "text": '), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(', "n": '), F.when(k % 7 == 3, F.concat(F.lit('"x'), "n_chars", F.lit('"'))).otherwise(F.col("n_chars").cast("string")), F.lit("}"))
    lines = d.groupBy(F.floor(k / 100).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))), lambda x: x["r"]), ", ").alias("r"))
    whole = F.concat(F.lit("["), "r", F.lit("]"))
    path = new_path(t.spark, "artefact")
    lines.select(F.when(F.col("part") % 5 == 2, F.concat(F.lit("["), F.substring_index("r", '"n"', -1), F.lit(', {"id'))).otherwise(whole).alias("value")).write.text(path)
    return path


_KEPT = "(SELECT * FROM documents WHERE (doc_id // 100) % 5 <> 2)"


@query(f"SELECT doc_id AS id, n_chars AS n, md5(text) AS text_md5 FROM {_KEPT} WHERE doc_id % 7 <> 3")
def a2_read_checked(t):
    rows, _ = A.read_checked(t.spark, artefact(t), "id bigint, text string, n bigint", whole=False)
    return rows.select("id", "n", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT entry, id FROM (SELECT row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS entry, doc_id AS id FROM {_KEPT}) WHERE id % 7 = 3")
def a2_wrong_types(t):
    _, damaged = A.read_checked(t.spark, artefact(t), "id bigint, text string, n bigint", whole=False)
    return damaged.where("problem = 'wrong type'").select(F.col("entry").cast("long").alias("entry"), F.get_json_object("record", "$.id").cast("long").alias("id"))


@query("SELECT CASE WHEN (doc_id // 100) % 5 = 2 THEN 'cut off' ELSE 'wrong type' END AS problem, count(DISTINCT CASE WHEN (doc_id // 100) % 5 = 2 THEN doc_id // 100 ELSE doc_id END) AS n FROM documents WHERE (doc_id // 100) % 5 = 2 OR doc_id % 7 = 3 GROUP BY 1")
def a2_damage_report(t):
    _, damaged = A.read_checked(t.spark, artefact(t), "id bigint, text string, n bigint", whole=False)
    return damaged.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# --- runs over a store ---------------------------------------------------------------------------


def doc_pages(t: Tables):
    """A page for each document, a paragraph for each block that line_blocks() gives."""
    escaped = lambda c: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>\n"))
    html = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.coalesce(escaped(line_head(line, i)), F.lit("")), escaped(line))), "")
    return dealt(t.documents.select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("document_id"), html.alias("html"), F.lit(None).cast("string").alias("url"))


#: Blocks of a page have their white space normalised.
_PAGE_LINES = LINES.replace("lines AS (", "raw AS (") + f", lines AS (SELECT document_id, pos, {ws('text')} AS text FROM raw)"
_materialized = lambda x: x.replace(" AS (", " AS MATERIALIZED (")


@query(f"WITH {_PAGE_LINES} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS pos, 'p' AS tag, text FROM lines WHERE text <> ''")
def b1_regular_blocks(t):
    """Blocks of pages that are all paragraphs, over every document."""
    return H.html_blocks(doc_pages(t)).select("document_id", "pos", "tag", "text")


@query(_TINY.replace(_materialized(LINES), _materialized(_PAGE_LINES)))
def a3_incremental_ingestion(t):
    """Two runs over a store: pages as they were, and then as they are. Some were other, some were missing, some have vanished since."""
    rows, k = cut(doc_pages(t).withColumn("k", F.col("document_id").cast("long")), "pages"), F.col("k")
    pages = rows.drop("k")
    was = rows.where(k % 5 != 2).withColumn("html", F.when(k % 3 == 1, F.concat("html", F.lit("<h2>Old</h2><p>Old words.</p>"))).otherwise(F.col("html")))
    gone = rows.where(k % 4 == 0).withColumn("document_id", F.concat(F.lit("gone-"), "document_id"))
    path, rules = new_path(t.spark, "store"), dict(categories=FRAGMENT_RULES, boilerplate=r"\b(on|die)\b")
    jobs.run_ingestion(was.unionByName(gone).drop("k"), path, {"parser": "1"}, 16, **rules)
    out = jobs.run_ingestion(pages, path, {"parser": "1"}, 16, **rules)
    return out["sections"].select("document_id", "ord", "id", "level", F.length("text").alias("n"))


# --- nested briefs -------------------------------------------------------------------------------

_SECTIONS = ("what-it-does", "financial-snapshot", "key-risk-themes")


def flat_briefs(t: Tables):
    """A brief for every thirty documents, an item for each, two citations for most; one section of each brief is empty."""
    d, k = t.documents, F.col("doc_id")
    brief = F.floor(k / 30)
    base = d.select(brief.alias("brief_id"), "doc_id", "text", F.element_at(F.array(*[F.lit(s) for s in _SECTIONS]), (k % 2 + 1).cast("int")).alias("section_id"))
    ids = base.select("brief_id").distinct()
    briefs = ids.select("brief_id", F.concat(F.lit("Brief "), "brief_id").alias("title"), F.lit("2024-01-01").alias("generated_at"), F.when(F.col("brief_id") % 3 > 0, "A & B <Co>").alias("company_name"), F.lit("S-1").alias("form_type"), F.lit(None).cast("string").alias("accession_number"), F.lit(None).cast("string").alias("filing_date"), F.when(F.col("brief_id") % 4 == 0, "ftp://x").otherwise("https://x/y").alias("source_url"), F.lit("No advice.").alias("disclaimer"), F.array(F.lit("one"), F.lit("two")).alias("warnings"))
    known = F.create_map(F.lit("form"), F.lit('"S-1"'), F.lit("shares"), F.col("brief_id").cast("string"), F.lit("priced"), F.lit("false"), F.lit("date"), F.lit(None).cast("string"))
    snapshot = ids.select("brief_id", F.explode(known).alias("key", "value"))
    secs = ids.select("brief_id", F.posexplode(F.array(*[F.lit(s) for s in _SECTIONS])).alias("section_pos", "section_id")).select("brief_id", "section_id", "section_pos", F.upper("section_id").alias("title"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("warnings"))
    items = base.select("brief_id", "section_id", k.alias("item_pos"), F.concat(F.lit("i"), k).alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), F.when(k % 5 == 0, "It matters.").alias("why_it_matters"), F.when(k % 11 == 0, "sure").otherwise("high").alias("confidence"), (k % 2 == 1).alias("needs_review"))
    cites = base.where("doc_id % 6 > 0").select("brief_id", "section_id", F.concat(F.lit("i"), k).alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("cite_pos"), k.alias("own"), "text")
    cites = cites.select("brief_id", "section_id", "id", "cite_pos", F.concat(F.lit("c"), "own", F.lit("-"), "cite_pos").alias("chunk_id"), F.when(F.col("cite_pos") == 2, F.concat(F.lit("s"), "own")).alias("cited_section_id"), F.when(F.col("own") % 9 == 0, "x y").otherwise("https://x/c").alias("source_url"), F.substring("text", 41, 200).alias("quote"))
    counts = ids.select("brief_id", F.lit("cards").alias("metric"), (F.col("brief_id") * 3).alias("value"))
    return dict(briefs=briefs, snapshot=snapshot, sections=secs, items=items, citations=cites, diagnostics=counts)


_ITEM = "SELECT doc_id // 30 AS brief_id, doc_id, text, CASE doc_id % 2 WHEN 0 THEN 'what-it-does' ELSE 'financial-snapshot' END AS section_id, row_number() OVER (PARTITION BY doc_id // 30, doc_id % 2 ORDER BY doc_id) AS item_pos FROM documents"


@query(f"""WITH i AS ({_ITEM}), b AS (SELECT DISTINCT brief_id FROM i)
 SELECT 'item' AS kind, CAST(brief_id AS VARCHAR) AS brief_id, section_id AS a, item_pos AS pos, 'i' || doc_id AS b, left(text, 80) || '|' || md5(text) || '|' || CASE WHEN doc_id % 5 = 0 THEN 'It matters.' ELSE '' END || '|' || CASE WHEN doc_id % 11 = 0 THEN 'sure' ELSE 'high' END || '|' || CASE WHEN doc_id % 2 = 1 THEN 'true' ELSE 'false' END AS c FROM i
 UNION ALL SELECT 'citation', CAST(brief_id AS VARCHAR), section_id, k, 'i' || doc_id, 'c' || doc_id || '-' || k || '|' || CASE k WHEN 2 THEN 's' || doc_id ELSE '' END || '|' || CASE WHEN doc_id % 9 = 0 THEN 'x y' ELSE 'https://x/c' END || '|' || substr(text, 41, 200) FROM i, range(1, 3) r(k) WHERE doc_id % 6 > 0
 UNION ALL SELECT 'section', CAST(brief_id AS VARCHAR), s, p, upper(s), '' FROM b, (VALUES ('what-it-does', 1), ('financial-snapshot', 2), ('key-risk-themes', 3)) v(s, p)
 UNION ALL SELECT 'snapshot', CAST(brief_id AS VARCHAR), key, 0, coalesce(CASE key WHEN 'form' THEN '"S-1"' WHEN 'shares' THEN CAST(brief_id AS VARCHAR) WHEN 'priced' THEN 'false' END, 'unknown'), '' FROM b, (VALUES ('form'), ('shares'), ('priced'), ('date')) v(key)
 UNION ALL SELECT 'brief', CAST(brief_id AS VARCHAR), 'Brief ' || brief_id, brief_id * 3, CASE WHEN brief_id % 3 > 0 THEN 'A & B <Co>' ELSE '' END, 'one,two' FROM b""")
def a3_brief_json(t):
    """Flat tables of briefs to JSON documents, and these read back to flat tables."""
    path = new_path(t.spark, "briefs")
    N.write_briefs(N.nest_briefs(**flat_briefs(t)), path)
    f = N.flatten_briefs(cut(N.read_briefs(t.spark, path), "nested"))
    text = lambda *cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in cols])
    pick = lambda kind, df, a, pos, b, c: df.select(F.lit(kind).alias("kind"), "brief_id", a.alias("a"), pos.cast("long").alias("pos"), b.alias("b"), c.alias("c"))
    whole = f["briefs"].join(f["diagnostics"], "brief_id")
    return Q.union(
        pick("item", f["items"], F.col("section_id"), F.col("item_pos"), F.col("id"), text("title", F.md5(F.col("body").cast("binary")), "why_it_matters", "confidence", "needs_review")),
        pick("citation", f["citations"], F.col("section_id"), F.col("cite_pos"), F.col("id"), text("chunk_id", "cited_section_id", "source_url", "quote")),
        pick("section", f["sections"], F.col("section_id"), F.col("section_pos"), F.col("title"), F.col("summary")),
        pick("snapshot", f["snapshot"], F.col("key"), F.lit(0), F.coalesce("value", F.lit("unknown")), F.lit("")),
        pick("brief", whole, F.col("title"), F.col("value"), F.coalesce("company_name", F.lit("")), F.array_join("warnings", ",")),
    )


BRIEF_RULES = {
    "title": {"required": True},
    "filing": {"fields": {"companyName": {"required": True}, "sourceUrl": {"required": True, "url": True}}},
    "sections": {"items": {"fields": {
        "items": {"non_empty": True, "items": {"fields": {
            "confidence": {"enum": ["high", "medium", "low"]}, "title": {"min_length": 20},
            "citations": {"non_empty": True, "items": {"fields": {"sectionId": {"required": True}, "sourceUrl": {"url": True}}}},
        }}}}}},
    "diagnostics": {"fields": {"counts": {"values": {"max": 60}}}},
}


@query(f"""WITH i AS (SELECT *, 'sections[' || doc_id % 2 || '].items[' || (item_pos - 1) || ']' AS p FROM ({_ITEM})), b AS (SELECT DISTINCT brief_id FROM i), c AS (SELECT *, p || '.citations[' || (k - 1) || ']' AS q FROM i, range(1, 3) r(k) WHERE doc_id % 6 > 0)
 SELECT CAST(brief_id AS VARCHAR) AS id, p || '.confidence' AS path, 'not in enum' AS violation FROM i WHERE doc_id % 11 = 0 UNION ALL SELECT CAST(brief_id AS VARCHAR), p || '.title', 'too short' FROM i WHERE length(text) < 20
 UNION ALL SELECT CAST(brief_id AS VARCHAR), p || '.citations', 'empty list' FROM i WHERE doc_id % 6 = 0 UNION ALL SELECT CAST(brief_id AS VARCHAR), q || '.sectionId', 'missing' FROM c WHERE k = 1 UNION ALL SELECT CAST(brief_id AS VARCHAR), q || '.sourceUrl', 'not a URL' FROM c WHERE doc_id % 9 = 0
 UNION ALL SELECT CAST(brief_id AS VARCHAR), 'filing.companyName', 'missing' FROM b WHERE brief_id % 3 = 0 UNION ALL SELECT CAST(brief_id AS VARCHAR), 'filing.sourceUrl', 'not a URL' FROM b WHERE brief_id % 4 = 0
 UNION ALL SELECT CAST(brief_id AS VARCHAR), 'sections[' || s || '].items', 'empty list' FROM b, range(0, 3) r(s) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.brief_id = b.brief_id AND i.doc_id % 2 = s) UNION ALL SELECT CAST(brief_id AS VARCHAR), 'diagnostics.counts[cards]', 'too large' FROM b WHERE brief_id * 3 > 60""")
def j1_nested_violations(t):
    return Q.nested_violations(N.nest_briefs(**flat_briefs(t)), BRIEF_RULES)
