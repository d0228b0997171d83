"""Briefs as nested JSON documents, and back to flat tables.

A document holds one brief: filing, snapshot, sections of items of citations, diagnostics. Lists are
sorted by position columns before they are nested, so row order never decides a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and types of a brief's document.
CITATION = "STRUCT<chunkId: STRING, sectionId: STRING, sourceUrl: STRING, quote: STRING>"
ITEM = f"STRUCT<id: STRING, title: STRING, body: STRING, whyItMatters: STRING, confidence: STRING, needsReview: BOOLEAN, citations: ARRAY<{CITATION}>>"
SECTION = f"STRUCT<id: STRING, title: STRING, summary: STRING, items: ARRAY<{ITEM}>, warnings: ARRAY<STRING>>"
FILING = "STRUCT<companyName: STRING, formType: STRING, accessionNumber: STRING, filingDate: STRING, sourceUrl: STRING>"
BRIEF = f"id STRING, title STRING, generatedAt STRING, filing {FILING}, disclaimer STRING, snapshot MAP<STRING, VARIANT>, sections ARRAY<{SECTION}>, diagnostics STRUCT<counts: MAP<STRING, BIGINT>, warnings: ARRAY<STRING>>"
TABLES = ("briefs", "snapshot", "sections", "items", "citations", "diagnostics")


def nest_briefs(briefs: DataFrame, snapshot: DataFrame, sections: DataFrame, items: DataFrame, citations: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One nested row a brief, with the columns of BRIEF.

    briefs: brief_id, title, generated_at, company_name, form_type, accession_number, filing_date,
    source_url, disclaimer, warnings. snapshot: brief_id, key, value (a JSON literal; null: unknown). sections: brief_id,
    section_id, section_pos, title, summary, warnings. items: brief_id, section_id, item_pos, id, title, body,
    why_it_matters, confidence, needs_review. citations: brief_id, section_id, id (the item's), cite_pos, chunk_id, cited_section_id,
    source_url, quote. diagnostics: brief_id, metric, value. Items and citations of no section or item have no
    place and are left out; sections without items, and items without citations, have empty lists.
    Positions order lists and are not kept: reading back numbers them from 1. A brief is one value, so
    it must fit a task. A repeated snapshot key or metric is an error.
    """
    kinds = {
        "item": F.struct("item_pos", F.struct("id", "title", "body", F.col("why_it_matters").alias("whyItMatters"), "confidence", F.col("needs_review").alias("needsReview")).alias("x")),
        "cite": F.struct("cite_pos", F.struct(F.col("chunk_id").alias("chunkId"), F.col("cited_section_id").alias("sectionId"), F.col("source_url").alias("sourceUrl"), "quote").alias("x")),
        "section": F.struct("section_pos", "title", "summary", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")),
        "head": F.struct("title", "generated_at", F.struct(F.col("company_name").alias("companyName"), F.col("form_type").alias("formType"), F.col("accession_number").alias("accessionNumber"), F.col("filing_date").alias("filingDate"), F.col("source_url").alias("sourceUrl")).alias("filing"), "disclaimer", "warnings"),
        "snap": F.struct("key", "value"), "count": F.struct("metric", F.col("value").cast("long").alias("value")),
    }
    parts = []
    for df, kind, keys in ((items, "item", ("section_id", "id")), (citations, "cite", ("section_id", "id")), (sections, "section", ("section_id",)), (briefs, "head", ()), (snapshot, "snap", ()), (diagnostics, "count", ())):
        parts.append(df.select("brief_id", *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("section_id", "id")], kinds[kind].alias(kind)))
    # dealt by brief once; all three groupings keep to that, so a text is shuffled once
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("brief_id")
    listed = lambda *names: [F.collect_list(n).alias(n) for n in names]
    joined = lambda *names: [F.flatten(F.collect_list(n)).alias(n) for n in names]
    rows = rows.groupBy("brief_id", "section_id", "id").agg(*listed(*kinds))
    cites = F.transform(F.array_sort("cite"), lambda c: c["x"])
    item = lambda i: F.struct(i["item_pos"], F.struct(*[i["x"][c].alias(c) for c in ("id", "title", "body", "whyItMatters", "confidence", "needsReview")], cites.alias("citations")).alias("x"))
    rows = rows.withColumn("item", F.transform("item", item)).groupBy("brief_id", "section_id").agg(*joined("item", "section", "head", "snap", "count"))
    held = F.transform(F.array_sort("item"), lambda i: i["x"])
    section = lambda s: F.struct(s["section_pos"], F.struct(F.col("section_id").alias("id"), s["title"].alias("title"), s["summary"].alias("summary"), held.alias("items"), s["warnings"].alias("warnings")).alias("x"))
    rows = rows.withColumn("section", F.transform("section", section)).groupBy("brief_id").agg(*joined("section", "head", "snap", "count"))
    snap = F.map_from_entries(F.transform(F.array_sort("snap"), lambda e: F.struct(e["key"], F.parse_json(F.coalesce(e["value"], F.lit("null"))))))
    return rows.withColumn("head", F.explode("head")).select(
        F.col("brief_id").cast("string").alias("id"), "head.title", F.col("head.generated_at").alias("generatedAt"), "head.filing", "head.disclaimer", snap.alias("snapshot"),
        F.transform(F.array_sort("section"), lambda s: s["x"]).alias("sections"), F.struct(F.map_from_entries(F.array_sort("count")).alias("counts"), F.coalesce("head.warnings", F.array().cast("array<string>")).alias("warnings")).alias("diagnostics"),
    )


def write_briefs(nested: DataFrame, path: str) -> None:
    """A JSON document a line, compressed; absent optional fields are left out."""
    nested.write.mode("overwrite").json(path, compression="gzip")


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    """The documents that write_briefs wrote; a damaged one stops the job."""
    return spark.read.schema(BRIEF).json(path, mode="FAILFAST")


def flatten_briefs(nested: DataFrame) -> dict[str, DataFrame]:
    """The tables that nest_briefs takes, by its parameters' names: its inverse, with positions from 1."""
    own = F.col("id").alias("brief_id")
    filing = [F.col(f"filing.{a}").alias(b) for a, b in (("companyName", "company_name"), ("formType", "form_type"), ("accessionNumber", "accession_number"), ("filingDate", "filing_date"), ("sourceUrl", "source_url"))]
    secs = nested.select(own, F.posexplode("sections").alias("pos", "s"))
    items = secs.select("brief_id", F.col("s.id").alias("section_id"), F.posexplode("s.items").alias("pos", "i"))
    cites = items.select("brief_id", "section_id", F.col("i.id").alias("id"), F.posexplode("i.citations").alias("pos", "c"))
    return {
        "briefs": nested.select(own, "title", F.col("generatedAt").alias("generated_at"), *filing, "disclaimer", F.col("diagnostics.warnings").alias("warnings")),
        "snapshot": nested.select(own, F.explode("snapshot").alias("key", "v")).select("brief_id", "key", F.nullif(F.to_json("v"), F.lit("null")).alias("value")),
        "sections": secs.select("brief_id", F.col("s.id").alias("section_id"), (F.col("pos") + 1).alias("section_pos"), "s.title", "s.summary", "s.warnings"),
        "items": items.select("brief_id", "section_id", (F.col("pos") + 1).alias("item_pos"), "i.id", "i.title", "i.body", F.col("i.whyItMatters").alias("why_it_matters"), "i.confidence", F.col("i.needsReview").alias("needs_review")),
        "citations": cites.select("brief_id", "section_id", "id", (F.col("pos") + 1).alias("cite_pos"), F.col("c.chunkId").alias("chunk_id"), F.col("c.sectionId").alias("cited_section_id"), F.col("c.sourceUrl").alias("source_url"), "c.quote"),
        "diagnostics": nested.select(own, F.explode("diagnostics.counts").alias("metric", "value")),
    }
