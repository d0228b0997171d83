"""Rule tagging: ordered rules and needles against text, in one pass and without joins of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources.scratch import bounded

#: Theme keys, and patterns that give old section ids their theme, in this order.
THEMES = ("business", "financials", "risks", "governance", "offering")
LEGACY_THEMES = (
    ("risks", "risk"),
    ("governance", "management|governance|ownership|relationship|relatedperson|capitalstock|director|control"),
    ("offering", "proceeds|underwriting|dilution|capitalization|lockup|shareseligible|offering|prospectus"),
    ("financials", "financ|dividend|debt|liquidity|notes"),
    ("business", "business|operations"),
)


def classify_first_match(c: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first (label, pattern) that matches; null text gets the default."""
    hits = [F.when(T.has(c, "(?i)" + p), F.lit(label)) for label, p in rules]
    return F.coalesce(*hits, F.lit(default))


def theme_for(title: Column, body: Column, rules: list[tuple[str, str]]) -> Column:
    """By the title; by the body only where the title gives `other`."""
    first = classify_first_match(title, rules)
    return F.when(first != "other", first).otherwise(classify_first_match(body, rules))


def specificity(c: Column, entity: str, boilerplate: str) -> Column:
    company = F.coalesce(T.has(c, "(?i)" + entity), F.lit(False))
    return F.when(company & T.has(c, "(?i)" + boilerplate), "mixed").when(company, "company_specific").otherwise("generic")


def resolve_theme(c: Column) -> Column:
    """A theme key passes; an old section id gets its theme by pattern; else null. Idempotent."""
    old = F.coalesce(*[F.when(T.has(c, "(?i)" + p), F.lit(k)) for k, p in LEGACY_THEMES])
    return F.when(c.isin(*THEMES), c).when(F.length(c) > 0, old)


def keyword_candidates(chunks: DataFrame, rules: list[dict], doc: str = "document_id", pos: str = "chunk_pos", text: str = "text", chunk_id: str = "id") -> DataFrame:
    """(doc, rule_pos, n, label, category, chunk id, value_text, source_quote): each document's first k chunks for each rule.

    rules: dicts with label, category, pattern and k, in order. All rules are tried in one pass;
    ids and positions of hits go to the window, whose limit is the largest k so that it holds before
    the shuffle, and the text is joined to those that stay. chunk ids are unique in a document.
    """
    hits = F.filter(F.array(*[F.when(T.has(F.col(text), "(?i)" + r["pattern"]), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    pick = lambda key: F.element_at(F.array(*[F.lit(r[key]) for r in rules]), F.col("rule_pos") + 1)
    rows = chunks.select(doc, pos, chunk_id, F.explode(hits).alias("rule_pos"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(doc, "rule_pos").orderBy(pos))).where(F.col("n") <= max(r["k"] for r in rules))
    kept = bounded(rows.where(F.col("n") <= pick("k")).drop(pos), "candidates")
    found = chunks.select(doc, chunk_id, text).join(kept, [doc, chunk_id])
    return found.select(doc, "rule_pos", "n", pick("label").alias("label"), pick("category").alias("category"), chunk_id, T.excerpt(F.col(text), 450).alias("value_text"), F.substring(T.norm_ws(F.col(text)), 1, 700).alias("source_quote"))


def first_section_hits(sections: DataFrame, chunks: DataFrame, rules: list[dict]) -> DataFrame:
    """(document_id, rule_pos, label, section_id, chunk_id): for each rule the first section whose title key has a needle, with its first chunk; none without a chunk."""
    hit = lambda r: F.coalesce(*[F.when(F.col("normalized_title").contains(T.norm_title(F.lit(n))), True) for n in r["needles"]], F.lit(False))
    found = F.filter(F.array(*[F.when(hit(r), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    rows = sections.withColumn("rule_pos", F.explode(found))
    first = Window.partitionBy("document_id", "rule_pos").orderBy("ord")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("document_id", "rule_pos", F.col("id").alias("section_id"))
    head = chunks.groupBy("section_id").agg(F.min_by("id", "chunk_pos").alias("chunk_id"))
    label = F.element_at(F.array(*[F.lit(r["label"]) for r in rules]), F.col("rule_pos") + 1)
    return rows.join(head, "section_id").select("document_id", "rule_pos", label.alias("label"), "section_id", "chunk_id")


def extract_capture(chunks: DataFrame, gate: str, pattern: str, doc: str = "document_id", pos: str = "chunk_pos", text: str = "text", chunk_id: str = "id") -> DataFrame:
    """(doc, chunk id, value_text, confidence): the first gated chunk's first capture (medium), else an excerpt of 300 (low)."""
    first = Window.partitionBy(doc).orderBy(pos)
    rows = chunks.where(T.has(F.col(text), "(?i)" + gate)).withColumn("n", F.row_number().over(first)).where("n = 1")
    found = F.regexp_extract(F.col(text), T.java("(?i)" + pattern), 1)
    return rows.select(doc, chunk_id, F.when(found != "", found).otherwise(T.excerpt(F.col(text), 300)).alias("value_text"), F.when(found != "", "medium").otherwise("low").alias("confidence"))


def golden_checks(sections: DataFrame, chunks: DataFrame, checks: list[dict]) -> DataFrame:
    """(document_id, check_pos, id, found, matched_id, matched_type, confidence) for every document and check.

    A section title wins (high); else a chunk's title or first 800 characters (medium); else low.
    Documents are those that have a section or a chunk.
    """

    def first_hits(df, cols, order):
        def hit(check):
            tests = [F.coalesce(c.contains(T.norm_title(F.lit(n))), F.lit(False)) for c in cols for n in check["needles"]]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out

        found = F.filter(F.array(*[F.when(hit(k), F.lit(i)) for i, k in enumerate(checks)]), lambda x: x.isNotNull())
        rows = df.withColumn("check_pos", F.explode(found))
        return rows.groupBy("document_id", "check_pos").agg(F.min_by("id", order).alias("hit"))

    in_title = first_hits(sections, [T.norm_title(F.col("title"))], "ord").withColumnRenamed("hit", "s")
    in_chunk = first_hits(chunks, [T.norm_title(F.col("title")), T.norm_title(F.substring("text", 1, 800))], "chunk_pos").withColumnRenamed("hit", "c")
    docs = sections.select("document_id").union(chunks.select("document_id")).distinct()
    every = docs.withColumn("check_pos", F.explode(F.array(*[F.lit(i) for i in range(len(checks))])))
    rows = every.join(in_title, ["document_id", "check_pos"], "left").join(in_chunk, ["document_id", "check_pos"], "left")
    name = F.element_at(F.array(*[F.lit(k["id"]) for k in checks]), F.col("check_pos") + 1)
    hit = F.coalesce("s", "c")
    return rows.select(
        "document_id", "check_pos", name.alias("id"), hit.isNotNull().alias("found"), hit.alias("matched_id"),
        F.when(F.col("s").isNotNull(), "section").when(F.col("c").isNotNull(), "chunk").alias("matched_type"),
        F.when(F.col("s").isNotNull(), "high").when(F.col("c").isNotNull(), "medium").otherwise("low").alias("confidence"),
    )


def coverage_flags(sections: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One row a document: a boolean for each flag, whether any title key holds one of its aliases."""

    def flag(needles):
        out = F.lit(False)
        for n in needles:
            out = out | F.coalesce(F.col("normalized_title").contains(T.norm_title(F.lit(n))), F.lit(False))
        return F.bool_or(out)

    return sections.groupBy("document_id").agg(*[flag(v).alias(k) for k, v in aliases.items()])


def search_chunks(chunks: DataFrame, query: str, limit: int = 12, pos: str = "chunk_pos") -> DataFrame:
    """The first `limit` chunks whose text or title holds the query, whatever its case; an empty query matches all."""
    q = F.lit(query.strip().lower())
    return chunks.where(F.lower("text").contains(q) | F.lower("title").contains(q)).orderBy(pos).limit(limit)


def filter_by_category(df: DataFrame, category: str, column: str = "category") -> DataFrame:
    return df if category == "all" else df.where(F.col(column) == category)


def distinct_categories(df: DataFrame, column: str = "category") -> DataFrame:
    """(pos, category): `all` first, then the distinct values in their order."""
    rows = df.select(F.col(column).alias("category")).where("category is not null").distinct()
    return rows.select(F.lit(1).alias("pos"), "category").union(df.sparkSession.range(1).select(F.lit(0), F.lit("all"))).orderBy("pos", "category")


def section_chunks(chunks: DataFrame, section_id) -> DataFrame:
    return chunks.where(F.col("section_id") == section_id).orderBy("chunk_pos")
