"""Blocks to sections to chunks. All windows share one partitioning by document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import find
from folioscope.functions import text as T
from folioscope.sources.scratch import bounded, cut

#: Title keys that make a major section.
MAJOR = r"^prospectus summary$|^summary$|^risk factors$|^use of proceeds$|^dividend policy$|^capitalization$|^dilution$|^selected financial data$|^summary financial data$|^managements discussion and analysis|^business$|^management$|^principal stockholders$|^certain relationships and related|^description of capital stock$|^shares eligible for future sale$|^material us federal income tax|^underwriting$"
PREAMBLE = "Document Preamble"


def mark_headings(blocks: DataFrame, major: str = MAJOR) -> DataFrame:
    """blocks with is_heading and level.

    A heading is an h-tag, or 3 to 180 characters that are a major title, an item or part number,
    or capitals with four ASCII letters. Level: from the tag, else 1 for major titles and items, else 2;
    null where there is no heading. Blocks that are too long for one are not tried on.
    """
    # each step is a projection of its own, so that no test spells out another's expression again
    rows = blocks.withColumn("_clean", T.norm_ws(F.col("text")))
    clean, tag = F.col("_clean"), F.coalesce(F.col("tag").rlike("^h"), F.lit(False))
    rows = rows.withColumn("_key", F.when(tag | (F.length(clean) <= 180), T.key_of_clean(clean)))
    rows = rows.withColumn("_major", F.coalesce(F.col("_key").rlike(major), F.lit(False)))
    letters = F.regexp_replace(clean, "[^A-Za-z]", "")
    item = T.has(clean, r"(?i)^item\s+\d+[a-z]?\.?\s+")
    by_text = F.length(clean).between(3, 180) & (F.col("_major") | item | T.has(clean, r"(?i)^part\s+[ivx]+") | ((clean == F.upper(clean)) & (F.length(letters) >= 4)))
    rows = rows.withColumn("is_heading", tag | F.coalesce(by_text, F.lit(False)))
    number = F.expr("nullif(try_cast(replace(tag, 'h', '') AS INT), 0)")
    level = F.coalesce(F.when(tag, number), F.when(F.col("_major") | T.has(F.col("text"), r"(?i)^item\s+\d+"), 1).otherwise(2))
    return rows.withColumn("level", F.when(F.col("is_heading"), level)).drop("_clean", "_key", "_major")


def sessionize_sections(blocks: DataFrame) -> DataFrame:
    """(document_id, ord, id, title, normalized_title, level, text, source_anchor) from marked blocks.

    A heading opens a section, later blocks join its text. What comes before the first heading is
    section 0, kept only if it has text. Empty and null blocks are skipped. anchor is optional.
    """
    rows = blocks.where(T.is_not_blank(F.col("text")))
    if "anchor" not in rows.columns:
        rows = rows.withColumn("anchor", F.lit(None).cast("string"))
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ord", F.sum(F.col("is_heading").cast("int")).over(w).cast("int"))
    head = lambda c: F.min_by(F.when(F.col("is_heading"), c), F.when(F.col("is_heading"), F.col("pos")))
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "text"))))
    out = rows.groupBy("document_id", "ord").agg(head(F.col("text")).alias("title"), head(F.col("level")).alias("level"), head(F.col("anchor")).alias("source_anchor"), parts.alias("parts"))
    text = T.norm_ws(F.array_join(F.col("parts.text"), " "))
    title = F.coalesce("title", F.lit(PREAMBLE))
    own = F.when(F.col("ord") == 0, "section-document-preamble").otherwise(T.stable_id("section", F.col("ord"), T.slugify(title)))
    return out.select("document_id", "ord", own.alias("id"), title.alias("title"), T.norm_title(title).alias("normalized_title"), F.coalesce("level", F.lit(1)).alias("level"), text.alias("text"), "source_anchor")


#: Places (ord) of a document that one window looks at; what comes before is carried from block to block.
BLOCK = 4096


def _by_block():
    return Window.partitionBy("document_id").orderBy("_block")


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows with the columns that carried has for their block; a first block carries nothing and has none."""
    later = carried.where("_block > 0").withColumnsRenamed({"document_id": "_d", "_block": "_k"})
    return rows.join(bounded(later, "carried"), F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_k")), "left").drop("_d", "_k")


def section_parents(sections: DataFrame, max_level: int = 6, block: int = BLOCK) -> DataFrame:
    """sections with parent_id: the nearest earlier section of a lower level in the document.

    Windows are a document's blocks of `block` places; each level's last section is carried over them by one row
    a block. A null document is a document.
    """
    rows = sections.withColumn("_block", F.floor(F.col("ord") / block))
    own = {k: F.when(F.col("level") == k, F.struct("ord", "id")) for k in range(1, max_level)}
    ends = rows.select("document_id", "_block", "ord", "id", "level").groupBy("document_id", "_block").agg(*[F.max(c).alias(f"_e{k}") for k, c in own.items()])
    earlier = _by_block().rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("document_id", "_block", *[F.max(f"_e{k}").over(earlier).alias(f"_c{k}") for k in own])
    before = Window.partitionBy("document_id", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_p{k}": F.last(c, ignorenulls=True).over(before) for k, c in own.items()})
    rows = _with_carried(rows, ends)
    lower = [F.when(F.col("level") > k, F.coalesce(f"_p{k}", f"_c{k}")) for k in own]
    return rows.withColumn("parent_id", F.greatest(*lower)["id"]).drop("_block", *[f"_{x}{k}" for k in own for x in "pc"])


def merge_tiny_sections(sections: DataFrame, min_len: int = 120, major: str = MAJOR, block: int = BLOCK) -> DataFrame:
    """Sections after folding short, deeper, non-major ones into the last kept; ord renumbered from 0.

    A section that is long or major is kept. A short one is kept if its level is not over that of the last kept,
    which after a long or major section only falls: so it is kept where its level is at most the least since that
    section. That is a prefix minimum in segments, found in blocks of `block` places with one row a
    block carried on, over lengths and levels alone; texts join back. What is folded into one section is put together in one task.
    """
    keys = sections.select("document_id", "ord", "level", (F.coalesce(F.length("text") >= min_len, F.lit(True)) | F.coalesce(F.col("normalized_title").rlike(major), F.lit(False))).alias("_firm"), F.floor(F.col("ord") / block).alias("_block"))
    upto = Window.partitionBy("document_id", "_block").orderBy("ord")
    rows = keys.withColumn("_seg", F.sum(F.col("_firm").cast("int")).over(upto))
    segment = Window.partitionBy("document_id", "_block", "_seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_least", F.min("level").over(segment))
    # a block's least level since its last firm section, or of all of it; blocks with one start a segment of blocks
    ends = rows.groupBy("document_id", "_block").agg(F.max("_seg").alias("_n"), F.min_by("level", F.struct(-F.col("_seg"), F.col("level"))).alias("_low"))
    ends = ends.withColumn("_run", F.sum((F.col("_n") > 0).cast("int")).over(_by_block()))
    ends = ends.withColumn("_after", F.min("_low").over(Window.partitionBy("document_id", "_run").orderBy("_block")))
    ends = ends.select("document_id", "_block", F.lag("_after").over(_by_block()).alias("_carry"))
    rows = _with_carried(rows, ends)
    least = F.when(F.col("_seg") == 0, F.least("_carry", "_least")).otherwise(F.col("_least"))
    rows = rows.withColumn("_kept", F.col("_firm") | F.coalesce(F.col("level") <= least, F.lit(True))).select("document_id", "_block", "ord", "_kept")
    rows = cut(rows, "kept")
    kept = F.when(F.col("_kept"), F.col("ord"))
    ends = rows.groupBy("document_id", "_block").agg(F.max(kept).alias("_last"), F.count(kept).alias("_held"))
    earlier = _by_block().rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("document_id", "_block", F.max("_last").over(earlier).alias("_into"), F.sum("_held").over(earlier).alias("_before"))
    rows = _with_carried(rows.withColumns({"_own": F.last(kept, ignorenulls=True).over(upto), "_n": F.count(kept).over(upto)}), ends)
    target = rows.select(F.col("document_id").alias("_d"), F.col("ord").alias("_o"), F.coalesce("_own", "_into").alias("into"), (F.coalesce("_before", F.lit(0)) + F.col("_n") - 1).cast("int").alias("_new"))
    rows = sections.join(target, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("ord") == F.col("_o"))).drop("_d", "_o")
    part = F.when(F.col("ord") == F.col("into"), F.col("text")).otherwise(F.concat_ws("\n", "title", "text"))
    others = [c for c in sections.columns if c not in ("document_id", "ord", "text")]
    own = F.max_by(F.struct("_new", *others), F.when(F.col("ord") == F.col("into"), 1))
    out = rows.groupBy("document_id", "into").agg(own.alias("_s"), F.array_sort(F.collect_list(F.struct("ord", part.alias("text")))).alias("parts"))
    text = T.norm_ws(F.array_join(F.col("parts.text"), " "))
    out = out.select("document_id", F.col("_s._new").alias("ord"), *[F.col(f"_s.{c}").alias(c) for c in others], text.alias("text"))
    return out.select(sections.columns)


def dangling_parents(sections: DataFrame) -> DataFrame:
    """(document_id, id, parent_id) whose parent was merged away."""
    ids = sections.select("document_id", F.col("id").alias("parent_id"))
    return sections.where("parent_id is not null").join(ids, ["document_id", "parent_id"], "left_anti").select("document_id", "id", "parent_id")


#: A literal dot first, which the matcher looks for fast.
_SENTENCE_END = re.compile(r"\. +(?=[A-Z(])")


def pack(text: str, max_chars: int) -> list[str]:
    """Sentences packed greedily; a sentence over the limit stays whole."""
    if len(text) < max_chars and "  " not in text:
        return [text.strip()] if text.strip() else []
    ends = [m.span() for m in _SENTENCE_END.finditer(text)]
    sentences = [text[a:b] for a, b in zip([0, *[b for _, b in ends]], [*[a + 1 for a, _ in ends], len(text)], strict=True)]
    out, buffer = [], ""
    for sentence in sentences:
        if len(buffer) + 1 + len(sentence) > max_chars and buffer.strip():
            out.append(buffer.strip())
            buffer = ""
        buffer += " " + sentence
    if buffer.strip():
        out.append(buffer.strip())
    return out


def chunk_type(title: Column) -> Column:
    key = T.norm_title(title)
    return F.when(key.contains("risk factors"), "risk_factor").when(key.contains("financial") | key.contains("capitalization"), "financial_statement").otherwise("narrative")


def chunk_sections(sections: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(id, section_id, document_id, chunk_pos, part, chunk_type, title, text, token_estimate, source_url, citation_label).

    Sentences end at a dot before a capital or bracket. An empty section has no chunk. chunk_pos
    orders chunks within the document.
    """

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack(t, max_chars) if t else [])

    url = F.col("source_url") if "source_url" in sections.columns else F.lit(None).cast("string")
    rows = sections.select("document_id", "ord", "id", "title", url.alias("source_url"), F.posexplode(split(T.norm_ws(F.col("text")))).alias("k", "text"))
    part = F.col("k") + 1
    label = F.concat(F.when(F.col("title") != "", F.col("title")).otherwise("Untitled section"), F.lit(" ("), "document_id", F.lit(", section "), "ord", F.lit("), chunk "), part, F.lit(': "'), T.excerpt_of_clean(F.col("text"), 140), F.lit('"'))
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "k")) - 1
    return rows.select(
        T.stable_id("chunk", F.col("id"), part).alias("id"), F.col("id").alias("section_id"), "document_id", pos.cast("int").alias("chunk_pos"), part.alias("part"), chunk_type(F.col("title")).alias("chunk_type"),
        "title", "text", T.tokens_of_clean(F.col("text")).alias("token_estimate"), "source_url", label.alias("citation_label"),
    )


def pick_main_document(docs: DataFrame, known: str = r"^$", package: str = "package_id") -> DataFrame:
    """Each package's main document: exact S-1 type in HTML, else a type containing it, else a known file name."""
    html = T.has(F.col("filename"), r"(?i)\.html?$")
    rank = F.when(T.has(F.col("type"), "(?i)^s-?1$") & html, 1).when(T.has(F.col("type"), "(?i)s-?1") & html, 2).when(T.has(F.col("filename"), "(?i)" + known), 3)
    rows = docs.withColumn("rank", rank).where("rank is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(package).orderBy("rank", "sequence"))).where("n = 1").drop("rank", "n")


def section_label(df: DataFrame, titles: DataFrame, column: str = "id") -> DataFrame:
    """df with label: the known title (titles: slug, title) of a section or chunk id, else its words in title case."""
    c = F.col(column)
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)^section-\d+-?", ""), r"(?i)^chunk-section\d+", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(bare, r"-\d+$", ""), "[-_]", ""))
    words = T.norm_ws(F.regexp_replace(F.regexp_replace(bare, "[-_]", " "), "([a-z])([A-Z])", "$1 $2"))
    spelled = F.array_join(F.transform(F.split(words, " "), T.capitalized), " ")
    known = titles.select(F.col("slug").alias("_slug"), F.col("title").alias("_title"))
    rows = df.withColumn("_slug", slug).join(known, "_slug", "left")
    return rows.withColumn("label", F.coalesce("_title", F.when(words == "", "Filing source").otherwise(spelled))).drop("_slug", "_title")


def associate_tables(tables: DataFrame, sections: DataFrame, prefix: int = 80) -> DataFrame:
    """tables with section_id: the document's first section whose text holds the table's first characters, else null.

    Distinct first characters are looked for in each section once (`find.found_in`), and a section gives those it holds, so the work
    grows with the texts, however many sections share words. An empty table is in the first section.
    """
    rows = tables.drop("section_id").withColumn("_head", F.substring("text", 1, prefix))
    heads = cut(rows.select("document_id", F.col("_head").alias("needle")).where("document_id IS NOT NULL AND needle IS NOT NULL").distinct(), "heads")
    hits = find.found_in(sections.select("document_id", F.col("ord").alias("section_ord"), F.col("id").alias("section_id"), "text"), heads, "document_id", prefix)
    first = hits.groupBy("document_id", F.col("needle").alias("_head")).agg(F.min_by("section_id", "section_ord").alias("section_id"))
    others = [c for c in rows.columns if c not in ("document_id", "ord", "_head")]
    return rows.join(first, ["document_id", "_head"], "left").select("document_id", "ord", *others, "section_id")
