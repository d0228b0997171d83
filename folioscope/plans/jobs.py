"""Whole jobs: ingestion of pages, a brief, the forum's feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import audit, brief, evidence, forum, risks, rules, sections
from folioscope.sources import html, tables
from folioscope.sources.scratch import bounded, cut, release, tidy

FLAGSHIP_RULES = [dict(label="articles", category="a", pattern=r"\b(the|der|la)\b", k=3), dict(label="endings", category="b", pattern=r"[a-z]{3}tion\b", k=3)]


def ingest(pages: DataFrame, manifest: DataFrame | None = None, versions: dict[str, str] | None = None, **rules_) -> dict[str, DataFrame]:
    """Tables of the pages that are new or changed: blocks, sections, chunks, tables, risks and run metrics.

    pages: document_id, url, html. A page is parsed once; its parts, the sections and the chunks are
    written to the shared folder, so no later step goes back to the html. rules_: what `risks.extract_risks` asks for.
    """
    tidy(pages.sparkSession)
    if manifest is not None:
        todo = audit.needs_processing(audit.source_hashes(pages), manifest, versions or {})
        pages = pages.join(todo.select("document_id"), "document_id", "left_semi")
    parts = cut(html.page_parts(pages), "parts")
    out = ingest_blocks(parts.where("kind = 'block'").drop("kind"), **rules_)
    found = parts.where("kind = 'table'").select("document_id", F.col("pos").alias("ord"), "text")
    out["tables"] = sections.associate_tables(found, out["sections"])
    out["metrics"] = audit.run_counts("run", {k: v for k, v in out.items() if k != "blocks"})
    return out


def sections_of(blocks: DataFrame, *inputs: DataFrame) -> DataFrame:
    """The written sections of blocks, with parents; inputs: tables of cut() that nothing reads after the blocks are grouped.

    Grouped blocks are written first: parents read them twice.
    """
    grouped = cut(sections.sessionize_sections(sections.mark_headings(blocks.repartition("document_id"))), "grouped")
    release(*inputs)
    found = cut(sections.section_parents(grouped), "sections")
    release(grouped)
    return found


def ingest_blocks(blocks: DataFrame, **rules_) -> dict[str, DataFrame]:
    """Sections, chunks and risks of blocks (document_id, pos, tag, text). One shuffle by document serves all windows."""
    found = sections_of(blocks)
    secs = cut(sections.merge_tiny_sections(found), "sections")
    release(found)
    chunks = cut(sections.chunk_sections(secs), "chunks")
    return {"blocks": blocks, "sections": secs, "chunks": chunks, "risks": risks.extract_risks(chunks, **rules_)}


def run_ingestion(pages: DataFrame, path: str, versions: dict[str, str], buckets: int = 64, force: bool = False, **rules_) -> dict[str, DataFrame]:
    """Bring the tables at path up to date with all current pages; the stored tables, the manifest and run metrics.

    Only pages that are new, changed, or made by other extractor versions are parsed. Documents that
    have vanished lose their rows, all others keep theirs. The manifest (document_id, sha256,
    size_bytes, versions) is written last, so a run that stopped is made good by the next. A
    document_id stands for one page; pages must not repeat it.
    """
    spark = pages.sparkSession
    tidy(spark)
    hashes = cut(audit.source_hashes(pages.withColumn("document_id", F.col("document_id").cast("string"))), "hashes")
    manifest = tables.read_table(spark, f"{path}/manifest", schemas.MANIFEST)
    todo = cut(audit.needs_processing(hashes, manifest, versions, force).select("document_id"), "todo")
    gone = cut(manifest.select("document_id").join(hashes.select("document_id"), "document_id", "left_anti"), "gone")
    if not (todo.isEmpty() and gone.isEmpty()):
        replaced = cut(todo.union(gone), "replaced")
        changed = pages.withColumn("document_id", F.col("document_id").cast("string")).join(bounded(todo), "document_id", "left_semi")
        merge = lambda name, df: tables.merge_artifacts({name: df}, path, replaced, buckets)
        # each table is made from the stored one before it, so no other copy of the texts is kept
        own = lambda name: tables.stored_artifacts(spark, path)[name].drop("bucket").join(bounded(todo), "document_id", "left_semi")
        parts = cut(html.page_parts(changed), "parts")
        listed = cut(parts.where("kind = 'table'").select("document_id", F.col("pos").alias("ord"), "text"), "tables")
        found = sections_of(parts.where("kind = 'block'").drop("kind"), parts)
        merge("sections", sections.merge_tiny_sections(found))
        release(found)
        merge("tables", sections.associate_tables(listed, own("sections")))
        release(listed)
        merge("chunks", sections.chunk_sections(own("sections")))
        merge("risks", risks.extract_risks(own("chunks"), **rules_))
        made = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]) if versions else F.create_map().cast("map<string,string>")
        new = hashes.join(todo, "document_id", "left_semi").withColumn("versions", made)
        kept = manifest.join(todo.union(gone), "document_id", "left_anti").select(new.columns)
        cut(kept.unionByName(new), "manifest").write.mode("overwrite").parquet(f"{path}/manifest")
    stored = tables.stored_artifacts(spark, path)
    return {k: df.drop("bucket") for k, df in stored.items()} | {"manifest": tables.read_table(spark, f"{path}/manifest", schemas.MANIFEST), "metrics": audit.run_counts("run", stored or {"documents": hashes})}


def build_brief(chunks: DataFrame, found: DataFrame, policy: DataFrame, themes: list[tuple[str, str]], entities: str, drafts: DataFrame | None = None, **tables) -> dict[str, DataFrame]:
    """Accepted cards, rejected drafts and brief items; drafts: people's draft cards, as an input table; tables: subjects and reasons of `brief.risk_cards`."""
    cards, rejected = brief.risk_cards(found, chunks, policy, themes, entities, **tables)
    if drafts is not None:
        more, no = evidence.evidence_gate(drafts, chunks, policy)
        cards, rejected = cards.unionByName(more), rejected.unionByName(no)
    cards = cards.join(chunks.select(F.element_at(F.array("id"), 1).alias("_c"), F.col("document_id").alias("brief_id")), F.col("source_chunk_ids")[0] == F.col("_c")).drop("_c")
    return {"cards": cards, "rejected": rejected, "items": brief.assemble_brief(cards)}


def forum_feed(threads: DataFrame, profiles: DataFrame, votes: DataFrame, post_events: DataFrame, limit: int = 25) -> DataFrame:
    """The first page by score of visible threads with counters, author and theme."""
    rows = forum.apply_counters(threads, votes, post_events)
    rows = forum.thread_list(rows, profiles).withColumn("theme", rules.resolve_theme(F.col("section_id")))
    return forum.thread_page(rows, "score", None, limit).select("id", "score", "reply_count", "author_handle", "theme", "created_at", "has_more")


def flagship(chunks: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """(label, facts, sources, verified): keyword facts of each document, with their quotes checked against the chunks as they are now."""
    facts = rules.keyword_candidates(chunks, FLAGSHIP_RULES)
    records = facts.select(F.concat_ws("-", "id", "rule_pos").alias("id"), F.array("id").alias("source_chunk_ids"), "source_quote")
    bad = evidence.verify_quotes(records, chunks if now is None else now)
    rows = facts.withColumn("fact_id", F.concat_ws("-", "id", "rule_pos")).join(bad.select(F.col("id").alias("fact_id")).distinct().withColumn("bad", F.lit(1)), "fact_id", "left")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("document_id").alias("sources"), F.count_if(F.col("bad").isNull()).alias("verified"))
