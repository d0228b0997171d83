"""Quotes and citations: windows, verification, the evidence gate."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources.scratch import bounded

#: How far a quote reaches around its needle.
LEAD, REACH = 140, 760
WEAK_TITLES = ("document preamble", "table of contents", "glossary of terms", "index to financial statements", "under the securities act of 1933")
_S = re.compile(T.PY_SPACE)


def _ends_sentence(text: str, i: int) -> bool:
    """A terminator before white space or the end, but not within a dotted leader."""
    return text[i] in ".!?" and (i == 0 or text[i - 1] != ".") and (i + 1 >= len(text) or bool(_S.match(text[i + 1])))


def window(text: str, needle: str, reach: int = REACH) -> str:
    """The text around the needle, from a sentence or word start to a sentence or word end."""
    at = text.lower().find(needle.lower())
    if at < 0:
        return text[:reach]
    past = at + len(needle)
    floor, ceil = max(0, at - LEAD), min(len(text), max(past, at + reach))
    start = next((i + 1 for i in range(at - 1, floor, -1) if _ends_sentence(text, i)), None)
    if start is None:
        start = floor
        if start and not _S.match(text[start - 1]):
            while start < at and not _S.match(text[start]):
                start += 1
        else:
            return text[start : _tail(text, past, ceil)]
    while start < at and _S.match(text[start]):
        start += 1
    return text[start : _tail(text, past, ceil)]


def _tail(text: str, past: int, ceil: int) -> int:
    least = past + (ceil - past) // 2
    for i in range(ceil - 1, least - 1, -1):
        if _ends_sentence(text, i):
            return i + 1
    end = ceil
    if end < len(text) and not _S.match(text[end]):
        while end > past and not _S.match(text[end - 1]):
            end -= 1
    return end


def quote_window(text: Column, needle: Column, reach: int = REACH) -> Column:
    """The needle with its surroundings, made readable; the head of the text where it isn't found."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or n is None else window(t, n, reach) for t, n in zip(texts, needles, strict=True)])

    return T.prettify_quote(T.norm_ws(cut(text, needle)))


def citations(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """(card id, chunk_id, section_id, source_url, quote) of each cited chunk that exists."""
    cited = cards.select("id", F.posexplode("source_chunk_ids").alias("cite_pos", "chunk_id"), F.col("source_section_id").alias("section_id"), F.col("source_quote").alias("quote"))
    return cited.join(chunks.select(F.col("id").alias("chunk_id"), "source_url"), "chunk_id").select("id", "cite_pos", "chunk_id", "section_id", "source_url", "quote")


def cited_chunks(chunks: DataFrame, cited: DataFrame) -> DataFrame:
    """The chunks whose id is in cited (chunk_id), found before any of their text is worked on or shuffled."""
    return chunks.join(bounded(cited.select(F.col("chunk_id").alias("id")).distinct()), "id", "left_semi")


def verify_quotes(records: DataFrame, chunks: DataFrame, mode: str = "exact", severity: str = "error") -> DataFrame:
    """(severity, check, id, chunk_id) of citations that fail.

    records: id, source_chunk_ids, source_quote. A missing chunk is an error; a quote outside its
    chunk has the given severity. exact compares normalised white space and passes empty quotes,
    signature compares letters and digits. A chunk whose text is null is there, but has no quote
    compared. Equal (chunk, quote) pairs are checked once, and only chunks that are cited are read on.
    """
    cited = records.select("id", F.explode("source_chunk_ids").alias("chunk_id"), "source_quote").distinct()
    pairs = cited.select("chunk_id", "source_quote").distinct()
    there = cited_chunks(chunks, pairs.select("chunk_id")).select(F.col("id").alias("chunk_id"), (T.norm_ws(F.col("text")) if mode == "exact" else T.alnum_signature(F.col("text"))).alias("have"), F.lit(True).alias("there"))
    want = T.norm_ws(F.col("source_quote")) if mode == "exact" else T.alnum_signature(F.col("source_quote"))
    checked = pairs.join(there, "chunk_id", "left").select("chunk_id", "source_quote", F.when(F.col("there").isNull(), "missing_chunk").when(~F.col("have").contains(F.coalesce(want, F.lit(""))), "bad_quote").alias("check"))
    bad = checked.where("check is not null").select(F.col("chunk_id").alias("_c"), F.col("source_quote").alias("_q"), "check")
    rows = cited.join(bad, (F.col("chunk_id") == F.col("_c")) & F.col("source_quote").eqNullSafe(F.col("_q")))
    return rows.select(F.when(F.col("check") == "missing_chunk", "error").otherwise(severity).alias("severity"), "check", "id", "chunk_id")


def evidence_gate(drafts: DataFrame, chunks: DataFrame, policy: DataFrame, weak_titles: tuple[str, ...] = WEAK_TITLES) -> tuple[DataFrame, DataFrame]:
    """(accepted cards, rejected rows) of drafts.

    policy: topic, allowed_titles; a draft's own allowed_titles and required_terms come first. A
    missing chunk is the only reason given where it holds; other reasons add up, in order.
    """
    there = cited_chunks(chunks, drafts).select(F.col("id").alias("chunk_id"), F.col("section_id").alias("source_section_id"), F.col("title").alias("chunk_title"), F.col("text").alias("chunk_text"))
    rows = drafts.join(there, "chunk_id", "left").join(F.broadcast(policy.withColumnRenamed("allowed_titles", "_allowed")), "topic", "left")
    rows = rows.withColumn("id", T.stable_id("evidence", F.col("topic"), F.col("title"))).withColumn("source_quote", quote_window(F.col("chunk_text"), F.col("quote_needle")))
    key = T.norm_title(F.col("chunk_title"))
    weak = F.lit(False)
    for t in weak_titles:
        weak = weak | key.contains(T.norm_title(F.lit(t)))
    allowed = F.exists(F.coalesce("allowed_titles", "_allowed", F.array().cast("array<string>")), lambda t: T.norm_title(t) == key)
    lower = F.lower(T.norm_ws(F.col("source_quote")))
    terms = F.filter(F.coalesce("required_terms", F.array("quote_needle")), lambda t: ~lower.contains(F.lower(t)))
    reasons = F.concat(
        F.array_compact(F.array(F.when(weak, F.concat(F.lit("Weak citation section: "), "chunk_title", F.lit("."))), F.when(~allowed, F.concat(F.lit('Source section "'), "chunk_title", F.lit('" is not allowed for '), "topic", F.lit("."))))),
        F.transform(terms, lambda t: F.concat(F.lit('Source quote does not contain required term "'), t, F.lit('".'))),
        F.array_compact(F.array(
            F.when(T.has_parser_language(F.concat_ws(" ", "title", "plain_english")), "Parser diagnostic or candidate language is not allowed in evidence cards."),
            F.when(~T.is_source_excerpt(F.col("chunk_text"), F.col("source_quote")), "Source quote is not an exact source chunk excerpt."),
        )),
    )
    rows = rows.withColumn("reasons", F.when(F.col("chunk_text").isNull(), F.array(F.lit("Source chunk not found."))).otherwise(reasons))
    accepted = rows.where("size(reasons) = 0").select(
        "id", F.col("draft_pos").alias("card_pos"), "topic", "title", "source_section_id", F.array("chunk_id").alias("source_chunk_ids"), "source_quote", "extracted_text", "plain_english", "why_it_matters",
        F.coalesce("confidence", F.lit("high")).alias("confidence"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), "extraction_method", F.array().cast("array<string>").alias("quality_warnings"),
    )
    return accepted, rows.where("size(reasons) > 0").select("id", "topic", "title", F.array("chunk_id").alias("source_chunk_ids"), "reasons")


def unbacked_figures(cards: DataFrame) -> DataFrame:
    """(id, figure): digits of dollar amounts in a card's prose that its quote's digits lack."""
    prose = F.concat_ws(" ", "title", "plain_english")
    found = F.regexp_extract_all(prose, F.lit(T.java(r"\$\s?\d[\d,]*(?:\.\d+)?\s*(?:million|billion)?")), F.lit(0))
    digits = F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda d: F.length(d) >= 2))
    quote = F.regexp_replace(F.coalesce("source_quote", F.lit("")), "[^0-9]", "")
    return cards.select("id", F.explode(F.filter(digits, lambda d: ~quote.contains(d))).alias("figure"))
