"""Briefs: risk cards, assembly into sections, reader groups, checks, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import audit, evidence, risks as K, rules as R
from folioscope.sources.scratch import cut

#: Topic, section, its place, and the most items it takes.
ROUTES = (
    ("business", "what-it-does", 1, 12), ("offering", "offering-mechanics", 2, 12), ("financial", "financial-snapshot", 3, 20), ("proceeds", "use-of-proceeds", 4, 8), ("dilution", "dilution-capitalization", 5, 10),
    ("governance", "control-governance", 6, 14), ("debt", "debt-liquidity", 7, 12), ("related_party", "related-party-transactions", 8, 12), ("lockup", "lockup-share-overhang", 9, 8), ("risk", "key-risk-themes", 10, 1 << 30),
)
NOTICE_TOPICS = ("offering", "proceeds", "financial", "debt", "dilution", "governance", "related_party", "lockup")
OPEN_TOPICS = ("proceeds", "dilution", "lockup")
REAL_VALUE = r"\$\s?\d|\(\s?\d|\d[\d,]*(?:\.\d+)?\s*(?:million|billion|%)"
#: Reader groups: group, its place, and its brief sections in order.
READER_GROUPS = (
    ("overview", 1, ("what-it-does",)), ("offering", 2, ("offering-mechanics",)), ("financials", 3, ("financial-snapshot",)),
    ("ownership", 4, ("dilution-capitalization", "control-governance", "lockup-share-overhang", "related-party-transactions")), ("capital", 5, ("use-of-proceeds", "debt-liquidity")), ("risks", 6, ("key-risk-themes",)),
)
GENERIC_PREAMBLE = "(?i)involves a high degree of risk"
MOVED_DEBT = "long-term debt"
OTHER_REASON = "It is one of the uncertainties the company says could materially affect its business."


def risk_cards(
    risks: DataFrame, chunks: DataFrame, policy: DataFrame, themes: list[tuple[str, str]], entities: str, subjects: list[tuple[str, str]] = (), reasons: dict[str, str] | None = None, main_section: str = K.MAIN_SECTION
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) cards of full-text risks with clean titles in the main section, two a theme and two a chunk.

    themes and subjects: (label or phrase, pattern) in order, tried on the title and then on the body.
    reasons: a sentence on why it matters for each theme; `other` serves the rest. Chunk texts are
    joined to the selected risks only.
    """
    clean = T.strip_page_furniture(F.col("original_text"))
    named = T.is_clean_title(F.col("title")) | T.is_clean_title(T.strip_page_furniture(F.col("title")))
    rows = risks.where(F.col("risk_extraction_type") == "full_text").where(named)
    rows = rows.select("document_id", "id", "pos", "specificity", F.element_at("source_chunk_ids", 1).alias("chunk_id"), clean.alias("body"), T.strip_page_furniture(F.col("title")).alias("plain_title"))
    rows = rows.join(chunks.where(F.trim("title") == main_section).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")

    def titled(s, plain):
        """Everything that comes from the sentences, each step bound once: a filter on it would else repeat them all."""
        first = F.try_element_at(s, F.lit(1))
        used = K.let(first, lambda f: F.coalesce((F.length(f) >= 45) & T.is_clean_title(f), F.lit(False)))
        return K.let(used, lambda u: K.let(F.when(u, first).otherwise(plain), lambda ts: K.let(T.clamp_sentence(ts, 180), lambda ct: F.struct(s.alias("sentences"), u.alias("used_first"), ts.alias("title_sentence"), ct.alias("card_title"), (T.is_clean_title(ct) & ~T.has_advice(ct)).alias("ok")))))

    rows = rows.repartition("id").withColumn("x", K.let(T.split_sentences(F.col("body")), lambda s: titled(s, F.col("plain_title"))))
    # written once: a filter on it, and all that is read of it twice below, would else find the sentences again
    rows = cut(rows, "titled").where("x.ok").select("*", "x.*").drop("x")
    rows = rows.withColumn("theme", R.theme_for(F.col("title_sentence"), F.col("body"), list(themes))).withColumn("score", K.salience(F.col("card_title"), F.col("body"), F.col("specificity"), entities))
    rows = cut(rows, "scored")
    chosen = K.select_with_caps(rows)
    rows = cut(rows.join(chosen, ["document_id", "id"]), "chosen")
    rows = rows.join(evidence.cited_chunks(chunks, rows).select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text")), "chunk_id")
    support = K.supporting_sentences(F.col("sentences"), F.col("title_sentence"), entities)
    follow = F.size(F.filter(F.slice("sentences", 2, 1 << 20), lambda s: (F.length(s) > 40) & (s != F.col("title_sentence"))))
    needle = F.substring("title_sentence", 1, 80)
    confidence, review = K.calibrate(F.col("used_first"), follow, evidence.quote_window(F.col("chunk_text"), needle))
    said = F.transform(support, lambda s, i: F.concat(F.when(i == 0, ' The filing states: "').otherwise(' It adds: "'), F.when(i == 0, T.clamp_sentence(s, 240)).otherwise(T.clamp_sentence(s, 200)), F.lit('"')))
    alone = F.when(T.has_advice(F.col("title_sentence")), "").otherwise(F.concat(F.lit(' The filing states: "'), T.clamp_sentence(F.col("title_sentence"), 240), F.lit('"')))
    named = list(subjects)
    subject = F.lit(None).cast("string")
    if named:
        subject = F.nullif(F.when(R.classify_first_match(F.col("title_sentence"), named, "") != "", R.classify_first_match(F.col("title_sentence"), named, "")).otherwise(R.classify_first_match(F.col("body"), named, "")), F.lit(""))
    framing = F.coalesce(F.concat(F.lit("This risk concerns "), subject, F.lit(".")), F.lit("This is one of the filing's stated risk factors."))
    reason = reasons or {}
    lead = F.coalesce(*[F.when(F.col("theme") == k, F.lit(v)) for k, v in reason.items()], F.lit(reason.get("other", OTHER_REASON)))
    why = F.concat(F.coalesce(F.concat(F.lit("Tied to "), subject, F.lit(", this")), F.lit("This")), F.lit(" is one of the risks the company says could materially affect its business. "), lead)
    body = F.concat(framing, F.when(F.size(support) > 0, F.array_join(said, "")).otherwise(alone))
    words = F.filter(F.transform(F.split("title_sentence", T.SPACE + "+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_$]+|[^A-Za-z0-9_%]+$", "")), lambda w: F.length(w) > 5)
    drafts = rows.select(
        F.col("rank").alias("draft_pos"), F.lit("risk").alias("topic"), F.col("card_title").alias("title"), "chunk_id", needle.alias("quote_needle"), T.excerpt(F.col("body"), 900).alias("extracted_text"), body.alias("plain_english"),
        why.alias("why_it_matters"), confidence.alias("confidence"), review.alias("needs_review"), F.concat(F.lit("risk-full-text-"), "theme").alias("extraction_method"),
        F.slice(words, 1, 2).alias("required_terms"), F.array(F.lit(main_section)).alias("allowed_titles"),
    )
    return evidence.evidence_gate(drafts, chunks, policy)


def assemble_brief(cards: DataFrame, brief: str = "brief_id") -> DataFrame:
    """(brief, section_id, section_pos, item_pos, id, title, body, ...) flat items of each brief.

    Cards go to their topic's section in card order up to its limit; debt cards about long-term
    debt go after the dilution cards. Before them come ten notice items of high confidence, after
    them the items that are still open.
    """
    spark = cards.sparkSession
    routes = F.broadcast(spark.createDataFrame(list(ROUTES), "route string, section_id string, section_pos int, item_limit int"))
    moved = (F.col("topic") == "debt") & F.col("title").contains(MOVED_DEBT)
    item = cards.select(brief, "card_pos", "topic", "title", F.col("id").alias("card_id"), F.col("plain_english").alias("body"), "why_it_matters", "confidence", "needs_review")
    high = (F.col("confidence") == "high") & ~F.col("needs_review")
    home = item.withColumn("route", F.when(moved, "dilution").otherwise(F.col("topic"))).withColumn("late", moved.cast("int")).join(routes, "route")
    home = home.withColumn("prefix", F.lit("evidence"))
    notice = item.where(high & F.col("topic").isin(*NOTICE_TOPICS)).select("*", F.lit("").alias("route"), F.lit(0).alias("late"), F.lit("ten-things").alias("section_id"), F.lit(0).alias("section_pos"), F.lit(10).alias("item_limit"), F.lit("notice").alias("prefix"))
    unclear = T.has(F.concat_ws(" ", "title", "body"), "(?i)blank|placeholder|period remains blank|not specified") & F.col("topic").isin(*OPEN_TOPICS)
    place = F.array_position(F.array(*[F.lit(t) for t in OPEN_TOPICS]), F.col("topic")).cast("int")
    open_ = item.where(unclear).select("*", F.lit("").alias("route"), place.alias("late"), F.lit("unclear-needs-review").alias("section_id"), F.lit(11).alias("section_pos"), F.lit(1 << 30).alias("item_limit"), F.lit("review").alias("prefix"))
    open_ = open_.withColumn("needs_review", F.lit(True))
    rows = audit.union(home, notice, open_)
    n = F.row_number().over(Window.partitionBy(brief, "section_id").orderBy("late", "card_pos", "card_id"))
    rows = rows.withColumn("item_pos", n).where("item_pos <= item_limit")
    return rows.select(brief, "section_id", "section_pos", "item_pos", T.stable_id(F.col("prefix"), F.col("card_id")).alias("id"), "card_id", "title", "body", "why_it_matters", "confidence", "needs_review")


def empty_sections(items: DataFrame, brief: str = "brief_id") -> DataFrame:
    """(brief, section_id) of sections that got no item."""
    ids = F.array(*[F.lit(r[1]) for r in ROUTES])
    every = items.select(brief).distinct().withColumn("section_id", F.explode(ids))
    return every.join(items.select(brief, "section_id").distinct(), [brief, "section_id"], "left_anti")


def reader_sections(items: DataFrame, groups=READER_GROUPS, brief: str = "brief_id") -> DataFrame:
    """(brief, group_id, group_pos, pos, id, title): items regrouped for readers; sections of no group go, ten-things is the hero (group_pos 0)."""
    rows = [(g, p, s, k) for g, p, secs in groups for k, s in enumerate(secs)] + [("hero", 0, "ten-things", 0)]
    m = F.broadcast(items.sparkSession.createDataFrame(rows, "group_id string, group_pos int, section_id string, source_pos int"))
    out = items.join(m, "section_id")
    pos = F.row_number().over(Window.partitionBy(brief, "group_id").orderBy("source_pos", "item_pos"))
    return out.select(brief, "group_id", "group_pos", pos.alias("pos"), "id", "title")


def derive_kpis(items: DataFrame, limit: int = 5, brief: str = "brief_id", section: str = "financial-snapshot") -> DataFrame:
    """(brief, n, label, value_billion, value, as_of): the first `limit` high-confidence titles of the section with a figure in billions.

    value is the figure as shown, such as -$4.69B.
    """
    figure = F.regexp_extract("title", T.java(r"(?i)\$([\d.]+)\s*billion"), 1)
    rows = items.where((F.col("section_id") == section) & (F.col("confidence") == "high") & (figure != ""))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(brief).orderBy("item_pos"))).where(F.col("n") <= limit)
    label = F.trim(F.regexp_replace(F.regexp_replace("title", T.java(r"(?i)\s+(was|were)\b.*$"), ""), T.java(r"(?i)^The\s+"), ""))
    minus = T.has(F.col("title"), "(?i)negative|loss")
    amount = F.round(figure.try_cast("double"), 2)
    shown = F.concat(F.when(minus, "-").otherwise(""), F.lit("$"), amount.cast("decimal(30,2)").cast("string"), F.lit("B"))
    return rows.select(brief, "n", label.alias("label"), (F.when(minus, -1).otherwise(1) * amount).alias("value_billion"), shown.alias("value"), T.has(F.col("title"), r"(?i)\bat\b|\bas of\b").alias("as_of"))


def is_real_value(c):
    return T.has(c, REAL_VALUE)


def brief_diagnostics(cards: DataFrame, rejected: DataFrame, risks: DataFrame) -> DataFrame:
    """(metric, value): accepted, high-confidence, rejected, full-text, excluded, real values, risk themes."""
    value = F.col("topic").isin("financial", "debt", "dilution") & is_real_value(F.col("source_quote"))
    theme = F.when(F.col("topic") == "risk", F.regexp_replace("extraction_method", "^risk-full-text-", ""))
    one = cards.agg(F.count(F.lit(1)).alias("accepted"), F.count_if((F.col("confidence") == "high") & ~F.col("needs_review")).alias("high_confidence"), F.count_if(value).alias("real_values"), F.countDistinct(theme).alias("risk_themes"))
    two = risks.agg(F.count_if(F.col("risk_extraction_type") == "full_text").alias("full_text"), F.count_if(F.col("risk_extraction_type") != "full_text").alias("excluded"))
    three = rejected.agg(F.count(F.lit(1)).alias("rejected"))
    return audit.union(*[df.unpivot([], df.columns, "metric", "value") for df in (one, two, three)])


def most_cited_section(citations: DataFrame, by: str = "brief_section_id") -> DataFrame:
    """(by, section_id, n): the filing section that each brief section cites most; ties to the first id."""
    n = citations.groupBy(by, "section_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "section_id"))).where("k = 1").drop("k")


def validate_brief(items: DataFrame, cards: DataFrame, chunks: DataFrame, policy: DataFrame, citations: DataFrame, rejected: DataFrame, diagnostics: dict[str, int] | None = None, required: tuple[str, ...] = tuple(r[1] for r in ROUTES)) -> DataFrame:
    """(severity, check, id, detail) of problems of one brief; citations: (id of the item, chunk_id, quote).

    Items, cards and citations are passed over once for all of their checks; chunks are read for the
    titles that cards cite, and for the texts that quotes are compared with. policy: a row a topic.
    """
    prose, said = F.concat_ws(" ", "title", "plain_english"), F.concat_ws(" ", "title", "body")
    real = F.col("topic").isin("financial", "debt", "dilution") & is_real_value(F.col("source_quote"))
    weak, risky = F.size("quality_warnings") > 0, F.col("section_id") == "key-risk-themes"
    error = lambda check, cond, id_="id", detail=None: ("error", check, cond, id_, detail)
    quotes = citations.select("id", F.array("chunk_id").alias("source_chunk_ids"), F.col("quote").alias("source_quote"))
    tables = [
        audit.entries(
            cards,
            [error("weak card accepted", weak), error("card without sources", F.size("source_chunk_ids") == 0), error("parser language", T.has_parser_language(prose)), error("advice", T.has_advice(F.concat_ws(" ", prose, "why_it_matters")))],
            {"cards": None, "high cards": (F.col("confidence") == "high") & ~F.col("needs_review") & ~weak, "real values": real}, {"weak card": ("id", None, weak)},
        ),
        audit.entries(
            items,
            [
                error("parser language in item", T.has_parser_language(said)), error("advice in item", T.has_advice(F.concat_ws(" ", said, "why_it_matters"))),
                error("weak risk title", risky & (~T.is_clean_title(F.col("title")) | T.has(F.col("title"), "(?i)risk factor$|additional risks"))),
            ],
            {"items": None, "candidates": T.has_parser_language(said), "notices": F.col("section_id") == "ten-things"},
            {
                "section": ("section_id", F.coalesce(T.has(said, "(?i)count|parser|generated|source notes"), F.lit(False))), "item": ("id", None), "item card": ("card_id", "id"),
                "explanation": (F.sha2(F.col("body"), 256), "id", risky & F.col("body").isNotNull()),
            },
        ),
        audit.entries(citations, keys={"cited": ("id", None)}), audit.entries(rejected, counts={"rejected": None}),
    ]
    found, n = audit.gathered(*tables)
    at = lambda metric: n.get(metric, 0)
    keys = found.where("kind = 'key'")
    noted = [("error", check, None, at(metric)) for metric, least, check in (("cards", 8, "too few cards"), ("high cards", 8, "too few high-quality cards"), ("notices", 5, "too few notice items"), ("real values", 3, "too few real values")) if at(metric) < least]
    if at("candidates") > 0.2 * max(at("items"), 1):
        noted.append(("error", "too many candidate items", None, at("candidates")))
    if diagnostics is not None:
        noted += [("warning", check, None, at(metric)) for metric, name, check in (("real values", "real_values", "real values disagree"), ("rejected", "rejected", "rejected count disagrees")) if at(metric) != diagnostics.get(name, 0)]
        if diagnostics.get("risk_themes", 0) < 5:
            noted.append(("warning", "few risk themes", None, diagnostics.get("risk_themes", 0)))
    sections = keys.where("check = 'section'").groupBy("id").agg(F.bool_and(F.col("detail") == "true").alias("meta"))
    need = items.sparkSession.createDataFrame([(s,) for s in required], "id string")
    same = keys.where("check = 'explanation'").groupBy("id").agg(F.sum("n").alias("k"), F.max("detail").alias("item")).where("k > 1")
    bare = keys.where("check = 'item'").join(keys.where("check = 'cited'").select("id"), "id", "left_anti")
    user = keys.where("check = 'item card'").join(keys.where("check = 'weak card'").select("id"), "id", "left_semi")
    titles = evidence.cited_chunks(chunks, cards.select(F.explode("source_chunk_ids").alias("chunk_id"))).select(F.col("id").alias("chunk_id"), F.col("title").alias("chunk_title"))
    cited = cards.select("id", "topic", "source_quote", F.explode("source_chunk_ids").alias("chunk_id")).join(titles, "chunk_id").join(F.broadcast(policy), "topic", "left")
    key = T.norm_title(F.col("chunk_title"))
    outside = ~F.coalesce(F.exists("allowed_titles", lambda t: T.norm_title(t) == key), F.lit(False))
    linked = audit.entries(cited, [error("section not allowed for topic", outside, "id", "chunk_title"), error("generic preamble quoted", (F.col("topic") == "risk") & T.has(F.col("source_quote"), GENERIC_PREAMBLE))])
    figures = evidence.unbacked_figures(cards)
    row = audit._found
    return audit.problems(
        found, noted,
        row(need.join(sections, "id", "left_anti"), "error", "missing section", F.col("id")), row(sections.where("meta and id <> 'source-notes'"), "error", "only meta items", F.col("id")),
        row(same, "error", "risk explanation repeated", F.col("item")), row(bare, "error", "item without citations", F.col("id")), row(user, "error", "item uses a weak card", F.col("detail")),
        linked.select(F.col("kind").alias("severity"), "check", "id", "detail"), row(figures, "warning", "figure not in quote", F.col("id"), F.col("figure")),
        audit.wrong_quotes({"card": (cards, "error"), "item": (quotes, "error")}, chunks, "signature"),
    )


def render_markdown(items: DataFrame, citations: DataFrame, briefs: DataFrame, brief: str = "brief_id") -> DataFrame:
    """(brief, markdown): title and disclaimer, sections, items with confidence and quoted sources.

    briefs: brief, title, disclaimer, snapshot map. citations: id, cite_pos, chunk_id, section_id, quote.
    """
    quote = F.replace(T.excerpt(F.col("quote"), 360), F.lit("|"), F.lit("\\|"))
    source = F.concat(F.lit("- "), "chunk_id", F.coalesce(F.concat(F.lit(" / "), "section_id"), F.lit("")), F.lit(': "'), quote, F.lit('"'))
    cites = citations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cite_pos", source.alias("line")))).alias("c")).select("id", F.array_join(F.col("c.line"), "\n").alias("sources"))
    rows = items.join(cites, "id", "left")
    why = F.when(F.length("why_it_matters") > 0, F.concat(F.lit("\n\nWhy it matters: "), "why_it_matters")).otherwise("")
    block = F.concat(F.lit("\n### "), "title", F.lit("\n\n"), "body", why, F.lit("\n\nConfidence: "), "confidence", F.lit(". Needs review: "), F.when(F.col("needs_review"), "yes").otherwise("no"), F.lit(".\n\nSources:"), F.coalesce(F.concat(F.lit("\n"), "sources"), F.lit("")))
    secs = rows.groupBy(brief, "section_pos", "section_id").agg(F.array_sort(F.collect_list(F.struct("item_pos", block.alias("b")))).alias("i"))
    secs = secs.select(brief, "section_pos", F.concat(F.lit("\n## "), "section_id", F.lit("\n"), F.array_join(F.col("i.b"), "\n")).alias("s"))
    whole = secs.groupBy(brief).agg(F.array_sort(F.collect_list(F.struct("section_pos", "s"))).alias("x"))
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("snapshot")), lambda e: F.concat(F.lit("- **"), e["key"], F.lit(":** "), F.coalesce(e["value"], F.lit("unknown")))), "\n")
    out = briefs.join(whole, brief, "left")
    return out.select(brief, F.concat(F.lit("# "), "title", F.lit("\n\n"), "disclaimer", F.lit("\n\n## Filing Snapshot\n\n"), facts, F.lit("\n"), F.coalesce(F.array_join(F.col("x.s"), "\n"), F.lit("")), F.lit("\n")).alias("markdown"))
