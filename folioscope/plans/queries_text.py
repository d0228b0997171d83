"""Queries of sources, text functions, filters, rules, sections and risks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import risks as K
from folioscope.operators import rules as R
from folioscope.operators import sections as S
from folioscope.plans.registry import Tables, dealt, key, like, query, re2, short, slug, ws
from folioscope.sources import html as H
from folioscope.sources import tables as A
from folioscope.sources.scratch import cut

LINE = "split_part(text, chr(10), 1)"
#: Rules of frequent fragments, since the tables' prose is invented.
FRAGMENT_RULES = [("articles", r"\b(the|der|la)\b"), ("endings", r"tion\b"), ("links", r"\b(and|und|et)\b"), ("stems", "heit")]
KEYWORDS = [dict(label="articles", category="a", pattern=r"\b(the|der|la)\b", k=3), dict(label="endings", category="b", pattern=r"[a-z]{3}tion\b", k=2), dict(label="licence", category="c", pattern=r"license", k=2)]
NEEDLES = [dict(label="first", id="g1", needles=["the", "der"]), dict(label="second", id="g2", needles=["La."]), dict(label="third", id="g3", needles=["zzzz", "que"])]


def first_line():
    return F.split_part("text", F.lit("\n"), F.lit(1))


def doc_sections(t: Tables):
    """One section a document, titled by its first line; a source is the document."""
    d = t.documents
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("ord"), F.concat(F.lit("s"), "doc_id").alias("id"), first_line().alias("title"), T.norm_title(first_line()).alias("normalized_title"), "text")


def doc_chunks(t: Tables):
    d = t.documents
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("chunk_pos"), F.concat(F.lit("c"), "doc_id").alias("id"), F.concat(F.lit("s"), "doc_id").alias("section_id"), first_line().alias("title"), "text")


def line_head(line, i):
    """What stands before a line: before every ninth one its head in capitals, before another its head as an item, else null."""
    return F.when(i % 9 == 4, F.upper(F.replace(F.substring(line, 1, 60), F.lit("ß"), F.lit("ss")))).when(i % 9 == 7, F.concat(F.lit("Item "), i.cast("string"), F.lit(". "), F.substring(line, 1, 40)))


def line_blocks(t: Tables):
    """Lines of documents as blocks, with heads before some, so that headings occur."""
    rows = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    head = line_head(F.col("line"), F.col("i"))
    both = F.array(F.struct((2 * F.col("i")).alias("pos"), head.alias("text")), F.struct((2 * F.col("i") + 1).alias("pos"), F.col("line").alias("text")))
    # dealt by document before the patterns are tried: the windows need that shuffle anyway, and a table of one file is one task before it
    return rows.repartition("document_id").select("document_id", F.explode(both).alias("b")).where("b.text is not null").select("document_id", "b.pos", F.lit("p").alias("tag"), "b.text")


LINES = """parts AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
lines AS (SELECT document_id, 2 * i + 1 AS pos, line AS text FROM parts UNION ALL SELECT document_id, 2 * i, upper(replace(left(line, 60), 'ß', 'ss')) FROM parts WHERE i % 9 = 4 UNION ALL SELECT document_id, 2 * i, 'Item ' || i || '. ' || left(line, 40) FROM parts WHERE i % 9 = 7)"""
MARKED = f"""{LINES}, keyed AS (SELECT *, {ws("text")} AS clean, {key("text")} AS k FROM lines),
marked AS (SELECT *, length(clean) BETWEEN 3 AND 180 AND (regexp_matches(k, '{S.MAJOR}') OR {like("clean", r"(?i)^item\s+\d+[a-z]?\.?\s+")} OR {like("clean", r"(?i)^part\s+[ivx]+")}
    OR (length(regexp_replace(clean, '[^A-Za-z]', '', 'g')) >= 4 AND clean = upper(clean))) AS is_heading,
  CASE WHEN regexp_matches(k, '{S.MAJOR}') OR {like("text", r"(?i)^item\s+\d+")} THEN 1 ELSE 2 END AS level FROM keyed)"""
GROUPED = f"""{MARKED}, numbered AS (SELECT *, CAST(sum(CAST(is_heading AS INT)) OVER (PARTITION BY document_id ORDER BY pos) AS BIGINT) AS ord FROM marked WHERE clean <> ''),
secs AS (SELECT document_id, ord, CASE WHEN ord = 0 THEN 'Document Preamble' ELSE max(text) FILTER (is_heading) END AS title, CAST(coalesce(max(level) FILTER (is_heading), 1) AS BIGINT) AS level,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (NOT is_heading), '') AS raw FROM numbered GROUP BY document_id, ord),
sections AS (SELECT document_id, ord, title, level, {ws("raw")} AS text, CASE WHEN ord = 0 THEN 'section-document-preamble' ELSE 'section-' || ord || '-' || {slug(slug("title"))} END AS id FROM secs)"""

RULES_SQL = lambda c: "CASE " + " ".join(f"WHEN {like(c, '(?i)' + p)} THEN '{k}'" for k, p in FRAGMENT_RULES) + " ELSE 'other' END"


@query("SELECT CAST(page_id AS VARCHAR) AS document_id, url, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages")
def a1_read_raw(t):
    return A.read_raw(t.spark, f"{t.sf_dir}/pages.parquet").select("document_id", "url", "size_bytes")


@query()
def b1_html_blocks(t):
    return H.html_blocks(A.read_raw(t.spark, f"{t.sf_dir}/pages.parquet"))


def indexes(t: Tables):
    """A filing index page for each order: a row a line item."""
    row = F.concat(F.lit("<tr><td> "), F.when(F.col("l_linenumber") == 4, 0).otherwise(F.col("l_linenumber")), F.lit("</td><td>"), "l_returnflag", F.lit("&amp;D</td><td><a href='/x/"), "l_partkey", F.lit(".htm'>f</a></td><td>EX-"), "l_suppkey", F.lit(".1</td></tr>"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "").alias("r"))
    return rows.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("<p>x<table><tr><td></table><table class='a tableFile'>"), "r", F.lit("</table>")).alias("html"))


@query("SELECT l_orderkey AS document_id, l_linenumber || '-ex' || l_suppkey || '1' AS id, CAST(l_linenumber AS BIGINT) AS sequence, 'EX-' || l_suppkey || '.1' AS type, l_returnflag || '&D' AS description, l_partkey || '.htm' AS filename, 'u/' || l_partkey || '.htm' AS source_url FROM lineitem WHERE l_linenumber <> 4")
def a4_filing_inventory(t):
    return H.filing_inventory(indexes(t), "u/")


@query("SELECT l_orderkey AS document_id, CAST(1 AS BIGINT) AS ord, string_agg(CASE WHEN l_linenumber = 4 THEN 0 ELSE l_linenumber END || ' ' || l_returnflag || '&D f EX-' || l_suppkey || '.1', ' ' ORDER BY l_linenumber, l_returnflag, l_partkey || '.htm', l_suppkey || '.1') AS text FROM lineitem GROUP BY 1")
def b7_extract_tables(t):
    return H.extract_tables(indexes(t))


@query("""SELECT package_id, sequence, filename FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY CASE WHEN lower(type) IN ('s-1', 's1') AND html THEN 1 WHEN regexp_matches(lower(type), 's-?1') AND html THEN 2 ELSE 3 END, sequence) AS n
 FROM (SELECT l_orderkey AS package_id, l_linenumber * 1000000 + l_partkey AS sequence, CASE l_suppkey % 4 WHEN 0 THEN 'S-1' WHEN 1 THEN 's-1/A' WHEN 2 THEN 'EX' ELSE 'S1' END AS type, l_partkey || CASE l_partkey % 3 WHEN 0 THEN '.htm' WHEN 1 THEN '.HTML' ELSE '.txt' END AS filename, l_partkey % 3 < 2 AS html FROM lineitem)
 WHERE (regexp_matches(lower(type), 's-?1') AND html) OR starts_with(filename, '7')) WHERE n = 1""")
def b8_pick_main_document(t):
    s, p = F.col("l_suppkey") % 4, F.col("l_partkey") % 3
    rows = t.lineitem.select(F.col("l_orderkey").alias("package_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("sequence"), F.when(s == 0, "S-1").when(s == 1, "s-1/A").when(s == 2, "EX").otherwise("S1").alias("type"), F.concat("l_partkey", F.when(p == 0, ".htm").when(p == 1, ".HTML").otherwise(".txt")).alias("filename"))
    return S.pick_main_document(rows.withColumn("sequence", F.col("sequence").cast("long")), "^7").select("package_id", "sequence", "filename")


@query(f"WITH {MARKED} SELECT document_id, pos, is_heading, CAST(CASE WHEN is_heading THEN level ELSE 0 END AS BIGINT) AS level FROM marked")
def b2_mark_headings(t):
    return S.mark_headings(line_blocks(t)).select("document_id", "pos", "is_heading", F.coalesce("level", F.lit(0)).alias("level"))


@query(f"WITH {GROUPED} SELECT document_id, ord, id, title, level, md5(text) AS text_md5 FROM sections")
def b3_sections(t):
    return S.sessionize_sections(S.mark_headings(line_blocks(t))).select("document_id", "ord", "id", "title", "level", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {GROUPED} SELECT s.document_id, s.id, (SELECT arg_max(p.id, p.ord) FROM sections p WHERE p.document_id = s.document_id AND p.ord < s.ord AND p.level < s.level) AS parent_id FROM sections s")
def b4_section_parents(t):
    return S.section_parents(cut(S.sessionize_sections(S.mark_headings(line_blocks(t))))).select("document_id", "id", "parent_id")


_TINY = f"""WITH RECURSIVE {GROUPED.replace(" AS (", " AS MATERIALIZED (")}, s AS MATERIALIZED (SELECT *, {key("title")} AS k, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS n FROM sections),
 f AS (SELECT document_id, n, ord, ord AS into_ord, level AS kept FROM s WHERE n = 1 UNION ALL SELECT s.document_id, s.n, s.ord, CASE WHEN length(s.text) < 120 AND s.level > f.kept AND NOT regexp_matches(s.k, '{S.MAJOR}') THEN f.into_ord ELSE s.ord END,
  CASE WHEN length(s.text) < 120 AND s.level > f.kept AND NOT regexp_matches(s.k, '{S.MAJOR}') THEN f.kept ELSE s.level END FROM f JOIN s ON s.document_id = f.document_id AND s.n = f.n + 1),
 t AS (SELECT f.document_id, f.into_ord, {ws("string_agg(CASE WHEN s.ord = f.into_ord THEN s.text ELSE s.title || chr(10) || s.text END, chr(10) || chr(10) ORDER BY s.ord)")} AS text FROM f JOIN s USING (document_id, ord) GROUP BY ALL)
 SELECT t.document_id, row_number() OVER (PARTITION BY t.document_id ORDER BY t.into_ord) - 1 AS ord, s.id, s.level, CAST(length(t.text) AS BIGINT) AS n FROM t JOIN s ON s.document_id = t.document_id AND s.ord = t.into_ord"""


@query(_TINY)
def b5_merge_tiny_sections(t):
    return S.merge_tiny_sections(cut(S.sessionize_sections(S.mark_headings(line_blocks(t))))).select("document_id", "ord", "id", "level", F.length("text").alias("n"))


#: Sentences are split at marks (chr 1) put before them, and packed by a fold that puts chr 2 between chunks.
CHUNKED = f"""secs AS (SELECT source AS document_id, CAST(doc_id AS BIGINT) AS ord, 's' || doc_id AS id, {LINE} AS title, {ws("text")} AS clean FROM documents),
 packed AS (SELECT *, list_reduce(list_prepend('', string_split(regexp_replace(clean, '(\\.) +([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))), lambda a, s: CASE WHEN length(string_split(a, chr(2))[-1]) + 1 + length(s) > 6000 AND trim(string_split(a, chr(2))[-1]) <> '' THEN a || chr(2) || ' ' || s ELSE a || ' ' || s END) AS p FROM secs WHERE clean <> ''),
 parts AS (SELECT * EXCLUDE (p), trim(unnest(string_split(p, chr(2)))) AS text, generate_subscripts(string_split(p, chr(2)), 1) AS part FROM packed),
 chunks AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord, part) - 1 AS chunk_pos FROM parts)"""


@query(f"""WITH {CHUNKED} SELECT 'chunk-' || {slug("id")} || '-' || part AS id, id AS section_id, document_id, chunk_pos, part, CASE WHEN contains({key("title")}, 'risk factors') THEN 'risk_factor' WHEN contains({key("title")}, 'financial') OR contains({key("title")}, 'capitalization') THEN 'financial_statement' ELSE 'narrative' END AS chunk_type,
 title, text, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS token_estimate, CAST(NULL AS VARCHAR) AS source_url, CASE WHEN title <> '' THEN title ELSE 'Untitled section' END || ' (' || document_id || ', section ' || ord || '), chunk ' || part || ': "' || {short("text", 140)} || '"' AS citation_label FROM chunks""")
def b6_chunk_sections(t):
    return S.chunk_sections(doc_sections(t))


@query(f"WITH {GROUPED} SELECT document_id, id, CASE WHEN words = '' THEN 'Filing source' ELSE array_to_string(list_transform(string_split(words, ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') END AS label FROM (SELECT document_id, id, trim(regexp_replace(regexp_replace(id, '^section-[0-9]+-?', ''), '[-_]', ' ', 'g')) AS words FROM sections)")
def b9_section_label(t):
    titles = t.spark.createDataFrame([("riskfactors", "Risk Factors")], "slug string, title string")
    return S.section_label(S.sessionize_sections(S.mark_headings(line_blocks(t))).select("document_id", "id"), titles)


@query(f"SELECT doc_id, {ws('text')} AS ws, {key('text')} AS title_key FROM documents")
def c1_norm(t):
    return t.documents.select("doc_id", T.norm_ws(F.col("text")).alias("ws"), T.norm_title(F.col("text")).alias("title_key"))


@query(f"SELECT doc_id, {slug(LINE)} AS slug, concat_ws('-', 'chunk', {slug(slug(LINE))}, doc_id, nullif({slug('source')}, '')) AS id FROM documents")
def c2_ids(t):
    return t.documents.select("doc_id", T.slugify(first_line()).alias("slug"), T.stable_id("chunk", T.slugify(first_line()), F.col("doc_id"), F.lit(""), F.lit(None), F.col("source")).alias("id"))


@query(f"SELECT doc_id, CAST(greatest(1, ceil(length({ws('text')}) / 4.0)) AS BIGINT) AS tokens, {short('text', 140)} AS excerpt FROM documents")
def c3_tokens_excerpt(t):
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.excerpt(F.col("text"), 140).alias("excerpt"))


@query(f"SELECT doc_id, contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), regexp_replace(lower({LINE} || CASE WHEN doc_id % 3 = 0 THEN ' -zq9- ' ELSE ' -- ' END), '[^a-z0-9]+', '', 'g')) AS ok FROM documents")
def c4_source_excerpt(t):
    quote = F.concat(first_line(), F.when(F.col("doc_id") % 3 == 0, " -zq9- ").otherwise(" -- "))
    return t.documents.select("doc_id", T.is_source_excerpt(F.col("text"), quote).alias("ok"))


@query(f"SELECT doc_id, {ws('regexp_replace(regexp_replace(x, ' + chr(39) + re2(chr(92) + 'b[0-9]{1,4}' + chr(92) + 's*Table of Contents' + chr(92) + 'b') + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'gi' + chr(39) + '), ' + chr(39) + chr(92) + 'bTable of Contents' + chr(92) + 'b' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'gi' + chr(39) + ')')} AS clean FROM (SELECT doc_id, replace(text, '.', ' ' || doc_id % 500 || ' TABLE of Contents and Table of Contents.') AS x FROM documents)")
def c5_page_furniture(t):
    x = F.replace(F.col("text"), F.lit("."), F.concat(F.lit(" "), F.col("doc_id") % 500, F.lit(" TABLE of Contents and Table of Contents.")))
    return t.documents.select("doc_id", T.strip_page_furniture(x).alias("clean"))


PRETTY = lambda x: "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x + rf", '{re2(chr(92) + 's*')}[.…]{{2,}}{re2(chr(92) + 's*')}', ' ', 'g'), '([0-9)A-Za-z])\$', '\1 $', 'g'), '(\))([0-9])', '\1 \2', 'g'), '([0-9]{{3,}})([A-Z])', '\1 \2', 'g'), '(%)([A-Za-z(])', '\1 \2', 'g'), ' {{2,}}', ' ', 'g'))"


@query(f"SELECT l_orderkey, l_linenumber, {PRETTY('x')} AS pretty FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'Total$' || l_partkey || '$' || l_suppkey || '(' || l_orderkey || ')27 ..... ' || l_partkey || 'December' || l_linenumber || '%Costs  end ' AS x FROM lineitem)")
def c6_prettify_quote(t):
    x = F.concat(F.lit("Total$"), "l_partkey", F.lit("$"), "l_suppkey", F.lit("("), "l_orderkey", F.lit(")27 ..... "), "l_partkey", F.lit("December"), "l_linenumber", F.lit("%Costs  end "))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(F.xxhash64("l_orderkey", "l_partkey")).select("l_orderkey", "l_linenumber", T.prettify_quote(x).alias("pretty"))


#: RE2 has no look-behind: every end is marked, and marks after abbreviations are taken back, twice as matches may touch.
_UNMARK = f"'((?:^|[^A-Za-z0-9_]){T.ABBREVIATIONS}\\.)' || chr(1), '\\1 ', 'g'"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({ws('text')}, '([.!?]) +([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), {_UNMARK}), {_UNMARK}), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def c7_split_sentences(t):
    return t.documents.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id, CASE WHEN length(c) <= 180 THEN c ELSE trim(CASE WHEN contains(left(c, 180), ' ') THEN left(c, 180 - instr(reverse(left(c, 180)), ' ')) ELSE left(c, 179) END) || '…' END AS title FROM (SELECT doc_id, {ws('text')} AS c FROM documents)")
def c8_clamp_sentence(t):
    return t.documents.select("doc_id", T.clamp_sentence(F.col("text"), 180).alias("title"))


def window_sql(table: str, keys: str) -> str:
    """SELECT of keys and quote of rows (keys, t, nd): the window around nd, its borders found in lists of the places where sentences and words end. Place i is text[i], from 0."""
    space = f"regexp_matches(ch[i - p0 + 1], '{T.SPACE}')"
    ends = f"ch[i - p0 + 1] IN ('.', '!', '?') AND (i = 0 OR ch[i - p0] <> '.') AND (i + 1 >= n OR regexp_matches(ch[i - p0 + 2], '{T.SPACE}'))"
    return f"""SELECT {keys}, {PRETTY(ws("CASE WHEN hit < 0 THEN left(t, 760) ELSE substr(t, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT)) END"))} AS quote FROM (
 SELECT *, CASE WHEN lead IS NOT NULL THEN coalesce(list_min(list_filter(range(lead, hit), lambda i: NOT {space})), hit) ELSE low END AS start,
  coalesce(list_max(list_filter(range(past + (high - past) // 2, high), lambda i: {ends})) + 1, CASE WHEN high < n AND NOT regexp_matches(ch[high - p0 + 1], '{T.SPACE}') THEN coalesce(list_max(list_filter(range(past, high), lambda i: {space})) + 1, past) ELSE high END) AS stop FROM (
 SELECT *, coalesce(list_max(list_filter(range(low + 1, hit), lambda i: {ends})) + 1, CASE WHEN low > 0 AND NOT regexp_matches(ch[low - p0], '{T.SPACE}') THEN coalesce(list_min(list_filter(range(low, hit), lambda i: {space})), hit) END) AS lead FROM (
 SELECT *, CASE WHEN hit < 0 THEN [] ELSE string_split(substr(t, CAST(p0 AS BIGINT) + 1, CAST(high - p0 + 2 AS BIGINT)), '') END AS ch FROM (
 SELECT *, greatest(0, low - 1) AS p0 FROM (SELECT *, greatest(0, hit - 140) AS low, least(n, greatest(past, hit + 760)) AS high FROM (SELECT *, hit + length(nd) AS past FROM (SELECT *, instr(lower(t), lower(nd)) - 1 AS hit, length(t) AS n FROM {table})))))))"""


@query(window_sql("(SELECT doc_id, text AS t, CASE WHEN doc_id % 5 = 0 THEN 'no such needle' ELSE substr(text, 301, 40) END AS nd FROM documents)", "doc_id"))
def c9_quote_window(t):
    from folioscope.operators.evidence import quote_window

    d = t.documents
    needle = F.when(F.col("doc_id") % 5 == 0, "no such needle").otherwise(F.substring(F.col("text"), 301, 40))
    return d.select("doc_id", quote_window(F.col("text"), needle).alias("quote"))


_TITLE_SQL = f"trim(CASE doc_id % 4 WHEN 0 THEN 'Our costs may rise and ' || {LINE} WHEN 1 THEN 'Such losses could harm us, ' || {LINE} WHEN 2 THEN 'If sales decline, we may ' || {LINE} ELSE {LINE} || ' risk' END)"
_CLEAN_SQL = " AND ".join([like("x", "^[A-Z]"), "length(x) BETWEEN 45 AND 220", like("x", T.RISK_SIGNAL), *[f"NOT {like('x', p)}" for p in T.FRAGMENTS], *[f"({like('x', T.SUBORDINATOR)} OR NOT {like('x', p)})" for p in T.LOOSE_CLAUSES]])


@query(f"SELECT doc_id, {_CLEAN_SQL} AS ok FROM (SELECT doc_id, regexp_replace({_TITLE_SQL}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS x FROM documents)")
def c10_clean_title(t):
    k = F.col("doc_id") % 4
    line = first_line()
    x = F.when(k == 0, F.concat(F.lit("Our costs may rise and "), line)).when(k == 1, F.concat(F.lit("Such losses could harm us, "), line)).when(k == 2, F.concat(F.lit("If sales decline, we may "), line)).otherwise(F.concat(line, F.lit(" risk")))
    return t.documents.select("doc_id", T.is_clean_title(F.trim(x)).alias("ok"))


_SAID = "CASE event_type WHEN 'click' THEN 'You should buy now' WHEN 'purchase' THEN 'agreed not to sell shares' WHEN 'error' THEN 'A candidate record' WHEN 'signup' THEN 'The price  targets rose' ELSE 'Nothing of note' END"


@query(f"SELECT event_id, {like('x', T.ADVICE)} AS advice, {like('x', T.PARSER_WORDS)} AS parser, {like('x', T.PROHIBITED)} AS prohibited FROM (SELECT event_id, {_SAID} AS x FROM events)")
def c11_policy(t):
    e = F.col("event_type")
    x = F.when(e == "click", "You should buy now").when(e == "purchase", "agreed not to sell shares").when(e == "error", "A candidate record").when(e == "signup", "The price  targets rose").otherwise("Nothing of note")
    return t.events.select("event_id", T.has_advice(x).alias("advice"), T.has_parser_language(x).alias("parser"), T.has_prohibited_language(x).alias("prohibited"))


@query(rf"SELECT doc_id, upper(left(x, 1)) || substr(x, 2) AS clean FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\bthe (in|on)\b', 'those', 'gi'), '\b(of|de) ?', 'about ', 'gi') AS x FROM documents)")
def c12_scrub_terms(t):
    return t.documents.select("doc_id", T.scrub_terms(F.col("text"), [(r"\bthe (in|on)\b", "those"), (r"\b(of|de) ?", "about ")]).alias("clean"))


@query(f"SELECT doc_id, {LINE} AS title FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower({LINE}), 'tion the') ORDER BY doc_id LIMIT 12")
def d1_search_chunks(t):
    return R.search_chunks(doc_chunks(t), " Tion The ").select(F.col("chunk_pos").alias("doc_id"), "title")


@query("SELECT CAST(0 AS BIGINT) AS pos, 'all' AS category UNION ALL SELECT DISTINCT 1, lang FROM documents WHERE lang IS NOT NULL")
def d2_categories(t):
    return R.distinct_categories(t.documents, "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def d2_filter_by_category(t):
    return R.filter_by_category(t.documents, "de", "lang").select("doc_id")


@query("SELECT 'c' || doc_id AS id, doc_id AS chunk_pos FROM documents WHERE doc_id = 17")
def d4_section_chunks(t):
    return R.section_chunks(doc_chunks(t), "s17").select("id", "chunk_pos")


@query(f"SELECT doc_id, {RULES_SQL('text')} AS label FROM documents")
def e1_classify(t):
    return t.documents.select("doc_id", R.classify_first_match(F.col("text"), FRAGMENT_RULES).alias("label"))


@query(f"SELECT doc_id, CASE WHEN {RULES_SQL(LINE)} <> 'other' THEN {RULES_SQL(LINE)} ELSE {RULES_SQL('text')} END AS theme FROM documents")
def e2_theme_for(t):
    return t.documents.select("doc_id", R.theme_for(first_line(), F.col("text"), FRAGMENT_RULES).alias("theme"))


@query(f"SELECT doc_id, CASE WHEN {like('text', r'(?i)\b(the|der)\b')} AND {like('text', r'(?i)\b(on|die)\b')} THEN 'mixed' WHEN {like('text', r'(?i)\b(the|der)\b')} THEN 'company_specific' ELSE 'generic' END AS specificity FROM documents")
def e3_specificity(t):
    return t.documents.select("doc_id", R.specificity(F.col("text"), r"\b(the|der)\b", r"\b(on|die)\b").alias("specificity"))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT source AS document_id, CAST({i} AS BIGINT) AS rule_pos, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, '{r['label']}' AS label, '{r['category']}' AS category, 'c' || doc_id AS id, {short('text', 450)} AS value_text, left({ws('text')}, 700) AS source_quote FROM documents WHERE {like('text', '(?i)' + r['pattern'])}) WHERE n <= {r['k']}"
        for i, r in enumerate(KEYWORDS)
    )
)
def e4_keyword_candidates(t):
    return R.keyword_candidates(doc_chunks(t), KEYWORDS)


@query(
    " UNION ALL ".join(
        f"SELECT source AS document_id, CAST({i} AS BIGINT) AS rule_pos, '{r['label']}' AS label, 's' || min(doc_id) AS section_id, 'c' || min(doc_id) AS chunk_id FROM documents WHERE {' OR '.join(f'''contains({key(LINE)}, {key(chr(39) + n + chr(39))})''' for n in r['needles'])} GROUP BY source"
        for i, r in enumerate(NEEDLES)
    )
)
def e5_first_section_hits(t):
    return R.first_section_hits(doc_sections(t), doc_chunks(t), NEEDLES)


@query(f"SELECT document_id, id, CASE WHEN hit <> '' THEN hit ELSE {short('text', 300)} END AS value_text, CASE WHEN hit <> '' THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT source AS document_id, 'c' || doc_id AS id, text, regexp_extract(text, '{re2(r'(?i)(?:the|on)' + chr(92) + 's+([A-Z]{2,6})')}', 1) AS hit, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE {like('text', '(?i)heit|tion|ment')}) WHERE n = 1")
def e6_extract_capture(t):
    return R.extract_capture(doc_chunks(t), "heit|tion|ment", r"(?:the|on)\s+([A-Z]{2,6})")


@query(
    "WITH docs AS (SELECT DISTINCT source AS document_id FROM documents) "
    + " UNION ALL ".join(
        f"""SELECT d.document_id, CAST({i} AS BIGINT) AS check_pos, '{r['id']}' AS id, coalesce(s, c) IS NOT NULL AS found, coalesce('s' || s, 'c' || c) AS matched_id, CASE WHEN s IS NOT NULL THEN 'section' WHEN c IS NOT NULL THEN 'chunk' END AS matched_type, CASE WHEN s IS NOT NULL THEN 'high' WHEN c IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
    FROM docs d LEFT JOIN (SELECT source, min(doc_id) FILTER ({' OR '.join(f'''contains({key(LINE)}, {key(chr(39) + n + chr(39))})''' for n in r['needles'])}) AS s, min(doc_id) FILTER ({' OR '.join(f'''contains({key(LINE)}, {key(chr(39) + n + chr(39))}) OR contains({key('left(text, 800)')}, {key(chr(39) + n + chr(39))})''' for n in r['needles'])}) AS c FROM documents GROUP BY source) x ON x.source = d.document_id"""
        for i, r in enumerate(NEEDLES)
    )
)
def e7_golden_checks(t):
    return R.golden_checks(doc_sections(t), doc_chunks(t), NEEDLES)


@query(f"SELECT source AS document_id, bool_or(contains({key(LINE)}, 'the on') OR contains({key(LINE)}, 'der')) AS english, bool_or(contains({key(LINE)}, 'zzzz')) AS missing FROM documents GROUP BY source")
def e8_coverage_flags(t):
    return R.coverage_flags(doc_sections(t), {"english": ["the on", "Der."], "missing": ["zzzz"]})


def thread_sections(c="o_orderpriority"):
    p = F.substring(c, 1, 1)
    return F.when(p == "1", F.concat(F.lit("section-4-RiskFactors-"), "o_orderkey")).when(p == "2", "financials").when(p == "3", "section-9-useofproceeds").when(p == "4", "section-1-glossary")


THREAD_SECTION = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'section-4-RiskFactors-' || o_orderkey WHEN '2' THEN 'financials' WHEN '3' THEN 'section-9-useofproceeds' WHEN '4' THEN 'section-1-glossary' END"
THEME = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'risks' WHEN '2' THEN 'financials' WHEN '3' THEN 'offering' END"


@query(f"SELECT o_orderkey, {THEME} AS theme FROM orders")
def e9_resolve_theme(t):
    return t.orders.select("o_orderkey", R.resolve_theme(thread_sections()).alias("theme"))


OPENERS = "The|Of|And|En|La|De|Die|Der|In|On"
_HEAD = rf"(?:{OPENERS})[^.;:!?]{{20,220}}(?:\.|:)"
#: Without look-ahead: titles are marked (chr 1 before, chr 2 after), and each piece after the first is a title and its body.
_FOUND = f"list_filter(list_transform(string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:], lambda x: struct_pack(title := regexp_replace({ws('split_part(x, chr(2), 1)')}, '[:.]$', ''), n := length({ws('split_part(x, chr(2), 1) || chr(32) || split_part(x, chr(2), 2)')}), extraction_method := 'sentence-heading-regex')), lambda x: x.n > 120)"
_REST = f"list_filter(list_transform(list_filter(string_split(regexp_replace(text, '(Risks? Related to )', chr(1) || '\\1', 'gi'), chr(1)), lambda x: x <> ''), lambda x, i: struct_pack(title := CASE WHEN i = 1 THEN 'Risk factor' ELSE regexp_replace({short('x', 120)}, '[:.]$', '') END, n := length({ws('x')}), extraction_method := 'risk-related-to-fallback')), lambda x: x.n > 120)"


@query(f"""WITH {CHUNKED}, f AS (SELECT document_id, chunk_pos, {_FOUND} AS found, {_REST} AS rest FROM chunks), i AS (SELECT document_id, chunk_pos, CASE WHEN len(found) >= 3 THEN found ELSE rest END AS items FROM f)
 SELECT document_id, chunk_pos, item_pos, x.title AS title, CAST(x.n AS BIGINT) AS n, x.extraction_method AS extraction_method FROM (SELECT document_id, chunk_pos, generate_subscripts(items, 1) - 1 AS item_pos, unnest(items) AS x FROM i)""")
def f1_split_risk_text(t):
    rows = S.chunk_sections(dealt(doc_sections(t).select("id", "document_id", "ord", "title", "text")))
    return K.split_risk_text(rows.select("document_id", "chunk_pos", "id", "title", "text"), OPENERS).select("document_id", "chunk_pos", "item_pos", "title", F.length("body").alias("n"), "extraction_method")


#: Whole texts (pos -1) and their lines as bodies of items.
_ITEMS = f"(SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN 'Other' ELSE ' RISK FACTORS ' END AS chunk_title, CASE WHEN doc_id % 7 = 0 THEN 'Risk factor' WHEN doc_id % 7 = 1 THEN 'The Co' ELSE {LINE} END AS title, body FROM (SELECT doc_id, text, -1 AS pos, text AS body FROM documents UNION ALL SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1, unnest(string_split(text, chr(10))) FROM documents))"


def _items(t):
    d = F.col("doc_id")
    bodies = F.concat(F.array("text"), F.split("text", "\n"))
    rows = t.documents.select("doc_id", F.when(d % 3 == 0, "Other").otherwise(" RISK FACTORS ").alias("chunk_title"), F.when(d % 7 == 0, "Risk factor").when(d % 7 == 1, "The Co").otherwise(first_line()).alias("title"), F.posexplode(bodies).alias("pos", "body"))
    return rows.withColumn("pos", F.col("pos") - 1)


def classified(items: str) -> str:
    """CTEs k and w of items (chunk_title, title, body): their classes and warnings."""
    return f"""k AS (SELECT *, CASE WHEN trim(chunk_title) <> 'RISK FACTORS' OR regexp_matches({key('title')}, '^risk factors?$|^[0-9]+$') THEN 'toc_entry' WHEN length(body) < 180 THEN 'heading_only'
  WHEN length(body) < 500 OR length(body) < length(title) + 160 OR {like('trim(title)', r'(?i)^.{1,40},\s*(which|that)\b')} OR regexp_matches(trim(title), '^[A-Z]{{2,}},') OR {like('trim(title)', r'\b(U|U\.S|Inc|Corp|Mr|Mrs|Ms|Dr|No|Co|vs|e\.g|i\.e)$')} THEN 'fragment' ELSE 'full_text' END AS risk_extraction_type FROM {items}),
w AS (SELECT *, CASE WHEN trim(chunk_title) <> 'RISK FACTORS' THEN 'Extracted from "' || chunk_title || '" rather than the main Risk Factors section.' WHEN risk_extraction_type = 'toc_entry' THEN 'Looks like a table-of-contents or section-heading entry.' WHEN risk_extraction_type = 'heading_only' THEN 'Looks like a heading with little supporting body text.' WHEN risk_extraction_type = 'fragment' THEN 'Risk source text is short or appears to start/end mid-factor.' WHEN title = 'Risk factor' THEN 'Missing specific risk title.' END AS extraction_warning FROM k)"""


@query(f"WITH {classified(_ITEMS)} SELECT doc_id, pos, risk_extraction_type, extraction_warning, CASE WHEN risk_extraction_type = 'full_text' THEN 'medium' ELSE 'low' END AS confidence, risk_extraction_type <> 'full_text' OR extraction_warning IS NOT NULL AS needs_review FROM w")
def f2_classify_risk(t):
    return K.classify_risk(_items(t)).select("doc_id", "pos", "risk_extraction_type", "extraction_warning", "confidence", "needs_review")


@query(f"SELECT doc_id, pos, 'risk-' || pos || '-' || {slug('title')} AS id FROM (SELECT doc_id, {LINE} AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents)")
def f3_number_records(t):
    rows = t.documents.select("doc_id", F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_pos"), F.lit(0).alias("item_pos"), first_line().alias("title"))
    return K.number_records(rows).select("doc_id", "pos", "id")


def risk_chunks(t):
    """Documents as chunks of a main risk section."""
    return S.chunk_sections(dealt(doc_sections(t).select("id", "document_id", "ord", F.lit(K.MAIN_SECTION).alias("title"), "text")))


_whole = lambda x: x.replace("n := length(", "body := (").replace("x.n > 120", "length(x.body) > 120")
_RISK_ITEMS = f"""(SELECT *, 'RISK FACTORS' AS chunk_title, row_number() OVER (PARTITION BY document_id ORDER BY chunk_pos, item_pos) AS pos FROM (SELECT document_id, chunk_pos, section_id, chunk_id, text, item_pos, x.title AS title, x.body AS body, x.extraction_method AS extraction_method FROM (SELECT * EXCLUDE (items), generate_subscripts(items, 1) AS item_pos, unnest(items) AS x
 FROM (SELECT document_id, chunk_pos, id AS section_id, 'chunk-' || {slug("id")} || '-' || part AS chunk_id, text, CASE WHEN len({_whole(_FOUND)}) >= 3 THEN {_whole(_FOUND)} ELSE {_whole(_REST)} END AS items FROM chunks))))"""
_SPECIFIC = f"CASE WHEN {like('body', r'(?i)\b(the|der)\b')} AND {like('body', r'(?i)\b(on|die)\b')} THEN 'mixed' WHEN {like('body', r'(?i)\b(the|der)\b')} THEN 'company_specific' ELSE 'generic' END"


@query(f"""WITH {CHUNKED}, {classified(_RISK_ITEMS)} SELECT 'risk-' || pos || '-' || {slug("title")} AS id, document_id, pos, title, {RULES_SQL("body")} AS category, body AS original_text, {_SPECIFIC} AS specificity, CASE WHEN risk_extraction_type = 'full_text' THEN 'medium' ELSE 'low' END AS confidence,
 section_id AS source_section_id, chunk_id AS source_chunk_ids, left(text, 700) AS source_quote, CAST(length(body) AS BIGINT) AS character_length, 'The filing flags this as a ' || {RULES_SQL("body")} || ' risk. Review the source text for exact wording before relying on a summary.' AS plain_english, '{K.REASON.replace("'", "''")}' AS why_it_matters,
 extraction_method, risk_extraction_type, risk_extraction_type <> 'full_text' OR extraction_warning IS NOT NULL AS needs_review, extraction_warning FROM w""")
def f4_extract_risks(t):
    return K.extract_risks(risk_chunks(t), FRAGMENT_RULES, r"\b(on|die)\b", r"\b(the|der)\b", OPENERS).withColumn("source_chunk_ids", F.array_join("source_chunk_ids", " | "))


_SIGNAL = T.RISK_SIGNAL


@query(f"""SELECT doc_id, CAST(3 * len(regexp_extract_all(x, '(?i)\\b(the|der)\\b')) + least(3, len(regexp_extract_all(x, '\\$|[0-9]{{2,}}|%'))) + least(4, len(regexp_extract_all(x, '{_SIGNAL}')))
  + CASE WHEN length(body) BETWEEN 200 AND 1200 THEN 2 WHEN length(body) < 120 THEN -2 ELSE 0 END + CASE WHEN {_CLEAN_SQL.replace('(x,', '(title,').replace('length(x)', 'length(title)')} THEN 2 ELSE 0 END + CASE s WHEN 'company_specific' THEN 2 WHEN 'generic' THEN -1 ELSE 0 END AS BIGINT) AS score
  FROM (SELECT doc_id, text AS body, 'Our loss may grow as ' || left(text, 60) AS title, 'Our loss may grow as ' || left(text, 60) || ' ' || text AS x, CASE doc_id % 3 WHEN 0 THEN 'company_specific' WHEN 1 THEN 'generic' ELSE 'mixed' END AS s FROM documents)""")
def i7_salience(t):
    title = F.concat(F.lit("Our loss may grow as "), F.substring("text", 1, 60))
    s = F.when(F.col("doc_id") % 3 == 0, "company_specific").when(F.col("doc_id") % 3 == 1, "generic").otherwise("mixed")
    return t.documents.select("doc_id", K.salience(title, F.col("text"), s, r"\b(the|der)\b").alias("score"))


@query("""WITH RECURSIVE c AS MATERIALIZED (SELECT source AS document_id, doc_id AS id, doc_id % 7 AS theme, n_chars % 11 AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 13 DESC, doc_id) AS n FROM documents),
 f AS (SELECT document_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS themes, CAST([] AS BIGINT[]) AS chunks FROM (SELECT DISTINCT document_id FROM c)
 UNION ALL SELECT document_id, n, CASE WHEN ok THEN id END, CASE WHEN ok THEN list_append(themes, theme) ELSE themes END, CASE WHEN ok THEN list_append(chunks, chunk_id) ELSE chunks END FROM (SELECT c.*, f.themes, f.chunks, len(list_filter(f.themes, lambda x: x = c.theme)) < 2 AND len(list_filter(f.chunks, lambda x: x = c.chunk_id)) < 2 AS ok FROM f JOIN c ON c.document_id = f.document_id AND c.n = f.n + 1))
 SELECT document_id, id, CAST(len(themes) AS BIGINT) AS rank FROM f WHERE id IS NOT NULL""")
def i8_select_with_caps(t):
    rows = t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), (F.col("doc_id") % 7).alias("theme"), (F.col("n_chars") % 11).alias("chunk_id"), (F.col("n_chars") % 13).alias("score"))
    return K.select_with_caps(rows)


@query(f"""WITH a AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), p AS (SELECT doc_id, s[1] AS t, list_filter(s[2:], lambda x: length(x) > 40 AND x <> s[1] AND NOT {like('x', T.ADVICE)}) AS pool, list_filter(regexp_extract_all(lower(s[1]), '\\b[a-z]{{5,}}\\b'), lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in K.STOPWORDS)}], w)) AS words FROM a WHERE len(s) > 0),
 c AS (SELECT doc_id, pool, list_filter(pool, lambda x: len(list_filter(words, lambda w: contains(lower(x), w))) > 0) AS related FROM p),
 r AS (SELECT doc_id, list_sort(list_transform(CASE WHEN len(related) > 0 THEN related ELSE pool END, lambda x, i: struct_pack(score := -(least(3, len(regexp_extract_all(x, '{T.RISK_SIGNAL}'))) + least(2, len(regexp_extract_all(x, '(?i)\\b(the|der)\\b'))) + CASE WHEN length(x) BETWEEN 60 AND 300 THEN 1 ELSE 0 END), i := i, x := x)))[:2] AS best FROM c)
 SELECT doc_id, generate_subscripts(best, 1) - 1 AS pos, unnest(best).x AS sentence FROM r""")
def i9_supporting_sentences(t):
    # get: a text without a sentence has no title
    best = K.let(T.split_sentences(F.col("text")), lambda s: K.supporting_sentences(s, F.get(s, F.lit(0)), r"\b(the|der)\b"))
    # outer: else the planner finds the sentences once more, before rows are dealt, to see whether there are any
    return dealt(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode_outer(best).alias("pos", "sentence")).where("pos IS NOT NULL")


@query("""SELECT o_orderkey, CASE WHEN weak THEN 'low' ELSE 'medium' END AS confidence, weak AS needs_review FROM (SELECT o_orderkey, o_orderstatus = 'P' OR o_custkey % 5 = 0 OR length(regexp_replace(q, '[^0-9]', '', 'g')) > 0.25 * length(regexp_replace(lower(q), '[^a-z0-9]', '', 'g')) AS weak
  FROM (SELECT *, o_orderpriority || ' ' || o_orderkey || repeat(' words', CAST(o_custkey % 9 AS INT)) AS q FROM orders))""")
def i10_calibrate(t):
    q = F.expr("o_orderpriority || ' ' || o_orderkey || repeat(' words', CAST(o_custkey % 9 AS INT))")
    c, r = K.calibrate(F.col("o_orderstatus") != "P", F.col("o_custkey") % 5, q)
    return t.orders.select("o_orderkey", c.alias("confidence"), r.alias("needs_review"))
