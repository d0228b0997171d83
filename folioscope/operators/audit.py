"""Run audits: counts, drift, provenance, duplicates, review queues, incremental work."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.evidence import verify_quotes
from folioscope.operators.risks import MAIN_SECTION
from folioscope.sources.scratch import cut

#: Relative changes that count as drift.
DRIFT = {"sections": 0.25, "chunks": 0.25, "risks": 0.3, "tables": 0.3}


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


# --- duplicates, schema, merges ---------------------------------------------------------------


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def suffix_duplicate_ids(df: DataFrame, doc: str = "document_id", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """The second and later rows of an id in a document get `-<pos>`."""
    n = F.row_number().over(Window.partitionBy(doc, id_col).orderBy(pos))
    return df.withColumn("_n", n).withColumn(id_col, F.when(F.col("_n") == 1, F.col(id_col)).otherwise(F.concat_ws("-", id_col, pos))).drop("_n")


def shared_titles(df: DataFrame, n: int = 90, title_col: str = "title") -> DataFrame:
    """(title_key, n) of title keys' first n characters that several rows share."""
    key = F.substring(T.norm_title(F.col(title_col)), 1, n).alias("title_key")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def near_duplicate_titles(df: DataFrame, n: int = 90, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """(title_key, n, id): each row whose title key's first n characters others share; a row an id, so no key is too much for a task."""
    rows = df.select(F.col(id_col).alias("id"), F.substring(T.norm_title(F.col(title_col)), 1, n).alias("title_key"))
    return rows.join(shared_titles(df, n, title_col), "title_key").select("title_key", "n", "id")


def schema_violations(df: DataFrame, spec: dict[str, dict], id_col: str = "id") -> DataFrame:
    """(id, column, violation). spec: column to {required, enum, non_empty, url}."""
    checks = []
    for name, rule in spec.items():
        c = F.col(name)
        hit = lambda cond, what, name=name: F.when(cond, F.struct(F.lit(name).alias("column"), F.lit(what).alias("violation")))
        if rule.get("required"):
            checks.append(hit(c.isNull(), "missing"))
        if "enum" in rule:
            checks.append(hit(c.isNotNull() & ~c.isin(rule["enum"]), "not in enum"))
        if rule.get("non_empty"):
            checks.append(hit(c.isNull() | (F.size(c) == 0), "empty list"))
        if rule.get("url"):
            checks.append(hit(c.isNotNull() & ~c.rlike("^https?://[^ ]+$"), "not a URL"))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*checks))).alias("v")).select("id", "v.*")


def _nested(value: Column, spec: dict, path: Column) -> Column:
    """The violations at and below a value, as an array of (path, violation)."""
    kind = "array<struct<path: string, violation: string>>"
    none = F.array().cast(kind)
    own = lambda cond, what: F.when(F.coalesce(cond, F.lit(False)), F.struct(path.alias("path"), F.lit(what).alias("violation")))
    checks, below = [], []
    if spec.get("required"):
        checks.append(own(value.isNull(), "missing"))
    if "enum" in spec:
        checks.append(own(value.isNotNull() & ~value.isin(*spec["enum"]), "not in enum"))
    if spec.get("non_empty"):
        checks.append(own(F.size(value) == 0, "empty list"))
    if "min_length" in spec:
        checks.append(own(F.length(value) < spec["min_length"], "too short"))
    if spec.get("url"):
        checks.append(own(~value.rlike("^https?://[^ ]+$"), "not a URL"))
    if "min" in spec:
        checks.append(own(value < spec["min"], "too small"))
    if "max" in spec:
        checks.append(own(value > spec["max"], "too large"))
    for name, sub in spec.get("fields", {}).items():
        below.append(_nested(value.getField(name), sub, F.concat(path, F.lit(f".{name}"))))
    if "items" in spec:
        below.append(F.flatten(F.transform(value, lambda x, i: _nested(x, spec["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    if "values" in spec:
        below.append(F.flatten(F.transform(F.map_entries(value), lambda e: _nested(e["value"], spec["values"], F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))))))
    here = F.array_compact(F.array(*checks)).cast(kind) if checks else none
    return F.concat(here, F.when(value.isNotNull(), F.concat(*below)).otherwise(none)) if below else here


def nested_violations(df: DataFrame, spec: dict[str, dict], id_col: str = "id") -> DataFrame:
    """(id, path, violation) of nested rows, in one pass over the table.

    spec: column to its rules: required, enum, non_empty (lists and maps), min_length, url, min, max; and
    fields (of a struct: name to rules), items (rules of every list entry), values (rules of every map value). A
    path names fields by dots and entries by place or key, as in sections[0].items[2].confidence. What is null is
    only checked for `required`, and nothing is checked below it. Repeated rows are each reported.
    """
    found = F.concat(*[_nested(F.col(name), rules, F.lit(name)) for name, rules in spec.items()])
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("v")).select("id", "v.*")


def merge_reviewed(generated: DataFrame, reviewed: DataFrame, id_col: str = "id", pos: str = "pos") -> DataFrame:
    """generated with rows replaced by id from reviewed (its last duplicate wins), then reviewed-only rows, all of them.

    Both have the same columns; the result's pos orders generated rows first.
    """
    cols = [c for c in generated.columns if c not in (id_col, pos)]
    last = reviewed.groupBy(id_col).agg(F.max_by(F.struct(*cols), pos).alias("_r"))
    kept = generated.join(last, id_col, "left").select(id_col, F.lit(0).alias("_src"), pos, F.coalesce("_r", F.struct(*cols)).alias("_x"))
    extra = reviewed.join(generated.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.lit(1).alias("_src"), pos, F.struct(*cols).alias("_x"))
    rows = kept.unionByName(extra)
    return rows.select(id_col, F.struct("_src", pos).alias("order"), "_x.*")


def assemble_facts(families: list[DataFrame], columns: list[str], pos: str = "n") -> DataFrame:
    """Fact families in the given order with one position a document, ids made unique (families: document_id, id, n, columns)."""
    rows = union(*[f.select("document_id", "id", F.lit(i).alias("family"), F.col(pos).alias("n"), *columns) for i, f in enumerate(families)])
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("document_id").orderBy("family", "n", "id")) - 1).cast("int"))
    return suffix_duplicate_ids(rows)


def missing_items(required: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.dropDuplicates(["severity", "check", "id", "detail"])


# --- aggregates -------------------------------------------------------------------------------


def category_concentration(df: DataFrame, doc: str = "document_id", category: str = "category") -> DataFrame:
    """(doc, n_categories, n): documents with 10 or more rows in at most 2 categories."""
    return df.groupBy(doc).agg(F.countDistinct(category).alias("n_categories"), F.count(F.lit(1)).alias("n")).where("n_categories <= 2 and n >= 10")


def run_counts(run_id: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, metric, value): rows of each table."""
    return union(*[df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("metric"), "value") for name, df in tables.items()])


def table_link_summary(tables: DataFrame) -> DataFrame:
    linked = F.count("section_id")
    return tables.agg(F.count(F.lit(1)).alias("total"), linked.alias("associated"), (F.count(F.lit(1)) - linked).alias("unassociated"))


def risk_counts(risks: DataFrame) -> DataFrame:
    """(dimension, value, n) by category, type and section in one pass."""
    dims = ["category", "risk_extraction_type", "source_section_id"]
    rows = risks.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "risk_extraction_type").otherwise("source_section_id")
    value = F.when(F.col("g") == 3, F.col("category")).when(F.col("g") == 5, F.col("risk_extraction_type")).otherwise(F.col("source_section_id"))
    return rows.select(name.alias("dimension"), value.alias("value"), "n")


def risk_length_counts(risks: DataFrame) -> DataFrame:
    n = F.col("character_length")
    return risks.agg(*[F.count_if(n < k).alias(f"under_{k}") for k in (150, 300, 500)], F.count(F.lit(1)).alias("total"))


def shortest_risks(risks: DataFrame, k: int = 50) -> DataFrame:
    return risks.orderBy("character_length", "pos").limit(k)


def risk_flags(risks: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(flag, id): records without a title, with little body, like a table of contents, too short, or outside the main section."""
    title, n = F.coalesce("title", F.lit("")), F.col("character_length")
    tests = [
        F.when((title == "") | (title == "Risk factor"), "missing_title"),
        F.when((F.col("risk_extraction_type") == "heading_only") | (n < F.length(title) + 160), "little_body"),
        F.when(F.col("risk_extraction_type") == "toc_entry", "contents_like"),
        F.when(n < 500, "below_minimum"),
    ]
    out = risks.select(F.explode(F.array_compact(F.array(*tests))).alias("flag"), "id")
    if chunks is None:
        return out
    cited = risks.select("id", F.explode("source_chunk_ids").alias("chunk_id"))
    main = chunks.where(F.trim("title") == MAIN_SECTION).select(F.col("id").alias("chunk_id"))
    return out.union(cited.join(main, "chunk_id", "left_anti").select(F.lit("outside_section"), "id").distinct())


def risk_samples(risks: DataFrame, k: int = 20) -> DataFrame:
    """(sample, pos, id): the first k normal and the first k suspicious records by position."""
    kind = F.when(F.col("risk_extraction_type") == "full_text", "normal")
    odd = F.when(F.col("needs_review") | F.col("extraction_warning").isNotNull(), "suspicious")
    rows = risks.select(F.explode(F.array_compact(F.array(kind, odd))).alias("sample"), "pos", "id")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("sample").orderBy("pos", "id"))).where(F.col("n") <= k).drop("n")


# --- drift and incremental work ---------------------------------------------------------------


def snapshot_drift(previous: DataFrame, current: DataFrame, thresholds: dict[str, float] = DRIFT) -> DataFrame:
    """(metric, previous, current, warning) of metrics that moved too far.

    previous and current: (metric, value). Counts move by their share of the previous value (from 0:
    0 or 1); metrics named flag:* warn on any change, facts on any fall. Without a previous run there
    is one baseline note.
    """
    p, c = previous.select("metric", F.col("value").alias("previous")), current.select("metric", F.col("value").alias("current"))
    rows = p.join(c, "metric", "full")
    change = F.when(F.col("previous") == 0, F.when(F.col("current") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("current") - F.col("previous")) / F.col("previous"))
    limit = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in thresholds.items()])
    warning = F.when(change > limit, "count moved").when((F.col("metric") == "facts") & (F.col("current") < F.col("previous")), "facts fell").when(F.col("metric").startswith("flag:") & ~F.col("previous").eqNullSafe(F.col("current")), "coverage changed")
    found = rows.withColumn("warning", warning).where("warning is not null")
    none = previous.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    base = none.select(F.lit("baseline").alias("metric"), F.lit(None).cast("long").alias("previous"), F.lit(None).cast("long").alias("current"), F.lit("no previous snapshot").alias("warning"))
    return found.join(none.select(F.lit(True).alias("_none")), how="left").where("_none is null").drop("_none").unionByName(base)


def source_hashes(raw: DataFrame, id_col: str = "document_id", html_col: str = "html") -> DataFrame:
    return raw.select(id_col, F.sha2(F.col(html_col).cast("binary"), 256).alias("sha256"), F.octet_length(html_col).cast("long").alias("size_bytes"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): a hash of the table that doesn't depend on row order or partitions.

    A row's SHA-256 is that of its columns' SHA-256 (a null's is empty); four numbers of 15 hex digits each
    of the rows' hashes are summed, so partial sums are all that is shuffled.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.sha2(F.col(f"`{c}`").cast("string").cast("binary"), 256), F.lit("")) for c in df.columns]), 256)
    part = lambda i: F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    rows = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i in range(4)])
    return rows.select("rows", F.concat_ws("-", "s0", "s1", "s2", "s3").alias("fingerprint"))


def needs_processing(hashes: DataFrame, manifest: DataFrame, versions: dict[str, str], force: bool = False, id_col: str = "document_id") -> DataFrame:
    """hashes of documents that are new, changed, made by other extractor versions, or all with force."""
    if force:
        return hashes
    m = manifest.select(id_col, F.col("sha256").alias("_sha"), F.col("versions").alias("_v"))
    rows = hashes.join(m, id_col, "left")
    same = F.col("sha256").eqNullSafe(F.col("_sha"))
    for k, v in versions.items():
        same = same & F.col("_v")[k].eqNullSafe(F.lit(v))
    return rows.where(~same).select(hashes.columns)


# --- validation -------------------------------------------------------------------------------


def entries(df: DataFrame, rows: Sequence[tuple] = (), counts: dict[str, Column | None] | None = None, keys: dict[str, tuple] | None = None) -> DataFrame:
    """(kind, check, id, detail) of everything that checks need of a table, in one pass over it.

    rows: (severity, check, condition, id, detail): problems of single rows. counts: metric to
    the condition under which a row counts (None: always). keys: check to (id, detail, condition), to
    be counted or compared later; condition may be left out. A null condition is false.
    """
    text = lambda x: F.lit(None).cast("string") if x is None else (F.col(x) if isinstance(x, str) else x).cast("string")
    entry = lambda kind, check, id_, detail: F.struct(F.lit(kind).alias("kind"), F.lit(check).alias("check"), text(id_).alias("id"), text(detail).alias("detail"))
    out = [F.when(cond, entry(severity, check, id_, detail)) for severity, check, cond, id_, detail in rows]
    out += [F.when(F.lit(True) if cond is None else cond, entry("count", name, None, None)) for name, cond in (counts or {}).items()]
    out += [F.when(F.lit(True) if len(k) < 3 else k[2], entry("key", name, k[0], k[1])) for name, k in (keys or {}).items()]
    return df.select(F.explode(F.array_compact(F.array(*out))).alias("e")).select("e.*")


def gathered(*tables: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(kind, check, id, detail, n) of all entries, counted once for all checks and written; and the metrics among them."""
    found = cut(union(*tables).groupBy("kind", "check", "id", "detail").agg(F.count(F.lit(1)).alias("n")), "checks")
    metrics = {r["check"]: r["n"] for r in found.where("kind = 'count'").collect()}  # a row a metric
    return found, metrics


def problems(found: DataFrame, noted: list[tuple], *others: DataFrame) -> DataFrame:
    """(severity, check, id, detail): the entries that are problems, those noted from metrics as (severity, check, id, detail), and others'."""
    local = found.sparkSession.createDataFrame([(s, c, i, None if d is None else str(d)) for s, c, i, d in noted], "severity string, check string, id string, detail string")
    return distinct_warnings(union(found.where("kind in ('error', 'warning')").select(F.col("kind").alias("severity"), "check", "id", "detail"), local, *others))


def _found(df: DataFrame, severity: str, check: str | Column, id_: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), (check if isinstance(check, Column) else F.lit(check)).alias("check"), id_.cast("string").alias("id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def report_entries(report: DataFrame, severity: str) -> DataFrame:
    """An extraction report's (level, message) own errors or warnings."""
    return entries(report, [(severity, f"extraction report {severity}", F.col("level") == severity, None, "message")])


def wrong_quotes(records: dict[str, tuple[DataFrame, str]], chunks: DataFrame, mode: str) -> DataFrame:
    """(severity, check, id, detail) of the citations of several kinds of records that fail; each chunk is read once for all. records: name to (records, severity)."""
    rows = union(*[df.select(F.struct(F.lit(name).alias("kind"), F.lit(severity).alias("severity"), F.col("id").cast("string").alias("id")).alias("id"), "source_chunk_ids", "source_quote") for name, (df, severity) in records.items()])
    bad = verify_quotes(rows, chunks, mode)
    severity = F.when(F.col("check") == "missing_chunk", "error").otherwise(F.col("id.severity"))
    return bad.select(severity.alias("severity"), F.concat_ws(" ", "id.kind", "check").alias("check"), F.col("id.id").alias("id"), F.col("chunk_id").cast("string").alias("detail"))


def validate_corpus(documents: DataFrame, sections: DataFrame, chunks: DataFrame, facts: DataFrame, risks: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """(severity, check, id, detail) of fatal problems, and warnings of weak risk provenance; report: (level, message) rows of the extraction.

    Every table is passed over once for all of its checks, and once more where quotes are compared.
    """
    url = lambda n: ("error", f"{n} without source URL", F.coalesce("source_url", F.lit("")) == "", "id", None)
    sources = lambda n: ("error", f"{n} without sources", F.coalesce(F.size("source_chunk_ids"), F.lit(0)) <= 0, "id", None)
    tables = [
        entries(documents, [url("document")], {"main documents": T.has(F.col("type"), "(?i)^s-?1$")}, {"document": ("id", None)}),
        entries(sections, [url("section")], {"sections": None, "risk sections": F.col("normalized_title").contains("risk factors")}, {"section": ("id", None)}),
        entries(chunks, [url("chunk"), ("error", "empty chunk", T.norm_ws(F.col("text")) == "", "id", None)], {"chunks": None}, {"chunk": ("id", None)}),
        entries(facts, [sources("fact"), ("error", "prohibited language", T.has_prohibited_language(F.concat_ws(" ", "plain_english", "investor_relevance")), "id", None)], None, {"fact": ("id", None)}),
        entries(risks, [sources("risk"), ("warning", "weak quote provenance", F.coalesce("source_quote", F.lit("")) == "", "id", None)], None, {"risk": ("id", None), "risk section": ("source_section_id", "id")}),
    ]
    if report is not None:
        tables.append(report_entries(report, "error"))
    found, n = gathered(*tables)
    noted = [("error", check, None, None) for metric, check in (("main documents", "no main document"), ("sections", "no sections"), ("chunks", "no chunks"), ("risk sections", "no risk section")) if not n.get(metric)]
    keys = found.where("kind = 'key'")
    twice = keys.where("n > 1 and check <> 'risk section'")
    known = keys.where("check = 'section' and id is not null").select("id")
    lost = keys.where("check = 'risk section'").join(known, "id", "left_anti")
    return problems(
        found, noted, _found(twice, "error", F.concat(F.lit("duplicate "), "check", F.lit(" id")), F.col("id")), _found(lost, "warning", "weak section provenance", F.col("detail")),
        wrong_quotes({"fact": (facts, "error"), "risk": (risks, "warning")}, chunks, "exact"),
    )


def warn_corpus(sections: DataFrame, chunks: DataFrame, facts: DataFrame, risks: DataFrame, tables: DataFrame, golden: DataFrame | None = None, report: DataFrame | None = None, min_sections: int = 50, min_facts: int = 25, full_text: tuple[int, int] = (40, 220), max_weak_sections: int = 10, large_chunk: int = 2500) -> DataFrame:
    """(severity, check, id, detail) of warnings against thresholds, without duplicates; every table is passed over once."""
    kind, title = F.col("risk_extraction_type"), T.norm_title(F.coalesce("title", F.lit("")))
    rows = [
        entries(sections, counts={"sections": None, "weak sections": (F.length("text") < 80) | (F.length("title") < 3)}),
        entries(facts, counts={"facts": None}, keys={"category": ("document_id", "category")}),
        entries(risks, counts={"full text": kind == "full_text", "suspicious risks": kind != "full_text", "short risks": F.col("character_length") < 500}, keys={"title": (F.substring(T.norm_title(F.col("title")), 1, 90), None)}),
        entries(chunks, counts={"large untitled chunks": title.isin("", "untitled") & (F.length("text") > large_chunk)}), entries(tables, counts={"unlinked tables": F.col("section_id").isNull()}),
    ]
    if report is not None:
        rows.append(report_entries(report, "warning"))
    if golden is not None:
        rows.append(entries(golden, [("warning", "missing expected section", ~F.col("found"), "id", "document_id")]))
    found, n = gathered(*rows)
    at = lambda metric: n.get(metric, 0)
    shared = found.where("kind = 'key' and check = 'title' and n > 1").count()
    checks = [
        ("few sections", at("sections") < min_sections, at("sections")), ("few facts", at("facts") < min_facts, at("facts")), ("full-text risks out of range", not full_text[0] <= at("full text") <= full_text[1], at("full text")),
        ("weak sections", at("weak sections") > max_weak_sections, at("weak sections")), *[(c, at(c) > 0, at(c)) for c in ("suspicious risks", "large untitled chunks", "unlinked tables", "short risks")], ("duplicate risk titles", shared > 0, shared),
    ]
    few = found.where("kind = 'key' and check = 'category'").groupBy("id").agg(F.count("detail").alias("k"), F.sum("n").alias("n")).where("k <= 2 and n >= 10")
    return problems(found, [("warning", check, None, value) for check, hit, value in checks if hit], _found(few, "warning", "facts in few categories", F.col("id"), F.col("k")))


def review_queue(facts: DataFrame, risks: DataFrame, sections: DataFrame) -> DataFrame:
    """(kind, id, reason) of everything that a person should look at."""
    return union(
        facts.where("needs_review").select(F.lit("fact").alias("kind"), "id", F.lit("marked for review").alias("reason")),
        risks.where("needs_review or extraction_warning is not null").select(F.lit("risk").alias("kind"), "id", F.coalesce("extraction_warning", F.lit("marked for review")).alias("reason")),
        sections.where((F.length("text") < 80) | (F.length("title") < 3)).select(F.lit("section").alias("kind"), "id", F.lit("short text or title").alias("reason")),
    )
