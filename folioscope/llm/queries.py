"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, flac, hmm, interactions, jaccard, langid, mixing, packing, shards, squares, templates, toxicity, vantage


#: Path of the rank file for op6, on the driver; the session's setting spark.folioscope.vocabulary names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def tokenizer_file(spark: SparkSession) -> str:
    """Path of the vocabulary file for op13, on the driver; the session's setting spark.folioscope.tokenizer names another."""
    path = spark.conf.get("spark.folioscope.tokenizer", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), max_epochs=2.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(common.fold() != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(common.fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(common.fold() != 0))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(common.fold() == 0, F.lit(False)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), spark.conf.get("spark.folioscope.vocabulary", VOCABULARY))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("trains", common.fold() != 1)
    return hmm.score(docs, "trains").withColumn("held_out", F.coalesce(common.fold() == 1, F.lit(False)))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(own)))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.encode_texts(table(spark, sf_dir, "documents")))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.kd_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))  # heavy: a parameter of the operator


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interactions.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions.audit(rows, lost={"good_lost": "good", "toxic_lost": "toxic"})


def op12_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.cluster(table(spark, sf_dir, "embeddings"))


def op13_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares.pack_squares(table(spark, sf_dir, "documents"), tokenizer_file(spark))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_toxicity, op3_decontamination, op4_jaccard_join, op5_language_id, op6_packing, op7_hmm, op8_chat_format, op9_flac, op10_kd_shards,
    op11_filter_audit, op12_vantage_clusters, op13_sum_of_squares,
)}

#: Turns that hold a control string are escaped, which doubles each of their backslashes, < and #.
_OP8 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
 t AS (SELECT *, contains(text, '</turn>') OR contains(text, '### ') AS held FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || text || ' </turn>' || chr(10)) + CASE WHEN held THEN 1 + length(text) - length(regexp_replace(text, '[\\<#]', '', 'g')) ELSE 0 END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

#: Each filter's failures row by row; every order's steps are then tried against the patterns, letter by letter.
_OP11 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 g AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
 s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, CAST(i AS INTEGER), 1) AS own, left(filter_order, i - 1) AS before FROM o, range(1, 6) r(i)),
 m AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, translate(fails, before, '') = fails AS there, fails = own AS alone FROM g, s),
 r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (there AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (there AND hit), 0) AS BIGINT) AS removed,
   CAST(coalesce(sum(n) FILTER (hit AND NOT there), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
   CAST(coalesce(sum(good) FILTER (there AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (there AND hit), 0) AS BIGINT) AS toxic_lost FROM m GROUP BY part, filter_order, step, own)
 SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, in each round; sums of components by their place."""
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
 c0 AS MATERIALIZED (SELECT r AS c, v AS m FROM v WHERE r < {k})"""
    near = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i}) GROUP BY vec_id"
    for i in range(rounds):
        out += f""",
 a{i} AS MATERIALIZED ({near.format(i=i)}),
 s{i} AS (SELECT c, j, sum(x) AS t, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i} JOIN v USING (vec_id)) GROUP BY c, j),
 n{i} AS (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c),
 c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN n{i} n USING (c))"""
    return out + f""",
 a AS MATERIALIZED ({near.format(i=rounds)})
 SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN c{rounds} USING (c)"""


ORACLE: dict[str, str] = {"op8_chat_format": _OP8, "op11_filter_audit": _OP11, "op12_vantage_clusters": _op12()}
