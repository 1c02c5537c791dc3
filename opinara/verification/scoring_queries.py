"""Requests, responses, alignment, the error gate and the plug-in points."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara import schemas
from opinara.functions.rounding import py_round
from opinara.operators import embed as E
from opinara.operators import scoring as C
from opinara.operators.store import OpinionStore
from opinara.session import scratch_path
from opinara.sources import feeds
from opinara.verification.reading_queries import _query_vector
from opinara.verification.registry import query
from opinara.verification.sql_views import py_round as R_, sql

_REQ = """WITH r AS (SELECT 'item-' || doc_id AS custom_id, 'SUBJECT: ' || lang || chr(10) || chr(10) || 'POST TITLE: Document ' || doc_id || chr(10) || chr(10) || 'POST BODY: '
                     || substr(text, 1, 1500) AS content FROM documents)
"""


def _doc_requests(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("lang").alias("display"),
                                                 F.concat(F.lit("Document "), "doc_id").alias("title"), "text")
    return C.stance_requests(docs)


@query("p14_stance_requests", _REQ + "SELECT custom_id, md5(content) AS content_md5 FROM r")
def p14(spark, d):
    return _doc_requests(spark, d).select("custom_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("p14_sentiment_requests", sql("items_e", """
SELECT 'item-' || event_id AS custom_id, 'SOURCE: ' || source || chr(10) || 'TITLE: ' || event_type || chr(10) || 'CONTENT: ' || text AS content FROM items_e"""))
def p14_sentiment(spark, d):
    return C.sentiment_requests(A.items_e(spark, d).withColumn("title", F.col("event_type")), "event_id")


_REASON = """CASE WHEN error_class IS NOT NULL THEN 'error' WHEN event_id % 50 = 0 THEN 'unparseable' WHEN event_id % 40 = 0 THEN 'irrelevant' END"""


@query("p15_parsed_responses", sql("responses_e", f"""
SELECT custom_id, {_REASON} AS drop_reason, CASE WHEN error_class IS NULL AND event_id % 50 <> 0 THEN score END AS score,
       CASE WHEN error_class IS NULL AND event_id % 50 <> 0 THEN event_type ELSE '' END AS rationale FROM responses_e"""))
def p15(spark, d):
    return C.parse_stance(A.responses_e(spark, d)).select("custom_id", "drop_reason", "score", "rationale")


@query("p15_structured_sentiment", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE greatest(-1e0, least(1e0, CAST(event_id % 300 AS DOUBLE) / 100 - 1.5e0)) END AS sentiment_score,
       CASE WHEN event_id % 9 = 0 THEN 'unparseable' END AS drop_reason FROM events""")
def p15_sentiment(spark, d):
    n = F.col("event_id")
    body = F.to_json(F.struct((((n % 300) / 100) - 1.5).alias("sentiment_score"), F.array(F.lit("AA")).alias("tickers"),
                              F.array(F.lit("t")).alias("themes"), F.array(F.lit("b")).alias("bull_signals"),
                              F.when(n % 9 != 0, F.array().cast("array<string>")).alias("bear_signals")))
    return C.parse_sentiment(A.table(spark, d, "events").select("event_id", body.alias("body"))).select(
        "event_id", F.when(F.col("drop_reason").isNull(), F.col("sentiment_score")).alias("sentiment_score"), "drop_reason")


@query("j11_aligned_responses", sql("responses_e", f"""
SELECT event_id, CASE WHEN event_id % 45 = 7 THEN 'missing' ELSE {_REASON} END AS drop_reason,
       CASE WHEN event_id % 45 <> 7 AND {_REASON} IS NULL THEN score END AS score FROM responses_e"""))
def j11(spark, d):
    landed = C.parse_stance(A.responses_e(spark, d).filter("event_id % 45 != 7")).drop("event_id", "user_id")
    kept, dropped = C.align_responses(A.items_e(spark, d).select(F.col("event_id").alias("idx")), landed)
    return (kept.select(F.col("idx").alias("event_id"), F.lit(None).cast("string").alias("drop_reason"), "score")
            .unionByName(dropped.select(F.col("idx").alias("event_id"), "drop_reason", F.lit(None).cast("int").alias("score"))))


@query("a27_error_rates", sql("responses_e", f""",
g AS (SELECT user_id % 10 AS g, count(*) AS n, count(*) FILTER (e IS NOT NULL) AS errors, count(*) FILTER (e IN ('400', '401', '403', '404')) AS fatal
      FROM (SELECT user_id, CASE WHEN user_id % 10 = 3 AND event_id % 3 = 0 THEN '500' WHEN user_id % 10 = 4 AND event_id % 500 = 4 THEN '401' ELSE error_class END AS e FROM responses_e) GROUP BY 1)
SELECT g, n, errors, fatal, {R_('errors / n', 6)} AS error_rate, fatal > 0 OR errors / n > 0.25 AS broken FROM g"""))
def a27(spark, d):
    u, n = F.col("user_id"), F.col("event_id")
    error = F.when((u % 10 == 3) & (n % 3 == 0), "500").when((u % 10 == 4) & (n % 500 == 4), "401").otherwise(F.col("error_class"))
    rates = C.error_rates(A.responses_e(spark, d).withColumn("error_class", error).withColumn("g", u % 10), ["g"])
    return rates.withColumn("error_rate", py_round("error_rate", 6))


@query("ud2_injected_scorer", _REQ + "SELECT custom_id, CAST(length(content) % 201 - 100 AS INTEGER) AS score FROM r WHERE length(content) % 7 <> 0")
def ud2(spark, d):
    """A stand-in scorer: the stance is a function of the request's length."""
    def scorer(batches):
        for batch in batches:
            sizes = batch["content"].str.len()
            yield batch[["custom_id"]].assign(
                body=['{"relevant": %s, "score": %d, "rationale": "length"}' % (str(n % 7 != 0).lower(), n % 201 - 100) for n in sizes],
                error_class=None)
    return C.parse_stance(C.score_with(_doc_requests(spark, d), scorer)).filter("drop_reason is null").select("custom_id", "score")


@query("ud1_hashed_embeddings", """
SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS doc, 384 AS dim, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1e0 ELSE 0e0 END AS norm FROM conversations""")
def ud1(spark, d):
    """Every text with a word gets a unit vector of 384 numbers."""
    texts = A.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return E.embed_hashed(texts).select("doc", F.size("embedding").alias("dim"), py_round(F.sqrt(square), 4).alias("norm"))


@query("ud1_injected_encoder", "SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS doc, CAST(length(text) AS DOUBLE) AS first, 3 AS dim FROM conversations")
def ud1_encoder(spark, d):
    def load():
        return lambda texts: [[len(t), 0.0, 1.0] for t in texts]
    texts = A.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), "text")
    return E.embed_with(texts, load).select("doc", F.element_at("embedding", 1).cast("double").alias("first"), F.size("embedding").alias("dim"))


@query("ud3_registered_reader", """
SELECT source, count(*) AS n FROM (SELECT 'events' AS source FROM events UNION ALL SELECT 'documents' FROM documents) GROUP BY 1""")
def ud3(spark, d):
    def read_parquet(session, path, source):
        rows = session.read.parquet(path)
        known = {"source": F.lit(source), "text": F.coalesce(*[F.col(c) for c in ("text", "event_type") if c in rows.columns])}
        return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RAW_RECORD.fields])
    feeds.register_reader("parquet_table", read_parquet)
    landed = [("parquet_table", f"{d}/events.parquet", "events"), ("parquet_table", f"{d}/no-such-table-*.parquet", "nothing"),
              ("parquet_table", f"{d}/documents.parquet", "documents")]
    return feeds.read_sources(spark, landed).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("ud4_store_search", sql("vectors", f""",
s AS (SELECT CAST(v.external_id AS VARCHAR) AS external_id, list_cosine_similarity(v.embedding, q.embedding) AS s
      FROM vectors v, (SELECT embedding FROM vectors WHERE external_id = 0) q WHERE v.subject = '3')
SELECT external_id, {R_('s', 4)} AS similarity FROM s ORDER BY s DESC, external_id LIMIT 25"""))
def ud4(spark, d):
    store = OpinionStore(spark, scratch_path(spark, "store"))
    rows = A.vectors(spark, d).withColumn("external_id", F.col("external_id").cast("string")).withColumn("ingest_seq", F.col("external_id").cast("bigint"))
    for field in schemas.ITEM.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    store.append_items(rows)
    return store.search(_query_vector(spark, d), 25, "3").select("external_id", py_round("similarity", 4).alias("similarity"))
