"""Sinks, keys, ledger, episodes, headlines, the subject dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara import schemas
from opinara.operators import coverage as C
from opinara.operators import readings as R
from opinara.operators.records import decode_readings
from opinara.operators.store import OpinionStore
from opinara.session import scratch_path
from opinara.sources import feeds, sinks, tables
from opinara.verification.registry import query
from opinara.verification.sql_views import sql, stamp


def _typed(df, schema):
    """Missing columns of a table as nulls."""
    for field in schema.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*schema.fieldNames())


# --- A14, S11, J5, U5 --------------------------------------------------------------------------
@query("a14_first_wins_by_text", "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def a14(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    return sinks.first_wins(docs, "text", "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("a14_first_wins_by_id_or_url", """
SELECT min(event_id) AS event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE 'id' || (event_id % 5000) END, 'url' || (event_id % 3000)) AS key
FROM events GROUP BY 2""")
def a14_key(spark, d):
    n = F.col("event_id")
    rows = A.table(spark, d, "events").select(
        n, F.when(n % 4 == 0, None).when(n % 4 == 1, "").otherwise(F.concat(F.lit("id"), n % 5000)).alias("external_id"),
        F.concat(F.lit("url"), n % 3000).alias("url"))
    return sinks.first_wins(rows.withColumn("key", sinks.item_key()), "key", "event_id").select("event_id", "key")


def _third_stored(spark, d):
    """A store that holds every third item, and all items."""
    items = _typed(A.items_e(spark, d), schemas.ITEM).withColumn("event_id", F.col("ingest_seq"))
    store = OpinionStore(spark, scratch_path(spark, "items"))
    store.append_items(items.filter("event_id % 3 = 0"))
    return store, items


@query("j5_drop_known_items", sql("items_e", "SELECT external_id, score FROM items_e WHERE event_id % 3 <> 0"))
def j5(spark, d):
    store, items = _third_stored(spark, d)
    return store.drop_known(items).select("external_id", "score")


@query("j5_known_ids", sql("items_e", "SELECT external_id FROM items_e WHERE event_id % 3 = 0 AND event_id % 2 = 0"))
def j5_semi(spark, d):
    store, items = _third_stored(spark, d)
    return store.known_ids(items.filter("event_id % 2 = 0"))


@query("u5_fetched_except_known", sql("items_e", """
SELECT external_id FROM items_e EXCEPT SELECT external_id FROM items_e WHERE event_id % 3 = 0"""))
def u5(spark, d):
    """What a fetch brought and the corpus lacks, by the sink's own rule."""
    items = A.items_e(spark, d)
    return sinks.new_items(items, items.filter("event_id % 3 = 0")).select("external_id")


@query("s11_item_sink", sql("items_e", """
SELECT subject, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, (SELECT count(*) FROM items_e WHERE event_id % 3 <> 0) AS inserted_second FROM items_e GROUP BY 1"""))
def s11(spark, d):
    """Write a third of the items, then everything twice; count what is new."""
    store = OpinionStore(spark, scratch_path(spark, "items"))
    items = _typed(A.items_e(spark, d), schemas.ITEM)
    store.append_items(items.filter("ingest_seq % 3 = 0"))
    inserted = store.append_items(items.unionByName(items))
    return store.items().groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")).withColumn(
        "inserted_second", F.lit(inserted).cast("bigint"))


@query("s12_reading_sink", sql("readings_e", f"""
SELECT subject, {stamp('computed_at')} AS computed_at, CASE WHEN day(readings_e.computed_at) > 25 THEN 'second' ELSE 'first' END AS label FROM readings_e"""))
def s12(spark, d):
    store = OpinionStore(spark, scratch_path(spark, "readings"))
    readings = _typed(A.readings_e(spark, d), schemas.READING)
    store.save_readings(readings.withColumn("label", F.lit("first")))
    store.save_readings(readings.filter("day(computed_at) > 25").withColumn("label", F.lit("second")))
    return store.readings().select("subject", F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss").alias("computed_at"), "label")


@query("s12_latest_write_wins", sql("items_e", """
SELECT subject, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, max(event_id) AS event_id FROM items_e GROUP BY 1, 2"""))
def s12_batch(spark, d):
    rows = A.items_e(spark, d).select("subject", F.col("ts").cast("date").cast("string").alias("day"), "event_id")
    return sinks.latest_write(rows, ["subject", "day"], "event_id")


@query("s14_daily_sink", sql("tiered", """
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, count(*) * CASE WHEN day(run_date) % 2 = 0 THEN 2 ELSE 1 END AS item_count FROM tiered GROUP BY tiered.run_date"""))
def s14(spark, d):
    store = OpinionStore(spark, scratch_path(spark, "daily"))
    counts = A.daily_e(spark, d).groupBy("run_date").agg(F.count(F.lit(1)).alias("item_count"))
    store.save_daily(_typed(counts, schemas.DAILY))
    store.save_daily(_typed(counts.filter("day(run_date) % 2 = 0").withColumn("item_count", F.col("item_count") * 2), schemas.DAILY))
    return store.daily().select(F.col("run_date").cast("string").alias("run_date"), "item_count")


@query("s15_seed_if_absent", sql("items_e", "SELECT count(*) AS n, TRUE AS first_applied, FALSE AS second_applied FROM items_e"))
def s15(spark, d):
    path = scratch_path(spark, "seed")
    items = A.items_e(spark, d).select("external_id", "score")
    first = sinks.seed_if_absent(spark, path, items)
    second = sinks.seed_if_absent(spark, path, items.limit(0))
    return spark.read.schema(items.schema).parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "first_applied", F.lit(first)).withColumn("second_applied", F.lit(second))


@query("s16_json_export", sql("months", "SELECT subject, period, consensus, n FROM months"))
def s16(spark, d):
    path = scratch_path(spark, "export")
    months = R.period_readings(A.items_o(spark, d))
    sinks.export_json(months, path)
    return spark.read.schema(months.schema).json(path)


@query("p17_decoded_readings", sql("readings_e", """
SELECT subject, strftime(computed_at, '%Y-%m-%d') AS day, volume % 2 = 1 AS is_financial, CASE WHEN volume % 3 = 0 THEN 0 ELSE 1 END AS n_citations,
       CASE WHEN volume % 5 <> 0 THEN CAST(volume AS INTEGER) END AS n_periods FROM readings_e"""))
def p17(spark, d):
    v = F.col("volume")
    stored = A.readings_e(spark, d).select(
        "subject", F.col("computed_at").cast("date").cast("string").alias("day"), (v % 2).cast("int").alias("is_financial"),
        F.when(v % 3 != 0, F.to_json(F.array(F.struct(F.lit(1).alias("n"), F.lit("s").alias("source"))))).alias("citations"),
        F.when(v % 5 != 0, F.to_json(F.struct(v.alias("n_periods")))).alias("backtest"))
    return decode_readings(stored).select("subject", "day", "is_financial", F.size("citations").alias("n_citations"),
                                          F.col("backtest.n_periods").alias("n_periods"))


# --- S8, P16, S9, U1, T8 -----------------------------------------------------------------------------
def _wide(spark, d):
    """A headline table: a row per day, one column per user residue, some cells empty."""
    n, day = F.col("event_id"), F.col("ts").cast("date").cast("string").alias("Date")
    events = A.table(spark, d, "events")
    text = F.when(n % 3 == 0, F.concat(F.lit('b"headline '), n, F.lit('"'))).when(n % 3 == 1, F.concat(F.lit("b'it moved "), n, F.lit("'"))).otherwise(
        F.concat(F.lit('"plain words '), n, F.lit('"')))
    tops = [F.max(F.when((F.col("user_id") % 5 == i) & (n % 7 == i), F.struct(n, text.alias("t")))).getField("t").alias(f"Top{i + 1}") for i in range(5)]
    return events.groupBy(day).agg(*tops, F.count(F.lit(1)).alias("Label"))


@query("s8_headlines_long", """
WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS run_date, user_id % 5 AS i, max(event_id) AS e FROM events WHERE event_id % 7 = user_id % 5 GROUP BY 1, 2),
days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_date FROM events ORDER BY 1 LIMIT 20)
SELECT run_date, CAST(i + 1 AS INTEGER) AS position, CASE e % 3 WHEN 0 THEN 'headline ' WHEN 1 THEN 'it moved ' ELSE 'plain words ' END || e AS headline
FROM m JOIN days USING (run_date)""")
def s8(spark, d):
    return tables.headlines_long(_wide(spark, d), 2024, 20)


@query("p16_headline_records", """
WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS run_date, user_id % 5 AS i, max(event_id) AS e FROM events WHERE event_id % 7 = user_id % 5 GROUP BY 1, 2)
SELECT 'news-historical' AS source, 2 AS source_tier, CASE e % 3 WHEN 0 THEN 'headline ' WHEN 1 THEN 'it moved ' ELSE 'plain words ' END || e AS title,
       run_date || ' 12:00:00' AS ts, CAST(0 AS BIGINT) AS raw_engagement, run_date FROM m""")
def p16(spark, d):
    records = tables.headline_records(tables.headlines_long(_wide(spark, d), 2024))
    return records.select("source", "source_tier", "title", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "raw_engagement", "run_date")


@query("s9_subject_dimension", """
WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 6 = 0 THEN '' ELSE 'P' || s_nationkey END AS proxy, s_suppkey % 4 <> 0 AS fin FROM supplier)
SELECT proxy, 'supplier ' || min(s_suppkey) AS input_key, 'Supplier ' || min(s_suppkey) AS display FROM s WHERE fin AND proxy <> '' GROUP BY 1""")
def s9(spark, d):
    key = F.col("s_suppkey")
    entry = F.concat(F.lit('"supplier '), key, F.lit('": {"display": "Supplier '), key, F.lit('", "asset_type": "stock", "is_financial": '),
                     F.when(key % 4 != 0, "true").otherwise("false"), F.lit(', "proxy": '),
                     F.when(F.col("s_nationkey") % 6 == 0, F.lit('""')).otherwise(F.concat(F.lit('"p'), F.col("s_nationkey"), F.lit('"'))),
                     F.lit(', "aliases": ["a", "b"], "subreddits": []}'))
    files = (A.table(spark, d, "supplier").groupBy(F.floor(key / 50).alias("file"))
             .agg(F.array_sort(F.collect_list(F.struct(key, entry.alias("e")))).alias("es"))
             .select("file", F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["e"]), ", "), F.lit("}")).alias("payload")))
    return tables.market_subjects(tables.parse_subjects(files, order="file")).select("proxy", "input_key", "display")


@query("u1_union_of_sources", """
SELECT source, count(*) AS n, count(points) AS with_points FROM (
  SELECT 'reddit/r/' || event_type AS source, NULL AS points FROM events UNION ALL SELECT 'news:' || lang, NULL FROM documents
  UNION ALL SELECT 'hackernews', conv_id FROM conversations) GROUP BY 1""")
def u1(spark, d):
    forum = A.table(spark, d, "events").select(F.concat(F.lit("reddit/r/"), "event_type").alias("source"))
    news = A.table(spark, d, "documents").select(F.concat(F.lit("news:"), "lang").alias("source"), F.col("text"))
    search = A.table(spark, d, "conversations").select(F.lit("hackernews").alias("source"), F.col("conv_id").alias("points"))
    return feeds.union_sources([forum, news, None, search]).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("points").alias("with_points"))


@query("u1_one_source_fails", """
SELECT 'news:' || lang AS source, 'ok' AS status, count(*) AS records FROM documents WHERE lang IN ('en', 'de') GROUP BY 1
UNION ALL SELECT 'hackernews', 'failed', 0 UNION ALL SELECT 'arxiv', 'absent', 0 UNION ALL SELECT 'union', 'records', count(*) FROM documents WHERE lang IN ('en', 'de')""")
def u1_isolated(spark, d):
    """Two feeds made of the documents, between them one file that cannot be read and one that is not there."""
    path = scratch_path(spark, "landed")
    docs = A.table(spark, d, "documents").select("lang", F.concat(
        F.lit("<item><title>Document "), "doc_id", F.lit("</title><link>https://n/"), "doc_id", F.lit("</link></item>")).alias("item"))
    for lang in ("en", "de"):
        pages = docs.filter(F.col("lang") == lang).groupBy((F.crc32(F.col("item").cast("binary")) % 8).alias("page")).agg(
            F.array_join(F.collect_list("item"), "").alias("i"))
        pages.select("page", F.concat(F.lit("<rss><channel>"), "i", F.lit("</channel></rss>")).alias("value")).write.partitionBy("page").text(f"{path}/{lang}")
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hits/page-0.json.gz")
    out = broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken)
    out.write(bytearray(b"not a gzip file"))
    out.close()
    records, status = feeds.land_sources(spark, [
        ("rss", f"{path}/en/*/*.txt", "news:en"), ("search_hits", f"{path}/hits/*", "hackernews"),
        ("atom", f"{path}/papers/*.xml", "arxiv"), ("rss", f"{path}/de/*/*.txt", "news:de")], f"{path}/records")
    return status.select("source", "status", "records").unionByName(
        records.agg(F.count("*").alias("records")).select(F.lit("union").alias("source"), F.lit("records").alias("status"), "records"))


# --- episodes: S13, A13, J6, J13, P12, W10 ----------------------------------------------------------------
_EP = """,
f AS (SELECT e.*, CAST(guid AS BIGINT) % 4 <> 1 AS named, CASE WHEN CAST(guid AS BIGINT) % 11 = 3 THEN 0 ELSE (SELECT count(*) FROM conversations c WHERE c.conv_id = CAST(e.guid AS BIGINT)) END AS n_segments,
      CASE WHEN CAST(guid AS BIGINT) % 13 = 5 THEN 'timeout' WHEN transcript_url IS NULL AND audio_url IS NULL THEN 'episode has neither a transcript nor audio' END AS error FROM episodes e),
o AS (SELECT *, CASE WHEN named AND error IS NULL AND n_segments > 0 THEN 1 ELSE 0 END AS good FROM f),
b AS (SELECT *, coalesce(sum(good) OVER (ORDER BY show_idx, feed_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o),
j AS (SELECT *, CASE WHEN NOT named THEN 'skipped' WHEN used >= 30 THEN NULL WHEN error IS NOT NULL THEN 'failed' WHEN n_segments = 0 THEN 'skipped' ELSE 'ok' END AS status FROM b),
k AS (SELECT *, CASE WHEN NOT named THEN 'no covered subject in metadata' WHEN status = 'failed' THEN error WHEN status = 'skipped' THEN 'no transcript available' END AS detail FROM j)
"""


def _flagged(spark, d):
    n = F.col("guid").cast("bigint")
    lengths = A.segments(spark, d).groupBy("guid").agg(F.count(F.lit(1)).alias("n_segments"))
    return A.episodes(spark, d).join(lengths, "guid", "left").select(
        "*", (n % 4 != 1).alias("named"), F.when(n % 13 == 5, "timeout").alias("error")).withColumn(
        "n_segments", F.when(n % 11 == 3, 0).otherwise(F.coalesce("n_segments", F.lit(0))))


def _outcomes(spark, d):
    return C.episode_outcomes(_flagged(spark, d), 30)


@query("p12_w10_episode_outcomes", sql("episodes", _EP + "SELECT guid, status, detail FROM k"))
def p12(spark, d):
    return _outcomes(spark, d).select("guid", "status", "detail")


@query("s13_a13_ledger", sql("episodes", _EP + """
SELECT status, count(*) AS episodes, CAST(sum(CASE WHEN status = 'ok' THEN n_segments ELSE 0 END) AS BIGINT) AS items FROM k WHERE status IS NOT NULL GROUP BY 1"""))
def s13(spark, d):
    store = OpinionStore(spark, scratch_path(spark, "ledger"))
    rows = _outcomes(spark, d).filter("status is not null").withColumn(
        "n_items", F.when(F.col("status") == "ok", F.col("n_segments")).otherwise(0).cast("int"))
    store.mark_episodes(_typed(rows.withColumn("n_items", F.lit(-1)), schemas.LEDGER))
    store.mark_episodes(_typed(rows, schemas.LEDGER))
    return store.ledger_stats()


@query("j6_unseen_episodes", sql("episodes", _EP + "SELECT guid FROM k WHERE status IS NULL"))
def j6(spark, d):
    ledger = _outcomes(spark, d).filter("status is not null")
    return C.unseen(A.episodes(spark, d), ledger).select("guid")


@query("j13_stored_counts", sql("episodes", _EP + """
SELECT guid, (SELECT count(*) FROM conversations c WHERE CAST(c.conv_id AS VARCHAR) = k.guid AND role = 'assistant') AS n_items FROM k"""))
def j13(spark, d):
    stored = A.segments(spark, d).filter("speaker = 'assistant'")
    return C.with_stored_counts(_outcomes(spark, d), stored).select("guid", F.col("n_items").cast("bigint").alias("n_items"))


@query("j12_scores_and_vectors", """
SELECT vec_id AS external_id, CAST(label AS INTEGER) AS score, len(embedding) AS dim FROM embeddings""")
def j12(spark, d):
    from opinara.operators.scoring import attach_scores
    v = A.vectors(spark, d)
    out = attach_scores(v.select("external_id"), v.select("external_id", F.col("subject").cast("int").alias("score")), v.select("external_id", "embedding"))
    return out.select("external_id", "score", F.size("embedding").cast("bigint").alias("dim"))
