"""Record normalisation, weights and the daily consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara.functions import scalars as S
from opinara.functions.rounding import py_round
from opinara.operators import daily as D
from opinara.operators import records as P
from opinara.verification.registry import query
from opinara.verification.sql_views import ODD_SPACES, SPACE_CLASS, SPACED_LETTERS, SPACED_SQL, py_round as R_, sql, stamp


def _date(df):
    return df.withColumn("run_date", F.col("run_date").cast("string"))


_DATE = "strftime(run_date, '%Y-%m-%d') AS run_date"


def _raw(spark, d):
    """Raw records out of documents: padded text, engagement of mixed kinds."""
    n = F.col("doc_id")
    score = F.when(n % 4 == 0, None).otherwise((n % 101) + 0.75)
    return A.table(spark, d, "documents").select(
        F.when(n % 9 == 0, None).otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("arxiv", "news:", "reddit/r/", "blog/")]),
                                                                 (n % 4 + 1).cast("int")), "source")).alias("source"),
        F.concat(F.lit("  Document "), n, F.lit(" ")).alias("title"),
        F.concat(F.lit(" \n"), F.translate("text", SPACED_LETTERS, ODD_SPACES), F.lit("\t ")).alias("text"),
        F.when(n % 5 == 0, None).otherwise(F.concat(F.lit("https://doc.example/"), n)).alias("url"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.struct(score.alias("score"), F.lit(None).cast("bigint").alias("num_comments"), F.lit(None).cast("double").alias("upvote_ratio"),
                 F.lit(None).cast("bigint").alias("points"), F.lit(None).cast("string").alias("author")).alias("metadata"),
        n.alias("ingest_seq"))


@query("p1_normalize_records", sql(("items_e",), f""",
raw AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CASE doc_id % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'news:' WHEN 2 THEN 'reddit/r/' ELSE 'blog/' END || source END AS source,
  {SPACED_SQL} AS text FROM documents)
SELECT doc_id AS ingest_seq, source, CASE WHEN starts_with(source, 'arxiv') THEN 1 WHEN starts_with(source, 'news') THEN 2 ELSE 3 END AS source_tier,
       'Document ' || doc_id AS title, md5(substr(regexp_replace(regexp_replace(text, '^{SPACE_CLASS}+', ''), '{SPACE_CLASS}+$', ''), 1, 500)) AS text_md5,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://doc.example/' || doc_id END AS url,
       CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 101 END AS raw_engagement FROM raw"""))
def p1(spark, d):
    return P.normalize(_raw(spark, d)).select("ingest_seq", "source", "source_tier", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                                              "url", "raw_engagement")


@query("p2_tier_of_source", sql("tiered", "SELECT source, source_tier, count(*) AS n FROM tiered GROUP BY 1, 2"))
def p2(spark, d):
    return (A.items_e(spark, d).groupBy("source", S.tier_for_source("source").alias("source_tier")).agg(F.count(F.lit(1)).alias("n")))


@query("p3_engagement", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS plain, CAST(trunc(value - 100) AS BIGINT) AS cut, 0 AS quoted FROM events""")
def p3(spark, d):
    events = A.table(spark, d, "events")
    return events.select("event_id", P.json_engagement("props", "$.k").alias("plain"), P.engagement(F.col("value") - 100).alias("cut"),
                         P.json_engagement(F.concat(F.lit('{"k": "'), F.col("event_id"), F.lit('"}')), "$.k").cast("int").alias("quoted"))


@query("p4_clamp", "SELECT event_id, greatest(-1e0, least(1e0, (value - 70) / 30)) AS clamped FROM events")
def p4(spark, d):
    return A.table(spark, d, "events").select("event_id", P.clamp_sentiment((F.col("value") - 70) / 30).alias("clamped"))


@query("p5_subject_filter", sql("items_e", """
SELECT 'U3' AS asked, count(*) AS n FROM items_e WHERE subject = 'U3' UNION ALL SELECT 'all', count(*) FROM items_e"""))
def p5(spark, d):
    items = A.items_e(spark, d)
    n = F.count(F.lit(1)).alias("n")
    return (P.for_subject(items, "U3").agg(n).select(F.lit("U3").alias("asked"), "n")
            .unionByName(P.for_subject(items, None).agg(n).select(F.lit("all").alias("asked"), "n")))


@query("p6_usable_items", """
SELECT vec_id AS external_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0""")
def p6(spark, d):
    n = F.col("vec_id")
    rows = A.table(spark, d, "embeddings").select(
        n.alias("external_id"), F.when(n % 3 != 0, F.col("embedding")).alias("embedding"), F.when(n % 5 != 0, n).alias("score"),
        F.when(n % 7 != 0, F.lit("2024-01-01").cast("timestamp")).alias("ts"), F.when(n % 11 != 0, F.lit("x")).otherwise(F.lit(" ")).alias("text"),
        F.when(n % 13 != 0, F.lit(True)).alias("relevant"))
    return P.relevant_only(P.with_text(P.dated_only(P.scored_only(P.with_embedding(rows))))).select("external_id")


@query("p7_directional_items", sql("tiered", "SELECT source_tier, count(*) AS n FROM tiered WHERE source_tier IN (2, 3) GROUP BY 1"))
def p7(spark, d):
    return P.directional_only(A.daily_e(spark, d)).groupBy("source_tier").agg(F.count(F.lit(1)).alias("n"))


@query("f6_f7_f8_item_weights", sql("daily_e", f"""
, w AS (SELECT ingest_seq, pow(0.5e0, greatest(0e0, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(CASE WHEN ingest_seq % 17 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE ts END)) / 3600000000e0) / 12e0) AS r,
       1e0 + 0.15e0 * ln(1e0 + greatest(0, raw_engagement - 20)) AS e, tier_w FROM daily_e),
x AS (SELECT *, r * e * tier_w AS p FROM w)
SELECT ingest_seq, {R_('r', 6)} AS recency, {R_('e', 6)} AS engagement, {R_('p', 6)} AS weight FROM x"""))
def f678(spark, d):
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    items = A.daily_e(spark, d).withColumn("ts", F.when(F.col("ingest_seq") % 17 != 0, F.col("ts"))).withColumn("raw_engagement", F.col("raw_engagement") - 20)
    raw = items.select("ingest_seq", S.recency_factor("ts", now).alias("r"), S.engagement_factor("raw_engagement").alias("e"),
                       S.item_weight("source_tier", "ts", "raw_engagement", now).alias("p"))
    return raw.select("ingest_seq", py_round("r", 6).alias("recency"), py_round("e", 6).alias("engagement"), py_round("p", 6).alias("weight"))


@query("f9_labels", sql("items_e", """
SELECT event_id, CASE WHEN score / 100e0 > 0.15e0 THEN 'bullish' WHEN score / 100e0 < -0.15e0 THEN 'bearish' ELSE 'neutral' END AS daily,
       CASE WHEN score > 15 THEN 'bullish' WHEN score < -15 THEN 'bearish' ELSE 'neutral' END AS reading FROM items_e"""))
def f9(spark, d):
    return A.items_e(spark, d).select("event_id", S.daily_label(F.col("score") / 100.0).alias("daily"), S.reading_label("score").alias("reading"))


@query("a3_weighted_mean", sql("daily_e", f"""
, r AS (SELECT run_date, coalesce(sum(weight * sentiment_score) / nullif(sum(weight), 0), 0) AS m FROM daily_e GROUP BY 1)
SELECT {_DATE}, {R_('m', 6)} AS weighted_mean FROM r"""))
def a3(spark, d):
    return _date(D.weighted_consensus(D.weighted(A.daily_e(spark, d)))).select("run_date", py_round("weighted_mean", 6).alias("weighted_mean"))


_HEAD = """,
t AS (SELECT run_date, source_tier, sum(weight * sentiment_score) / nullif(sum(weight), 0) AS m FROM daily_e WHERE source_tier <> 1 GROUP BY 1, 2),
s AS (SELECT run_date, stddev_pop(m) AS d, count(*) AS k FROM t GROUP BY 1),
h AS (SELECT run_date, coalesce(sum(weight * sentiment_score) / nullif(sum(weight), 0), 0) AS c, count(*) AS item_count,
      count(*) FILTER (weight > 0) AS contributing_count FROM daily_e GROUP BY 1)
"""
_CONF = "CASE WHEN k >= 2 THEN CASE WHEN d <= 0.2 THEN 'high' WHEN d <= 0.4 THEN 'medium' ELSE 'low' END WHEN k = 1 THEN 'single-source' ELSE 'none' END"


@query("a4_daily_consensus", sql("daily_e", _HEAD + f"""
SELECT {_DATE}, {R_('c', 4)} AS consensus_score, CASE WHEN c > 0.15 THEN 'bullish' WHEN c < -0.15 THEN 'bearish' ELSE 'neutral' END AS label,
       item_count, contributing_count FROM h"""))
def a4(spark, d):
    return _date(D.headline(D.weighted(A.daily_e(spark, d)))).select("run_date", "consensus_score", "label", "item_count", "contributing_count")


@query("a5_tier_means", sql("daily_e", _HEAD + f"SELECT {_DATE}, source_tier, {R_('m', 4)} AS tier_mean FROM t"))
def a5(spark, d):
    maps = D.headline(D.weighted(A.daily_e(spark, d))).select("run_date", F.explode("tier_means").alias("source_tier", "tier_mean"))
    return _date(maps)


@query("a6_a7_dispersion_and_confidence", sql("daily_e", _HEAD + f"""
SELECT {_DATE}, {R_('d', 4)} AS dispersion, d > 0.4 AS contested, {_CONF} AS confidence FROM s"""))
def a67(spark, d):
    return _date(D.headline(D.weighted(A.daily_e(spark, d)))).select("run_date", "dispersion", "contested", "confidence")


_TICK = """,
m AS (SELECT run_date, upper(trim(t)) AS ticker, weight, sentiment_score, ingest_seq * 65536 + i AS o
      FROM (SELECT run_date, weight, sentiment_score, ingest_seq, unnest([subject, upper(event_type)]) AS t, unnest([0, 1]) AS i FROM daily_e WHERE source_tier <> 1)),
g AS (SELECT run_date, ticker, coalesce(sum(weight * sentiment_score) / nullif(sum(weight), 0), 0) AS s, count(*) AS mentions,
      stddev_pop(sentiment_score) AS d, min(o) AS o FROM m GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@query("a8_ticker_consensus", sql("daily_e", _TICK + f""",
q AS (SELECT *, {R_('s', 4)} AS score FROM g)
SELECT {_DATE}, ticker, score, CASE WHEN s > 0.15 THEN 'bullish' WHEN s < -0.15 THEN 'bearish' ELSE 'neutral' END AS label, mentions,
       CASE WHEN d <= 0.2 THEN 'high' WHEN d <= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
       row_number() OVER (PARTITION BY q.run_date ORDER BY abs(score) DESC, o) AS rank FROM q"""))
def a8(spark, d):
    return _date(D.ticker_consensus(D.weighted(A.daily_e(spark, d)))).withColumn("rank", F.col("rank").cast("bigint"))


@query("a9_top_themes", sql("daily_e", f""",
m AS (SELECT run_date, trim(t) AS shown, lower(trim(t)) AS k, ingest_seq * 65536 + i AS o FROM (
      SELECT run_date, ingest_seq, unnest([upper(substr(event_type, 1, 1)) || substr(event_type, 2), ' u' || (user_id % 13)]) AS t, unnest([0, 1]) AS i FROM daily_e)),
g AS (SELECT run_date, k, count(*) AS n, min(o) AS o, arg_min(shown, o) AS theme FROM m GROUP BY 1, 2)
SELECT {_DATE}, row_number() OVER (PARTITION BY g.run_date ORDER BY n DESC, o) AS rank, theme, n FROM g QUALIFY rank <= 10"""))
def a9(spark, d):
    return _date(D.top_themes(A.daily_e(spark, d))).withColumn("rank", F.col("rank").cast("bigint"))


def _signal_sql(sign: str) -> str:
    return sql("daily_e", f""",
m AS (SELECT run_date, event_type || ' ' || (user_id % 17) AS v, ingest_seq FROM daily_e WHERE score {sign} 0),
g AS (SELECT run_date, lower(v) AS k, arg_min(v, ingest_seq) AS signal, min(ingest_seq) AS o FROM m GROUP BY 1, 2)
SELECT {_DATE}, row_number() OVER (PARTITION BY g.run_date ORDER BY o) AS rank, signal FROM g QUALIFY rank <= 10""")


@query("a10_bull_signals", _signal_sql(">"))
def a10_bull(spark, d):
    return _date(D.distinct_signals(A.daily_e(spark, d), "bull_signals")).withColumn("rank", F.col("rank").cast("bigint"))


@query("a10_bear_signals", _signal_sql("<"))
def a10_bear(spark, d):
    return _date(D.distinct_signals(A.daily_e(spark, d), "bear_signals")).withColumn("rank", F.col("rank").cast("bigint"))


def _listed_signals(name: str, sign: str) -> str:
    return f""",
{name}m AS (SELECT run_date, event_type || ' ' || (user_id % 17) AS v, ingest_seq FROM daily_e WHERE score {sign} 0),
{name}g AS (SELECT run_date, lower(v) AS k, arg_min(v, ingest_seq) AS signal, min(ingest_seq) AS o FROM {name}m GROUP BY 1, 2),
{name}t AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY o) AS rank FROM {name}g QUALIFY rank <= 10),
{name}_l AS (SELECT run_date, string_agg(signal, ',' ORDER BY rank) AS {name}_signals FROM {name}t GROUP BY 1)"""


_ALL_LISTS = f""",
q AS (SELECT *, {R_('s', 4)} AS score FROM g),
tk AS (SELECT run_date, string_agg(ticker || ':' || CAST(round(score * 10000) AS BIGINT) || ':' || CASE WHEN s > 0.15 THEN 'bullish' WHEN s < -0.15 THEN 'bearish' ELSE 'neutral' END
         || ':' || mentions || ':' || CASE WHEN d <= 0.2 THEN 'high' WHEN d <= 0.4 THEN 'medium' ELSE 'low' END, ',' ORDER BY abs(score) DESC, o) AS tickers FROM q GROUP BY 1),
tm AS (SELECT run_date, trim(t) AS shown, lower(trim(t)) AS k, ingest_seq * 65536 + i AS o FROM (
      SELECT run_date, ingest_seq, unnest([upper(substr(event_type, 1, 1)) || substr(event_type, 2), ' u' || (user_id % 13)]) AS t, unnest([0, 1]) AS i FROM daily_e)),
tg AS (SELECT run_date, k, count(*) AS n, min(o) AS o, arg_min(shown, o) AS theme FROM tm GROUP BY 1, 2),
tt AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY n DESC, o) AS rank FROM tg QUALIFY rank <= 10),
th AS (SELECT run_date, string_agg(theme || ':' || n, ',' ORDER BY rank) AS top_themes FROM tt GROUP BY 1),
tv AS (SELECT run_date, source_tier, {R_('m', 4)} AS v FROM t),
tl AS (SELECT run_date, string_agg(source_tier || ':' || CAST(round(v * 10000) AS BIGINT), ',' ORDER BY source_tier) AS tier_means FROM tv GROUP BY 1)"""


@query("daily_rows_complete", sql("daily_e", _HEAD + _TICK + _ALL_LISTS + _listed_signals("bull", ">") + _listed_signals("bear", "<") + f"""
SELECT strftime(h.run_date, '%Y-%m-%d') AS run_date, {R_('c', 4)} AS consensus_score, CASE WHEN c > 0.15 THEN 'bullish' WHEN c < -0.15 THEN 'bearish' ELSE 'neutral' END AS label,
       {_CONF} AS confidence, s.d > 0.4 AS contested, {R_('s.d', 4)} AS dispersion, item_count, contributing_count, coalesce(tier_means, '') AS tier_means,
       coalesce(tickers, '') AS tickers, coalesce(top_themes, '') AS top_themes, coalesce(bull_signals, '') AS bull_signals, coalesce(bear_signals, '') AS bear_signals
FROM h JOIN s USING (run_date) LEFT JOIN tk USING (run_date) LEFT JOIN th USING (run_date) LEFT JOIN tl USING (run_date)
LEFT JOIN bull_l USING (run_date) LEFT JOIN bear_l USING (run_date)"""))
def daily_rows(spark, d):
    """All columns of the daily row; lists as text."""
    def text(column: str, parts):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[p.cast("string") for p in parts(x)])), ",").alias(column)

    def scaled(x):
        return F.round(x * 10000).cast("bigint")
    rows = D.daily_consensus(A.daily_e(spark, d)).withColumn("tier_means", F.map_entries("tier_means"))
    return _date(rows).select(
        "run_date", "consensus_score", "label", "confidence", "contested", "dispersion", "item_count", "contributing_count",
        text("tier_means", lambda t: (t["key"], scaled(t["value"]))),
        text("tickers", lambda t: (t["ticker"], scaled(t["score"]), t["label"], t["mentions"], t["confidence"])),
        text("top_themes", lambda t: (t["theme"], t["n"])), F.array_join("bull_signals", ",").alias("bull_signals"),
        F.array_join("bear_signals", ",").alias("bear_signals"))


# --- scalar functions -----------------------------------------------------------------------------
@query("f2_bucket_keys", f"""
SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events""")
def f2(spark, d):
    ts = F.col("ts").cast("timestamp")
    return A.table(spark, d, "events").select("event_id", S.bucket_key(ts, "month").alias("month"), S.bucket_key(ts, "week").alias("week"))


@query("f3_items_per_calendar_period", sql("items_e", """,
cal AS (SELECT i AS back, date_trunc('week', TIMESTAMP '2024-01-25 12:00:00') - i * INTERVAL '7 days' AS s FROM range(5) t(i)),
mon AS (SELECT i AS back, date_trunc('month', TIMESTAMP '2024-01-25 12:00:00') - i * INTERVAL '1 month' AS s FROM range(3) t(i))
SELECT 'week' AS kind, back, strftime(s, '%Y-%m-%d') AS label, CAST(epoch(s) AS BIGINT) AS start_unix, CAST(epoch(s + INTERVAL '7 days') AS BIGINT) - 1 AS end_unix,
       count(event_id) AS n FROM cal LEFT JOIN items_e ON floor(epoch(ts)) BETWEEN epoch(s) AND epoch(s + INTERVAL '7 days') - 1 GROUP BY back, s
UNION ALL SELECT 'month', back, strftime(s, '%Y-%m'), CAST(epoch(s) AS BIGINT), CAST(epoch(s + INTERVAL '1 month') AS BIGINT) - 1,
       count(event_id) FROM mon LEFT JOIN items_e ON floor(epoch(ts)) BETWEEN epoch(s) AND epoch(s + INTERVAL '1 month') - 1 GROUP BY back, s"""))
def f3(spark, d):
    items = A.items_e(spark, d)
    out = None
    for kind, n in (("week", 5), ("month", 3)):
        cal = S.period_calendar(spark, "2024-01-25 12:00:00", kind, n)
        counts = items.groupBy(S.bucket_key("ts", kind).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        part = cal.join(counts, "label", "left").fillna(0, ["n"]).select(
            F.lit(kind).alias("kind"), F.col("back").cast("bigint").alias("back"), "label", "start_unix", "end_unix", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("f4_epoch_to_utc", f"""
SELECT event_id, {stamp("ts")} AS at FROM events""")
def f4(spark, d):
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return A.table(spark, d, "events").select("event_id", F.date_format(S.to_utc(epoch), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("f5_feed_dates", f"""
SELECT event_id, {stamp("ts - CASE WHEN event_id % 3 = 0 THEN INTERVAL '2 hours' ELSE INTERVAL '0 hours' END")} AS at FROM events""")
def f5(spark, d):
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    rfc = F.concat(F.date_format(ts, "EEE, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"),
                   F.when(n % 3 == 0, " +0200").when(n % 3 == 1, " GMT").otherwise(" +0000"))
    text = F.when(n % 5 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(rfc)
    text = F.when((n % 5 == 3) & (n % 3 == 0), rfc).otherwise(text)
    return A.table(spark, d, "events").select("event_id", F.date_format(S.feed_date(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("f10_f11_keys", """
SELECT c_custkey, upper(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment || '-x' END) AS subject,
       lower(c_name) AS resolver FROM customer""")
def f10(spark, d):
    n = F.col("c_custkey")
    proxy = F.when(n % 3 == 0, None).when(n % 3 == 1, F.lit("")).otherwise(F.concat("c_mktsegment", F.lit("-x")))
    return A.table(spark, d, "customer").select("c_custkey", S.subject_key(proxy, "c_name").alias("subject"),
                                                S.resolver_key(F.concat(F.lit(" \t"), F.col("c_name"), F.lit("\n"))).alias("resolver"))


@query("f17_agreement_note", sql("readings_e", """
SELECT subject, CASE WHEN dispersion > 40 THEN 'split' ELSE 'aligned' END AS note, count(*) AS n FROM readings_e GROUP BY 1, 2"""))
def f17(spark, d):
    return A.readings_e(spark, d).groupBy("subject", S.agreement_note("dispersion").alias("note")).agg(F.count(F.lit(1)).alias("n"))


@query("f18_client_key", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a' || user_id WHEN event_id % 4 IN (1, 2) THEN 'p' || user_id ELSE 'unknown' END AS client FROM events""")
def f18(spark, d):
    n, u = F.col("event_id"), F.col("user_id")
    forwarded = F.when(n % 4 == 0, F.concat(F.lit(" a"), u, F.lit(" , 10.0.0.1"))).when(n % 4 == 1, F.lit(" ,10.0.0.2"))
    peer = F.when(n % 4 != 3, F.concat(F.lit("p"), u))
    return A.table(spark, d, "events").select("event_id", S.client_key(forwarded, peer).alias("client"))


@query("f19_utc_day_start", f"SELECT {stamp('day')} AS day, n FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)")
def f19(spark, d):
    days = A.table(spark, d, "events").groupBy(S.utc_day_start(F.col("ts").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query("ud5_sql_functions", sql("daily_e", f""",
w AS (SELECT run_date, source_tier, sum(tier_w * (1e0 + 0.15e0 * ln(1e0 + raw_engagement))) AS w FROM daily_e GROUP BY 1, 2)
SELECT {_DATE}, source_tier, {R_('w', 4)} AS weight, CASE WHEN w > 0.15 THEN 'bullish' WHEN w < -0.15 THEN 'bearish' ELSE 'neutral' END AS label FROM w"""))
def ud5(spark, d):
    from opinara.functions.sql_functions import register

    register(spark)
    view = "opinara_items_e"
    A.items_e(spark, d).createOrReplaceTempView(view)
    raw = spark.sql(f"""
        SELECT run_date, tier AS source_tier, sum(weight) AS w
        FROM (SELECT run_date, tier, tier_weight(tier) * engagement_factor(raw_engagement) AS weight
              FROM (SELECT CAST(to_date(ts) AS STRING) AS run_date, source_tier(source) AS tier, raw_engagement
                    FROM {view})) GROUP BY 1, 2""")
    return raw.select("run_date", "source_tier", py_round("w", 4).alias("weight"), F.expr("daily_label(w)").alias("label"))
