"""Feed parsing, on payloads that Spark builds from the tables: parse(build(rows)) = rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara.sources import feeds
from opinara.verification.registry import query


def _xml(c):
    out = F.col(c) if isinstance(c, str) else c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _pages(df, key, size, element):
    """Pages of up to ``size`` elements as arrays of JSON texts, in key order."""
    return (df.groupBy(F.floor(F.col(key) / size).alias("payload_seq"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col(key), element.alias("e")))).alias("es"))
            .select("payload_seq", F.array_join(F.transform("es", lambda x: x["e"]), ",").alias("listed")))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("s1_forum_listing", """
SELECT 'reddit/r/stocks' AS source, 'title ' || event_type || ' ' || event_id AS title,
       CASE WHEN event_id % 5 = 0 THEN 'title ' || event_type || ' ' || event_id ELSE 'body "' || user_id || '"' END AS text,
       'https://www.reddit.com/r/stocks/' || event_id AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(user_id AS DOUBLE) AS score
FROM events WHERE event_id % 40 <> 0""")
def s1(spark, d):
    n = F.col("event_id")
    title = F.concat(F.lit("title "), "event_type", F.lit(" "), n)
    post = F.struct(title.alias("title"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit('body "'), "user_id", F.lit('"'))).alias("selftext"),
                    F.concat(F.lit("/r/stocks/"), n).alias("permalink"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_utc"),
                    (n % 40 == 0).alias("stickied"), F.col("user_id").alias("score"), n.alias("num_comments"), F.lit(0.5).alias("upvote_ratio"))
    pages = _pages(A.table(spark, d, "events"), "event_id", 25, F.to_json(F.struct(post.alias("data"))))
    listing = pages.select("payload_seq", F.lit("reddit/r/stocks").alias("source"),
                           F.concat(F.lit('{"data": {"children": ['), "listed", F.lit("]}}")).alias("payload"))
    return feeds.parse_forum_listing(listing).select("source", "title", "text", "url", _stamp("ts").alias("ts"), F.col("metadata.score").alias("score"))


@query("s2_rss_feed", r"""
SELECT 'news:' || role AS source, 'T' || conv_id || '.' || turn AS title, CASE WHEN turn % 4 = 3 THEN 'T' || conv_id || '.' || turn ELSE md5(trim(text)) END AS text,
       'https://n/' || conv_id || '/' || turn AS url, strftime(TIMESTAMP '2024-01-01' + conv_id * INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS ts FROM conversations""")
def s2(spark, d):
    title = F.concat(F.lit("T"), "conv_id", F.lit("."), "turn")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600)
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"),
                    F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit("<description>"), _xml(F.md5(F.trim("text").cast("binary"))), F.lit("</description>"))),
                    F.lit("<link>https://n/"), "conv_id", F.lit("/"), "turn", F.lit("</link><pubDate>"),
                    F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    rows = A.table(spark, d, "conversations").select(F.concat(F.lit("news:"), "role").alias("source"), item.alias("payload"),
                                                     (F.col("conv_id") * 100 + F.col("turn")).alias("ingest_seq"))
    return feeds.parse_rss_items(rows).select("source", "title", "text", "url", _stamp("ts").alias("ts"))


@query("s3_paper_feed", r"""
SELECT 'Paper ' || conv_id || ' part ' || turn AS title, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5, 'https://p/' || conv_id || '/' || turn AS url,
       strftime(TIMESTAMP '2024-01-01' + conv_id * INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS ts FROM conversations""")
def s3(spark, d):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600)
    entry = F.concat(F.lit("<entry><title>Paper "), "conv_id", F.lit("\n   part "), "turn", F.lit("</title><summary>"), _xml("text"),
                     F.lit('</summary><link rel="related" href="https://x/"/><link rel="alternate" href="https://p/'), "conv_id", F.lit("/"), "turn",
                     F.lit('"/><published>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry>"))
    rows = A.table(spark, d, "conversations").select(F.lit("arxiv").alias("source"), entry.alias("payload"),
                                                     (F.col("conv_id") * 100 + F.col("turn")).alias("ingest_seq"))
    return feeds.parse_atom_entries(rows).select("title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "url", _stamp("ts").alias("ts"))


@query("s4_search_hits", """
SELECT 'https://news.ycombinator.com/item?id=' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'Story ' || event_id ELSE '(comment)' END ELSE 'Title ' || event_id END AS title,
       CASE WHEN event_id % 2 = 0 THEN 'up & away ' || event_id WHEN event_id % 3 = 0 THEN 'it''s ' || event_id ELSE 'Title ' || event_id END AS text,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id AS points, 'informed' AS source_type FROM events WHERE event_id % 100 <> 2""")
def s4(spark, d):
    n, even = F.col("event_id"), F.col("event_id") % 2 == 0
    hit = F.to_json(F.struct(
        n.cast("string").alias("objectID"),
        F.when(even, F.when(n % 100 == 2, "<p> </p>").otherwise(F.concat(F.lit("<p>up &amp; <i>away</i> "), n, F.lit("</p>")))).alias("comment_text"),
        F.when(n % 4 == 0, F.concat(F.lit("Story "), n)).alias("story_title"), F.when(~even, F.concat(F.lit("Title "), n)).alias("title"),
        F.when(~even & (n % 3 == 0), F.concat(F.lit("<b>it&#x27;s</b> "), n)).alias("story_text"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("user_id").alias("points"),
        F.lit("a").alias("author")))
    events = A.table(spark, d, "events")
    pages = _pages(events, "event_id", 20, hit)
    again = _pages(events.filter("event_id % 10 = 0"), "event_id", 200, F.replace(hit, F.lit("away"), F.lit("late")))
    both = pages.unionByName(again.withColumn("payload_seq", F.col("payload_seq") + 1_000_000_000))
    out = feeds.parse_search_hits(both.select("payload_seq", F.concat(F.lit('{"hits": ['), "listed", F.lit("]}")).alias("payload")))
    return out.select("url", "title", "text", _stamp("ts").alias("ts"), F.col("metadata.points").alias("points"), "source_type")


@query("s5_forum_search", """
SELECT 'https://f/' || user_id AS url, 'crowd' AS source_type, 'T' || min(event_id) AS title,
       CASE WHEN min(event_id) % 3 = 0 THEN 'T' || min(event_id) ELSE 'so & so ' || min(event_id) END AS text FROM events GROUP BY user_id""")
def s5(spark, d):
    n = F.col("event_id")
    entry = F.concat(F.lit("<entry><title>T"), n, F.lit("</title>"),
                     F.when(n % 3 == 0, "").otherwise(F.concat(F.lit('<content type="html">&lt;p&gt;so &amp;amp; so &lt;b&gt;'), n, F.lit("&lt;/b&gt;&lt;/p&gt;</content>"))),
                     F.lit('<link href="https://f/'), "user_id", F.lit('"/><published>2024-01-01T00:00:00+00:00</published></entry>'))
    rows = A.table(spark, d, "events").select(F.concat(F.lit("reddit/r/"), "event_type").alias("source"), entry.alias("payload"), n.alias("ingest_seq"))
    return feeds.parse_forum_search(rows).select("url", "source_type", "title", "text")


@query("s6_f20_podcast_feed", """
WITH e AS (SELECT *, conv_id % 5 AS show_idx, conv_id // 5 AS feed_idx FROM conversations WHERE turn = 0)
SELECT CASE WHEN conv_id % 6 = 0 THEN 'https://l/' || conv_id ELSE 'guid-' || conv_id END AS guid, 'show ' || show_idx AS show,
       CASE WHEN conv_id % 7 <> 0 THEN 'https://a/' || conv_id || '.mp3' END AS audio_url, CASE WHEN conv_id % 3 = 0 THEN 'https://t/' || conv_id || '.txt' END AS transcript_url,
       CASE WHEN conv_id % 4 = 0 THEN 'summary ' || conv_id ELSE 'about <b> ' || conv_id END AS description,
       strftime(TIMESTAMP '2024-01-01' + conv_id * INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS published
FROM e WHERE feed_idx < 15 AND conv_id % 12 <> 6""")
def s6(spark, d):
    n = F.col("conv_id")
    at = F.timestamp_seconds(F.lit(1704067200) + n * 3600)
    item = F.concat(
        F.lit('<item xmlns:podcast="https://podcastindex.org/namespace/1.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><title><![CDATA[Episode & '), n, F.lit("]]></title>"),
        F.when(n % 6 == 0, "").otherwise(F.concat(F.lit('<guid isPermaLink="false">guid-'), n, F.lit("</guid>"))),
        F.when(n % 12 == 6, "").otherwise(F.concat(F.lit("<link>https://l/"), n, F.lit("</link>"))),
        F.lit("<pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"),
        F.when(n % 4 == 0, F.concat(F.lit("<itunes:summary>summary "), n, F.lit("</itunes:summary>"))).otherwise(F.concat(F.lit("<description><![CDATA[about <b>\n "), n, F.lit("]]></description>"))),
        F.when(n % 7 == 0, "").when(n % 2 == 0, F.concat(F.lit('<enclosure url="https://a/'), n, F.lit('.mp3" length="1" type="audio/mpeg"/>'))).otherwise(
            F.concat(F.lit('<enclosure type="image/png" url="https://a/x.png"/><enclosure type="audio/mpeg" url="https://a/'), n, F.lit('.mp3"/>'))),
        F.lit('<podcast:transcript url="https://t/'), n, F.lit('.srt" type="application/srt"/>'),
        F.when(n % 3 == 0, F.concat(F.lit('<podcast:transcript url="https://t/'), n, F.lit('.txt" type="text/plain"/>'))).otherwise(""), F.lit("</item>"))
    items = A.table(spark, d, "conversations").filter("turn = 0").select(
        F.concat(F.lit("show "), n % 5).alias("show"), (n % 5).cast("int").alias("show_idx"), F.floor(n / 5).cast("int").alias("feed_idx"), item.alias("payload"))
    return feeds.parse_podcast_items(items, limit=15).select("guid", "show", "audio_url", "transcript_url", "description", _stamp("published").alias("published"))
