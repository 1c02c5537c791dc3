"""Landed feed files to raw records.

Each source is a pair: ``parse_*`` takes a DataFrame with one payload per row (text
column), ``read_*`` reads files.  Both end in the same record shape (``schemas.RAW_RECORD``).
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opinara import config
from opinara.functions.scalars import feed_date, to_utc
from opinara.functions.text import collapse_space, strip_html

LISTING_SCHEMA = (
    "struct<data:struct<children:array<struct<data:struct<title:string,selftext:string,"
    "permalink:string,created_utc:double,stickied:boolean,score:double,num_comments:bigint,"
    "upvote_ratio:double>>>>>")
HITS_SCHEMA = (
    "struct<hits:array<struct<objectID:string,comment_text:string,story_title:string,"
    "title:string,story_text:string,created_at:string,points:bigint,author:string>>>")
RSS_ITEM_SCHEMA = (
    "struct<title:string,description:string,link:string,pubDate:string,guid:string>")
ATOM_ENTRY_SCHEMA = (
    "struct<title:string,summary:string,content:string,"
    "link:array<struct<_href:string,_rel:string>>,published:string,updated:string,id:string>")
PODCAST_ITEM_SCHEMA = (
    "struct<title:string,guid:struct<_VALUE:string,_isPermaLink:string>,link:string,"
    "pubDate:string,description:string,`itunes:summary`:string,"
    "enclosure:array<struct<_url:string,_type:string,_length:string>>,"
    "`podcast:transcript`:array<struct<_url:string,_type:string>>>")

_EMPTY_METADATA = dict(score="double", num_comments="bigint", upvote_ratio="double",
                       points="bigint", author="string")


def _metadata(**known: Column) -> Column:
    return F.struct(*[known.get(name, F.lit(None)).cast(kind).alias(name)
                      for name, kind in _EMPTY_METADATA.items()])


def _text_or(text: Column, fallback: Column) -> Column:
    """``text or fallback`` where the empty string counts as missing."""
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def _record(df: DataFrame, source_type, title, text, url, ts, metadata=None, seq="ingest_seq") -> DataFrame:
    return df.select(
        F.col("source"), F.lit(source_type).cast("string").alias("source_type"),
        F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(url, F.lit("")).alias("url"), ts.alias("ts"),
        (metadata if metadata is not None else _metadata()).alias("metadata"),
        F.col(seq).alias("ingest_seq"))


def _ordered(order: str, position: str) -> Column:
    """One sortable number out of payload order (below 2^32) and position within the payload."""
    return (F.shiftleft(F.col(order).cast("bigint"), POSITION_BITS) + F.col(position)).alias("ingest_seq")


# Positions in a file or page are ints; the file's place among all files stands above them.
POSITION_BITS = 31


def _files_in_order(spark: SparkSession, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (with their ``_path``) and the place of that file by path.

    The list of paths is what the driver has planned the scan from; contents are not looked at.
    """
    # an empty authority is written file:/// in one place and file:/ in the other
    paths = sorted({re.sub("^([^:/]+):///", r"\1:/", p) for p in rows.inputFiles()})
    places = spark.createDataFrame(list(zip(paths, range(len(paths)))), f"_path string, {column} bigint")
    return rows.withColumn("_path", F.regexp_replace("_path", "^([^:/]+):///", "$1:/")).join(places, "_path").drop("_path")


# --- forum listing (JSON) -----------------------------------------------------------------
def parse_forum_listing(payloads: DataFrame, payload: str = "payload", source: str = "source",
                        order: str = "payload_seq") -> DataFrame:
    """Listing pages to records; pinned posts are dropped, an empty body falls back to the title."""
    posts = (payloads.select(F.col(source).alias("source"), F.col(order).alias("_o"),
                             F.from_json(payload, LISTING_SCHEMA).alias("page"))
             .select("source", "_o", F.posexplode("page.data.children").alias("_p", "child"))
             .select("source", _ordered("_o", "_p"), "child.data.*")
             .filter(~F.coalesce("stickied", F.lit(False))))
    return _record(
        posts, None, F.col("title"), _text_or(F.col("selftext"), F.col("title")),
        F.concat(F.lit(config.FORUM_SITE), F.coalesce("permalink", F.lit(""))),
        to_utc("created_utc"),
        _metadata(score=F.col("score"), num_comments=F.col("num_comments"), upvote_ratio=F.col("upvote_ratio")))


def read_forum_listing(spark: SparkSession, path: str, source: str) -> DataFrame:
    return parse_forum_listing(_read_pages(spark, path, source))


def read_search_hits(spark: SparkSession, path: str, source: str = "hackernews") -> DataFrame:
    return parse_search_hits(_read_pages(spark, path, source), source=source)


def _read_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One row per JSON file, numbered by path: pages must be named in their order."""
    pages = spark.read.text(path, wholetext=True).select(
        F.lit(source).alias("source"), F.col("value").alias("payload"), F.col("_metadata.file_path").alias("_path"))
    return _files_in_order(spark, pages, "payload_seq")


# --- search hits (JSON) ---------------------------------------------------------------------
def parse_search_hits(payloads: DataFrame, payload: str = "payload", order: str = "payload_seq",
                      source: str = "hackernews") -> DataFrame:
    """Search result pages to records: first page wins per hit id, comments and stories differ
    in where their title and text live, and hits without text are dropped after the id is taken."""
    hits = (payloads.select(F.col(order).alias("_o"), F.from_json(payload, HITS_SCHEMA).alias("page"))
            .select("_o", F.posexplode("page.hits").alias("_p", "hit"))
            .select(F.lit(source).alias("source"), _ordered("_o", "_p"), "hit.*")
            .filter(F.coalesce("objectID", F.lit("")) != ""))
    first = Window.partitionBy("objectID").orderBy("ingest_seq")
    hits = hits.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    is_comment = F.coalesce("comment_text", F.lit("")) != ""
    clean = strip_html(F.when(is_comment, F.col("comment_text")).otherwise(F.col("story_text")))
    title = (F.when(is_comment, _text_or(F.col("story_title"), F.lit("(comment)")))
             .otherwise(F.coalesce("title", F.lit(""))))
    shaped = hits.withColumn("_clean", clean).withColumn("_title", title).withColumn(
        "_text", F.when(is_comment, F.col("_clean")).otherwise(_text_or(F.col("_clean"), F.col("_title"))))
    return _record(
        shaped.filter(F.col("_text") != ""), "informed", F.col("_title"), F.col("_text"),
        F.concat(F.lit(config.SEARCH_ITEM_URL), F.col("objectID")),
        F.try_to_timestamp("created_at"),
        _metadata(points=F.col("points"), author=F.col("author")))


# --- RSS / Atom ---------------------------------------------------------------------------------
def _feed_rows(payloads: DataFrame, payload: str, schema: str) -> DataFrame:
    return payloads.withColumn("_e", F.from_xml(payload, schema)).drop(payload)


def parse_rss_items(items: DataFrame, payload: str = "payload", source: str = "source",
                    order: str = "ingest_seq") -> DataFrame:
    """One ``<item>`` element per row to records; text is the description, else the title."""
    rows = _feed_rows(items.select(F.col(source).alias("source"), F.col(order).alias("ingest_seq"),
                                   F.col(payload).alias("payload")), "payload", RSS_ITEM_SCHEMA)
    return _record(rows, None, F.col("_e.title"), _text_or(F.col("_e.description"), F.col("_e.title")),
                   F.col("_e.link"), feed_date("_e.pubDate"))


def parse_atom_entries(entries: DataFrame, payload: str = "payload", source: str = "source",
                       order: str = "ingest_seq") -> DataFrame:
    """One paper ``<entry>`` per row; title and abstract are collapsed to one line."""
    rows = _feed_rows(entries.select(F.col(source).alias("source"), F.col(order).alias("ingest_seq"),
                                     F.col(payload).alias("payload")), "payload", ATOM_ENTRY_SCHEMA)
    return _atom_records(rows)


def _atom_records(rows: DataFrame) -> DataFrame:
    """Text is the summary, else the content, else the title."""
    title = collapse_space("_e.title")
    text = _text_or(collapse_space("_e.summary"), _text_or(collapse_space("_e.content"), title))
    return _record(rows, None, title, text, _atom_link(), feed_date("_e.published"))


def _atom_link() -> Column:
    """The alternate link of an entry, else its first link."""
    links = F.coalesce(F.col("_e.link"), F.array())
    alternates = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(alternates, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])


def parse_forum_search(entries: DataFrame, payload: str = "payload", source: str = "source",
                       order: str = "ingest_seq") -> DataFrame:
    """Forum search entries (Atom, HTML body): tagged ``crowd``, first entry per link wins."""
    rows = _feed_rows(entries.select(F.col(source).alias("source"), F.col(order).alias("ingest_seq"),
                                     F.col(payload).alias("payload")), "payload", ATOM_ENTRY_SCHEMA)
    return _forum_search_records(rows)


def _forum_search_records(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_link", F.coalesce(_atom_link(), F.lit("")))
    first = Window.partitionBy("_link").orderBy("ingest_seq")
    rows = rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    body = strip_html(_text_or(F.col("_e.content"), F.col("_e.summary")))
    return _record(rows, "crowd", F.col("_e.title"), _text_or(body, F.col("_e.title")),
                   F.col("_link"), feed_date("_e.published"))


def read_feed_elements(spark: SparkSession, path: str, row_tag: str, source: str, schema: str) -> DataFrame:
    """Feed files through the XML source; ``ingest_seq`` orders rows by file path and position in the file."""
    inner = F.struct(*[F.col(f"`{name}`") for name in _struct_type(schema).fieldNames()])
    rows = (spark.read.format("xml").option("rowTag", row_tag).schema(_struct_type(schema)).load(path)
            .select(F.lit(source).alias("source"), inner.alias("_e"), F.col("_metadata.file_path").alias("_path"),
                    F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_scan")))
    in_file = Window.partitionBy("_file").orderBy("_block", "_scan")
    placed = _files_in_order(spark, rows, "_file").withColumn("_at", F.row_number().over(in_file) - 1)
    return placed.select("source", "_e", _ordered("_file", "_at"))


def _struct_type(schema: str):
    from pyspark.sql import types as T
    return T.StructType.fromDDL(f"root {schema}")["root"].dataType


def read_rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = read_feed_elements(spark, path, "item", source, RSS_ITEM_SCHEMA)
    return _record(rows, None, F.col("_e.title"), _text_or(F.col("_e.description"), F.col("_e.title")),
                   F.col("_e.link"), feed_date("_e.pubDate"))


def read_atom(spark: SparkSession, path: str, source: str) -> DataFrame:
    return _atom_records(read_feed_elements(spark, path, "entry", source, ATOM_ENTRY_SCHEMA))


def read_forum_search(spark: SparkSession, path: str, source: str) -> DataFrame:
    return _forum_search_records(read_feed_elements(spark, path, "entry", source, ATOM_ENTRY_SCHEMA))


# --- podcast feeds --------------------------------------------------------------------------------
def _episodes(rows: DataFrame, limit: int | None) -> DataFrame:
    """Shared shaping: ``rows`` has ``show, show_idx, feed_idx`` and the parsed item ``_e``."""
    guid = _text_or(collapse_space("_e.guid._VALUE"), collapse_space("_e.link"))
    audio = F.filter(F.coalesce(F.col("_e.enclosure"), F.array()), lambda x: x["_type"].startswith("audio"))
    plain = F.filter(F.coalesce(F.col("_e.`podcast:transcript`"), F.array()), lambda x: x["_type"] == "text/plain")
    description = _text_or(collapse_space("_e.description"), collapse_space("_e.`itunes:summary`"))
    out = rows.select(
        guid.alias("guid"), "show", "show_idx", "feed_idx",
        F.coalesce(collapse_space("_e.title"), F.lit("")).alias("title"),
        feed_date(collapse_space("_e.pubDate")).alias("published"),
        F.get(audio, F.lit(0))["_url"].alias("audio_url"),
        F.get(plain, F.lit(0))["_url"].alias("transcript_url"),
        F.substring(F.coalesce(description, F.lit("")), 1, config.EPISODE_DESCRIPTION_CHARS).alias("description"))
    if limit is not None:
        # The cap counts feed entries, also those that are dropped for want of a guid.
        recent = Window.partitionBy("show").orderBy("feed_idx")
        out = out.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= limit).drop("_rn")
    return out.filter(F.coalesce("guid", F.lit("")) != "")


def parse_podcast_items(items: DataFrame, payload: str = "payload", limit: int | None = 40) -> DataFrame:
    """One podcast ``<item>`` per row (``show, show_idx, feed_idx, payload``) to episodes."""
    return _episodes(_feed_rows(items, payload, PODCAST_ITEM_SCHEMA), limit)


def read_podcast_feed(spark: SparkSession, path: str, show: str, show_idx: int = 0,
                      limit: int | None = 40) -> DataFrame:
    rows = read_feed_elements(spark, path, "item", show, PODCAST_ITEM_SCHEMA)
    rows = rows.select(F.col("source").alias("show"), F.lit(show_idx).alias("show_idx"),
                       F.col("ingest_seq").alias("feed_idx"), "_e")
    return _episodes(rows, limit)


def read_podcast_feeds(spark: SparkSession, shows: list[tuple[str, str]], limit: int | None = 40) -> DataFrame:
    """Episodes of many shows, ``(path, show)`` in order of precedence; a path with no files adds nothing."""
    parts = [read_podcast_feed(spark, path, show, i, limit) for i, (path, show) in enumerate(shows) if _exists(spark, path)]
    return union_sources(parts) if parts else parse_podcast_items(
        spark.createDataFrame([], "show string, show_idx int, feed_idx bigint, payload string"))


# --- registry ----------------------------------------------------------------------------------------
# Name -> reader(spark, path, source) returning schemas.RAW_RECORD.  Users add their own.
READERS = {"forum_listing": read_forum_listing, "search_hits": read_search_hits,
           "rss": read_rss, "atom": read_atom, "forum_search": read_forum_search}


def register_reader(name: str, reader) -> None:
    READERS[name] = reader


def union_sources(parts: list[DataFrame | None]) -> DataFrame | None:
    """All records of the sources that delivered; a source that is None adds nothing."""
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_sources(spark: SparkSession, landed: list[tuple[str, str, str]]) -> DataFrame:
    """Union of ``(reader, path, source)`` entries; a path with no files adds nothing.

    ``ingest_seq`` is unique over all sources and follows their order: each source's numbers
    start above the files of the sources before it.
    """
    from opinara import schemas

    parts, files = [], 0
    for reader, path, source in landed:
        if _exists(spark, path):
            part = READERS[reader](spark, path, source)
            parts.append(part.withColumn("ingest_seq", F.col("ingest_seq") + F.lit(files << POSITION_BITS)))
            files += len(part.inputFiles())
    out = union_sources(parts)
    return spark.createDataFrame([], schemas.RAW_RECORD) if out is None else out


STATUS = "position int, reader string, source string, path string, status string, records bigint, error string"


def land_sources(spark: SparkSession, landed: list[tuple[str, str, str]], target: str) -> tuple[DataFrame, DataFrame]:
    """Records of ``(reader, path, source)`` entries, each source written apart below ``target``, and a status row per source.

    A source that cannot be read (``failed``, with its error) or has no files (``absent``) adds nothing and stops
    no other: only a source that was written as a whole counts.  Numbers follow as in ``read_sources``.
    """
    from pyspark.errors import PySparkException

    from opinara import schemas

    done, status, files = [], [], 0
    for position, (reader, path, source) in enumerate(landed):
        records, state, error = 0, "absent", None
        if _exists(spark, path):
            folder = f"{target}/source={position}"
            try:
                part = READERS[reader](spark, path, source).withColumn("ingest_seq", F.col("ingest_seq") + F.lit(files << POSITION_BITS))
                part.write.parquet(folder)
                written = spark.read.schema(part.schema).parquet(folder)
                records, state = written.count(), "ok"
                files += len(part.inputFiles())
                done.append(written)
            except (PySparkException, Py4JError) as failure:
                state, error = "failed", str(failure).split("\n")[0][:500]
        status.append((position, reader, source, path, state, records, error))
    out = union_sources(done)
    return spark.createDataFrame([], schemas.RAW_RECORD) if out is None else out, spark.createDataFrame(status, STATUS)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0
