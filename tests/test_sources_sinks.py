from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara import schemas
from opinara.operators.store import OpinionStore
from opinara.sources import feeds, sinks, tables
from opinara.sources.transcripts import read_transcripts


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return str(path)


def test_forum_listing_files(spark, tmp_path):
    post = lambda **k: {"data": {"title": "T", "selftext": "", "permalink": "/r/a/1", "created_utc": 1704067200, "stickied": False, "score": 9, **k}}
    put(tmp_path / "l", "1.json", json.dumps({"data": {"children": [post(), post(stickied=True), post(selftext="body", permalink="/r/a/2")]}}))
    put(tmp_path / "l", "2.json", json.dumps({"data": {"children": [post(permalink="/r/a/3", created_utc=None)]}}))
    out = feeds.read_forum_listing(spark, str(tmp_path / "l"), "reddit/r/a")
    assert rows(out, "text", "url") == [("T", "https://www.reddit.com/r/a/1"), ("T", "https://www.reddit.com/r/a/3"), ("body", "https://www.reddit.com/r/a/2")]
    assert out.filter("ts is null").count() == 1 and out.select("ingest_seq").distinct().count() == 3


def test_rss_and_atom_files(spark, tmp_path):
    rss = ("<rss><channel><title>C</title><item><title>A &amp; B</title><link>https://n/1</link><description><![CDATA[text]]></description>"
           "<pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Only title</title><link>https://n/2</link></item></channel></rss>")
    out = feeds.read_rss(spark, put(tmp_path / "r", "f.xml", rss), "news:x")
    assert rows(out, "title", "text", "url", F.col("ts").cast("string")) == [
        ("A & B", "text", "https://n/1", "2024-01-01 10:00:00"), ("Only title", "Only title", "https://n/2", None)]
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>P\n  one</title><summary> long\n abstract </summary>'
            '<link href="https://p/1" rel="alternate"/><published>2024-01-01T00:00:00Z</published></entry></feed>')
    out = feeds.read_atom(spark, put(tmp_path / "a", "f.xml", atom), "arxiv")
    assert rows(out, "title", "text", "url") == [("P one", "long abstract", "https://p/1")]


def test_podcast_files(spark, tmp_path):
    feed = """<rss xmlns:podcast="https://podcastindex.org/namespace/1.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>
    <item><title><![CDATA[One & two]]></title><guid isPermaLink="false">g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate>
      <enclosure type="audio/mpeg" url="https://a/1.mp3"/><podcast:transcript url="https://t/1.srt" type="application/srt"/>
      <podcast:transcript url="https://t/1.txt" type="text/plain"/><description>d1</description></item>
    <item><title>No id</title></item>
    <item><title>Linked</title><link>https://l/3</link><itunes:summary>s3</itunes:summary></item>
    <item><title>Beyond the cap</title><guid>g4</guid></item></channel></rss>"""
    out = feeds.read_podcast_feed(spark, put(tmp_path / "p", "f.xml", feed), "Show", 0, limit=3)
    assert rows(out, "guid", "title", "audio_url", "transcript_url", "description") == [
        ("g1", "One & two", "https://a/1.mp3", "https://t/1.txt", "d1"), ("https://l/3", "Linked", None, None, "s3")]


def test_reader_registry_skips_missing_sources(spark, tmp_path):
    path = put(tmp_path / "r", "f.xml", "<rss><item><title>A</title></item></rss>")
    out = feeds.read_sources(spark, [("rss", path, "news:x"), ("atom", str(tmp_path / "absent" / "*.xml"), "arxiv")])
    assert rows(out, "source", "title") == [("news:x", "A")]
    assert feeds.read_sources(spark, [("rss", str(tmp_path / "nothing"), "x")]).count() == 0


def test_transcript_files(spark, tmp_path):
    path = put(tmp_path / "t", "ep 1.txt", "00:00:01\nSpeaker 1: hello\n")
    assert rows(read_transcripts(spark, path), "guid", "text") == [("ep 1", "hello")]


def test_headline_files(spark, tmp_path):
    csv = 'Date,Label,Top1,Top2\n2015-01-02,1,"b""it\'s up""",\n2014-12-31,0,b\'old\',x\n2015-01-05,0,plain words,"b\'two\nlines\'"\n2015-01-06,0,late,\n'
    out = tables.read_headlines(spark, put(tmp_path / "h", "n.csv", csv), 2015, 2)
    got = rows(out, "run_date", "position", "headline")
    assert got[0] == ("2015-01-02", 1, "it's up") and got[1] == ("2015-01-05", 1, "plain words") and len(got) == 3


def test_subject_files(spark, tmp_path):
    entry = lambda proxy, fin=True: {"display": "D", "asset_type": "stock", "is_financial": fin, "proxy": proxy, "aliases": ["x"], "subreddits": []}
    payload = json.dumps({"first": entry("nv"), "second": entry("NV"), "none": entry(None), "not": entry("ZZ", False)})
    dim = tables.read_subjects(spark, put(tmp_path / "s", "s.json", payload))
    assert rows(tables.market_subjects(dim), "input_key", "proxy") == [("first", "NV")]


# --- sinks ---------------------------------------------------------------------------------------
def item_rows(spark, data):
    df = spark.createDataFrame(data, "external_id string, url string, subject string, score int, ingest_seq bigint")
    for f in schemas.ITEM.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def test_item_sink_inserts_once(spark, tmp_path):
    store = OpinionStore(spark, str(tmp_path))
    batch = item_rows(spark, [("a", "u1", "S", 1, 1), ("a", "u2", "S", 2, 0), ("", "u3", "T", 3, 2), (None, "u3", "T", 4, 3), (None, "", "T", 5, 4)])
    assert store.append_items(batch) == 2
    assert rows(store.items(), "external_id", "score") == [("a", 2), ("u3", 3)]
    assert store.append_items(batch.unionByName(item_rows(spark, [("b", None, "S", 9, 9)]))) == 1
    assert store.corpus_size().first()[0] == 3
    assert rows(sinks.keyless(batch), "score") == [(5,)]
    assert rows(store.drop_known(batch), "score") == [(5,)]
    assert rows(store.known_ids(batch)) == [("a",), ("u3",)]


def test_ledger_replaces_by_guid(spark, tmp_path):
    store = OpinionStore(spark, str(tmp_path))
    def batch(*data):
        df = spark.createDataFrame(data, "guid string, status string, n_items int, write_seq int")
        for f in schemas.LEDGER.fields:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        return df
    store.mark_episodes(batch(("a", "failed", 0, 1), ("b", "ok", 2, 1), ("a", "skipped", 0, 2)), "write_seq")
    store.mark_episodes(batch(("a", "ok", 5, 1)), "write_seq")
    assert rows(store.ledger(), "guid", "status", "n_items") == [("a", "ok", 5), ("b", "ok", 2)]
    assert rows(store.ledger_stats()) == [("ok", 2, 7)]


def test_seed_only_once(spark, tmp_path):
    path = f"{tmp_path}/seed"
    assert sinks.seed_if_absent(spark, path, spark.range(3)) and not sinks.seed_if_absent(spark, path, spark.range(9))
    assert spark.read.parquet(path).count() == 3


def test_read_order_follows_file_names_over_all_sources(spark, tmp_path):
    folder = tmp_path / "a b é"
    folder.mkdir()
    for name, n in (("p10", 3), ("p2", 2), ("p0", 1)):
        items = "".join(f"<item><title>{name}-{k}</title><link>http://x/{name}{k}</link></item>" for k in range(n * 30))
        (folder / f"{name} x%.xml").write_text(f"<rss><channel>{items}</channel></rss>")
        hits = ",".join(f'{{"objectID": "{k}", "title": "{name}"}}' for k in range(3))
        (folder / f"{name}.json").write_text(f'{{"hits": [{hits}]}}')
    landed = [("rss", f"{folder}/*.xml", "s1"), ("search_hits", f"{folder}/*.json", "hn"), ("rss", f"{folder}/*.xml", "s2"),
              ("atom", f"{folder}/none*", "absent")]
    got = [(r.source, r.title) for r in feeds.read_sources(spark, landed).orderBy("ingest_seq").collect()]
    elements = [f"{name}-{k}" for name, n in (("p0", 1), ("p10", 3), ("p2", 2)) for k in range(n * 30)]
    assert got == [("s1", t) for t in elements] + [("hn", "p0")] * 3 + [("s2", t) for t in elements]
    assert feeds.read_sources(spark, landed).select("ingest_seq").distinct().count() == len(got)


def test_atom_text_is_summary_else_content_else_title(spark):
    entries = [("a", 0, "<entry><title>T</title><content>C</content></entry>"),
               ("a", 1, "<entry><title>T</title><summary>S</summary><content>C</content></entry>"), ("a", 2, "<entry><title>T</title></entry>")]
    df = spark.createDataFrame(entries, "source string, ingest_seq bigint, payload string")
    assert [r.text for r in feeds.parse_atom_entries(df).orderBy("ingest_seq").collect()] == ["C", "S", "T"]


def test_item_sink_reads_keys_not_items(spark, tmp_path):
    """Nothing below the item rows is opened by a second append: their folder could be gone."""
    store = OpinionStore(spark, str(tmp_path))
    many = item_rows(spark, [(f"k{i}", None, f"S{i % 3}", i % 100, i) for i in range(500)])
    assert store.append_items(many) == 500
    (tmp_path / "item" / "rows").rename(tmp_path / "item" / "away")
    more = item_rows(spark, [(f"k{i}", None, "S9", 1, 1000 + i) for i in range(495, 510)])
    assert store.append_items(more) == 10
    assert rows(store.known_ids(more.unionByName(item_rows(spark, [("zz", None, "S", 1, 1)])))) == sorted((f"k{i}",) for i in range(495, 510))
    for f in (tmp_path / "item" / "away").iterdir():
        f.rename(tmp_path / "item" / "rows" / f.name)
    assert store.items().count() == 510 and store.items("S9").count() == 10


def test_every_key_has_its_bit(spark, tmp_path):
    keys = spark.range(20_000).selectExpr("concat('key ', id) as external_id")
    sinks.append_items(spark, str(tmp_path / "t"), keys.selectExpr("external_id", "'' as url", "'S' as subject", "cast(1 as bigint) as ingest_seq"),
                       keys.selectExpr("external_id", "'S' as subject", "cast(1 as bigint) as ingest_seq").schema)
    asked = spark.range(10_000, 30_000).selectExpr("concat('key ', id) as external_id")
    assert sinks.known_keys(spark, str(tmp_path / "t"), asked).count() == 10_000


def test_a_reader_sees_all_of_a_write_or_nothing(spark, tmp_path):
    from opinara.sources.versions import Versions, write

    path, schema = str(tmp_path / "t"), spark.range(1).selectExpr("id", "'a' as p").schema

    def batch(label):
        return spark.range(4).selectExpr("id", f"'{label}' || id % 2 as p")
    sinks.upsert(spark, path, batch("a"), ["id"], schema, "p")
    before = rows(sinks.read_latest(spark, path, schema, ["id"]))
    table = Versions(spark, path)
    n, _ = table.current()
    folder = table.new_folder("rows", n)
    write(batch("b").filter("p = 'b0'"), table.path(folder), "p")                 # one partition has landed
    assert rows(sinks.read_latest(spark, path, schema, ["id"])) == before
    write(batch("b").filter("p = 'b1'"), table.path(folder) + "/x", "p")         # and the other
    assert rows(sinks.read_latest(spark, path, schema, ["id"])) == before
    sinks.upsert(spark, path, batch("c"), ["id"], schema, "p")
    assert rows(sinks.read_latest(spark, path, schema, ["id"])) == [(i, f"c{i % 2}") for i in range(4)]
    with pytest.raises(RuntimeError):
        table.switch(n, [folder])                                                 # somebody else was first


def test_ledger_is_appended_and_compacted(spark, tmp_path):
    store = OpinionStore(spark, str(tmp_path))

    def batch(status, ids):
        made = spark.createDataFrame([(str(i), status) for i in ids], "guid string, status string")
        return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.LEDGER.fields])
    store.mark_episodes(batch("failed", range(2000)))
    for _ in range(2):                                                             # a batch and its replay
        store.mark_episodes(batch("ok", range(1900, 2100)).coalesce(1))
    ledger = tmp_path / "processed_episode" / "rows"
    newest = max(ledger.iterdir(), key=lambda f: int(f.name.split("-")[0].split("=")[1]))
    assert len(list(newest.glob("*.parquet"))) == 1
    want = [(str(i), "ok" if i >= 1900 else "failed") for i in range(2100)]
    assert rows(store.ledger(), "guid", "status") == sorted(want, key=repr)
    store.compact()
    assert rows(store.ledger(), "guid", "status") == sorted(want, key=repr)
    assert "Window" not in store.ledger()._jdf.queryExecution().executedPlan().toString()
