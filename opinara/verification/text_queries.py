"""Text functions, transcripts, mentions and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara.functions import text as X
from opinara.operators import mentions as M
from opinara.operators import passages as G
from opinara.sources.tables import headline_records  # noqa: F401
from opinara.sources.transcripts import parse_transcripts
from opinara.verification.registry import query
from opinara.verification.sql_views import ODD_SPACES, SPACE_CLASS, SPACED_LETTERS, SPACED_SQL, sql

# A small alias dimension in the vocabulary of the conversation table.
ALIASES = [("S1", "the", False), ("S2", "that", False), ("S3", "with", False), ("S4", "from", False), ("S4", "for", False),
           ("S5", "and the", False), ("S5", "and", False), ("S6", "was", True), ("S6", "is", True),
           ("S7", "of the", False), ("S7", "the of", False), ("S8", "der", False), ("S9", "les", True)]
CUES = ("by", "not", "une")


def _aliases(spark, max_inline: int = 100) -> M.AliasSet:
    dim = spark.createDataFrame(ALIASES, "subject string, alias string, ambiguous boolean")
    return M.AliasSet(dim, max_inline)


def _md5(c):
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


# --- F1, F12..F16 --------------------------------------------------------------------------------
# The entities that the pages hold, some cut off by the end of a page; one pass, so a decoded ampersand starts no new one.
@query("f1_strip_html", f"""
WITH t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g') AS t FROM pages),
p AS (SELECT page_id, regexp_split_to_array(t, '&(amp|quot|middot|copy);?') AS gaps, regexp_extract_all(t, '&(amp|quot|middot|copy);?', 1) AS names FROM t),
d AS (SELECT page_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(
        CASE names[i] WHEN 'amp' THEN '&' WHEN 'quot' THEN '"' WHEN 'middot' THEN chr(183) WHEN 'copy' THEN chr(169) END, '')), '') AS t FROM p)
SELECT page_id, trim(regexp_replace(t, '{SPACE_CLASS}+', ' ', 'g')) AS text FROM d""")
def f1(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.strip_html("html").alias("text"))


@query("f1_strip_tags", """
SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages""")
def f1_tags(spark, d):
    return A.table(spark, d, "pages").select("page_id", _md5(X.strip_tags("html")).alias("text_md5"))


@query("f1_strip_html_basic", """
SELECT event_id, 'up & "away" it''s <b> ' || event_id AS text FROM events""")
def f1_basic(spark, d):
    raw = F.concat(F.lit("<p>up &amp;\n &quot;away&quot; <i>it&#x27;s</i> &lt;b&gt; "), F.col("event_id"), F.lit("</p> "))
    return A.table(spark, d, "events").select("event_id", X.strip_html_basic(raw).alias("text"))


@query("f12_alias_dimension", """
WITH c AS (SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS n FROM customer),
raw AS (SELECT seg || '-' || n AS subject, lower(seg) || ' ' || n AS alias FROM c UNION SELECT seg || '-' || n, 'n' || n || ' trust' FROM c)
SELECT subject, alias, 2 AS n_words, FALSE AS ambiguous FROM raw UNION ALL SELECT seg || '-' || n, 'apple', 1, TRUE FROM c""")
def f12(spark, d):
    seg, n = F.col("c_mktsegment"), F.col("c_nationkey")
    subjects = A.table(spark, d, "customer").select(seg, n).distinct().select(
        F.concat_ws("-", seg, n).alias("proxy"), F.concat(seg, F.lit(" "), n, F.lit(" Corp.")).alias("display"),
        F.array(F.concat(F.lit("N"), n, F.lit(" trust, inc")), F.lit("Apple Inc."), F.lit("crypto"), F.lit("chip maker"), F.lit("ab"),
                F.lit(" Co ")).alias("aliases"))
    return M.alias_dimension(subjects, M.asr_variants(spark)).select("subject", "alias", "n_words", "ambiguous")


@query("f13_word_count_and_collapse", f"""
WITH p AS (SELECT doc_id, {SPACED_SQL} AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[^{SPACE_CLASS[1:]}+')) AS words,
       md5(regexp_replace(regexp_replace(regexp_replace(text, '{SPACE_CLASS}+', ' ', 'g'), '^ ', ''), ' $', '')) AS text_md5 FROM p""")
def f13(spark, d):
    """Ten letters stand for ten kinds of white space that only the full class knows."""
    docs = A.table(spark, d, "documents").withColumn("text", F.translate("text", SPACED_LETTERS, ODD_SPACES))
    return docs.select("doc_id", X.word_count("text").cast("bigint").alias("words"), _md5(X.collapse_space("text")).alias("text_md5"))


@query("f14_times_links_ids", """
SELECT event_id, CAST(event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59 AS BIGINT) AS seconds,
       CAST((event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59) // 60 AS BIGINT) AS minute,
       CASE WHEN event_id % 5 <> 0 THEN 'https://a/' || user_id || '#t=' || (event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59) END AS link,
       'g' || user_id || ':U' || (event_id % 7) || ':' || (event_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59) AS id FROM events""")
def f14(spark, d):
    n, u = F.col("event_id"), F.col("user_id")
    mark = F.format_string("%02d:%02d:%02d", n % 24, n % 60, n % 59)
    s = X.clock_seconds(mark)
    url = F.when(n % 5 != 0, F.concat(F.lit("https://a/"), u))
    return A.table(spark, d, "events").select(
        "event_id", s.cast("bigint").alias("seconds"), X.minute_bucket(s).cast("bigint").alias("minute"), X.deep_link(url, s).alias("link"),
        X.passage_id(F.concat(F.lit("g"), u), F.concat(F.lit("U"), n % 7), s).alias("id"))


@query("f15_clean_headlines", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'say ' || event_id WHEN 1 THEN 'it''s ' || event_id WHEN 2 THEN 'Plain, words ' || event_id || ' here' ELSE 'tab' || chr(9) || event_id END AS headline FROM events""")
def f15(spark, d):
    n = F.col("event_id")
    raw = (F.when(n % 4 == 0, F.concat(F.lit('b"say '), n, F.lit('"'))).when(n % 4 == 1, F.concat(F.lit('b"it\'s '), n, F.lit('"')))
           .when(n % 4 == 2, F.concat(F.lit("Plain, words "), n, F.lit(' here"'))).otherwise(F.concat(F.lit("b'tab\\t"), n, F.lit("'"))))
    return A.table(spark, d, "events").select("event_id", X.clean_headline(raw).alias("headline"))


@query("f16_citation_markers", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1,2' ELSE '2' END AS cited, '77' AS cited_invalid FROM events""")
def f16(spark, d):
    n = F.col("event_id")
    report = F.concat(F.lit("The crowd [2] agrees [77]"), F.when(n % 3 == 0, " and [1] too [2].").otherwise("."))
    rows = A.table(spark, d, "events").select("event_id", report.alias("report_md"),
                                              F.array(F.struct(F.lit(1).alias("n")), F.struct(F.lit(2).alias("n"))).alias("citations"))
    out = X.check_citations(rows)
    return out.select("event_id", F.array_join("cited", ",").alias("cited"), F.array_join("cited_invalid", ",").alias("cited_invalid"))


@query("f16_report_sections", """
SELECT event_id, 'heading' AS kind, 'Bull case ' || event_id AS text FROM events UNION ALL SELECT event_id, 'paragraph', 'first line second line' FROM events
UNION ALL SELECT event_id, 'heading', 'Bear: ' || user_id FROM events""")
def f16_sections(spark, d):
    md = F.concat(F.lit("\n## Bull case "), F.col("event_id"), F.lit("\n\nfirst line\n  second line\n\n\n**Bear: "), F.col("user_id"), F.lit("**\n"))
    return A.table(spark, d, "events").select("event_id", F.inline(X.report_blocks(md)))


# --- S7, W8 -------------------------------------------------------------------------------------------
def _transcripts(spark, d):
    """Published transcripts out of conversations: up to 100 turns each."""
    turn = F.col("turn")
    seconds = (turn * 30).cast("int")
    mark = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    block = F.concat(mark, F.lit("\n"), F.when(turn % 3 != 2, F.concat(F.lit("Speaker "), turn, F.lit(": "))).otherwise(""),
                     F.when(turn % 7 == 6, " ").otherwise(F.concat(F.lit("x "), F.col("text"))))
    return (A.table(spark, d, "conversations").groupBy(F.concat_ws("-", "conv_id", F.floor(turn / 100)).alias("guid"))
            .agg(F.array_sort(F.collect_list(F.struct(turn, block.alias("b")))).alias("bs"))
            .select("guid", F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n").alias("raw")))


@query("s7_w8_transcript_segments", r"""
WITH k AS (SELECT conv_id || '-' || (turn // 100) AS guid, turn, 'x ' || text AS text FROM conversations WHERE turn % 7 <> 6),
s AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY turn) - 1 AS seg_idx, turn * 30e0 AS start FROM k)
SELECT guid, CAST(seg_idx AS INTEGER) AS seg_idx, start, coalesce(lead(start) OVER (PARTITION BY guid ORDER BY turn), start) AS "end",
       CASE WHEN turn % 3 <> 2 THEN 'Speaker ' || turn END AS speaker, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM s""")
def s7(spark, d):
    return parse_transcripts(_transcripts(spark, d)).select("guid", "seg_idx", "start", "end", "speaker", _md5("text").alias("text_md5"))


# --- J9, U4, P11 -----------------------------------------------------------------------------------------
_W = r"[\p{L}\p{N}\p{M}\p{Pc}]"
_N = r"[^\p{L}\p{N}\p{M}\p{Pc}]"


def _hits_sql(source: str) -> str:
    """Hits per text as tokens with offsets; ``source`` gives (doc, lc)."""
    rows = ", ".join(f"('{s}', '{a}', {str(b).upper()})" for s, a, b in ALIASES)
    cues = "|".join(CUES)
    return f"""
src AS ({source}),
al(subject, alias, ambiguous) AS (VALUES {rows}),
tk AS (SELECT doc, lc, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc, lc, regexp_extract_all(lc, '{_W}+|{_N}+') AS ts FROM src)),
po AS (SELECT doc, lc, i, t, coalesce(sum(length(t)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
       lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM tk WINDOW w AS (PARTITION BY doc ORDER BY i)),
h0 AS (SELECT doc, lc, subject, alias, ambiguous, CAST(s AS BIGINT) AS s, CAST(s + length(alias) AS BIGINT) AS e FROM po JOIN al ON t = alias
       UNION ALL SELECT doc, lc, subject, alias, ambiguous, CAST(s AS BIGINT), CAST(s + length(alias) AS BIGINT) FROM po JOIN al ON contains(alias, ' ') AND t || t1 || t2 = alias),
cued AS (SELECT *, regexp_matches(substr(lc, greatest(0, s - 220) + 1, s + 220 - greatest(0, s - 220)), '(^|{_N})({cues})($|{_N})') AS cue FROM h0),
"""


_STRICT = """
ok AS (SELECT * FROM cued WHERE NOT ambiguous OR cue),
free AS (SELECT * FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.doc = a.doc AND b.subject = a.subject AND length(b.alias) > length(a.alias)
         AND b.s <= a.s AND a.s < b.e)),
n AS (SELECT doc, subject, count(*) AS n, min(s) AS first_start FROM free GROUP BY 1, 2)
"""
# The dimension has no two aliases of one subject of which the longer could itself be covered by a third one,
# so "covered by any longer hit" is the same as "covered by an accepted one" except for S7's two equally long
# aliases, which are resolved by alphabet below.
_CONV = "SELECT conv_id || ':' || turn AS doc, lower(text) AS lc FROM conversations"
_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS doc, lower(text) AS lc FROM documents"


def _equal_length(sql_text: str) -> str:
    return sql_text.replace("length(b.alias) > length(a.alias)",
                            "(length(b.alias) > length(a.alias) OR (length(b.alias) = length(a.alias) AND b.alias < a.alias))")


def _texts(spark, d):
    return A.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), "text")


@query("j9_mention_counts", "WITH " + _hits_sql(_CONV) + _equal_length(_STRICT) + "SELECT doc, subject, n, first_start FROM n")
def j9(spark, d):
    out = M.count_subjects(_texts(spark, d), _aliases(spark), doc_id="doc", cues=CUES)
    return out.select("doc", "subject", F.col("n").cast("bigint").alias("n"), F.col("first_start").cast("bigint").alias("first_start"))


@query("j9_mention_counts_by_token_join", "WITH " + _hits_sql(_CONV) + _equal_length(_STRICT) + "SELECT doc, subject, n, first_start FROM n")
def j9_tokens(spark, d):
    out = M.count_subjects(_texts(spark, d), _aliases(spark, 0), doc_id="doc", cues=CUES)
    return out.select("doc", "subject", F.col("n").cast("bigint").alias("n"), F.col("first_start").cast("bigint").alias("first_start"))


@query("j9_mention_counts_documents", "WITH " + _hits_sql(_DOCS) + _equal_length(_STRICT) + "SELECT doc, subject, n, first_start FROM n")
def j9_documents(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    out = M.count_subjects(docs, _aliases(spark), doc_id="doc", cues=CUES)
    return out.select("doc", "subject", F.col("n").cast("bigint").alias("n"), F.col("first_start").cast("bigint").alias("first_start"))


@query("j9_find_subjects_loose", "WITH " + _hits_sql(_CONV) + " z AS (SELECT 1) SELECT DISTINCT doc, subject FROM cued")
def j9_loose(spark, d):
    return M.find_subjects(_texts(spark, d), _aliases(spark), doc_id="doc", strict=False, cues=CUES)


@query("u4_emit_set", "WITH " + _hits_sql(_CONV) + _equal_length(_STRICT) + """,
k AS (SELECT *, count(*) OVER (PARTITION BY doc) AS listed, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first_start, subject) AS r FROM n)
SELECT doc, subject, n FROM k WHERE listed <= 4 AND (r = 1 OR n >= 2)""")
def u4(spark, d):
    counts = M.count_subjects(_texts(spark, d), _aliases(spark), doc_id="doc", cues=CUES)
    return M.emit_set(counts, "doc").select("doc", "subject", F.col("n").cast("bigint").alias("n"))


@query("p11_episodes_naming_a_subject", "WITH " + _hits_sql("SELECT CAST(conv_id AS VARCHAR) AS doc, lower('Episode ' || conv_id || ' ' || text) AS lc FROM conversations WHERE turn = 0") + """
z AS (SELECT 1) SELECT DISTINCT doc AS guid FROM cued""")
def p11(spark, d):
    return M.episodes_naming_a_subject(A.episodes(spark, d), _aliases(spark)).select("guid")


# --- J10, W9 -----------------------------------------------------------------------------------------------
_GROW = """,
sg AS (SELECT CAST(conv_id AS VARCHAR) AS guid, turn AS i, text, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM conversations),
ln AS (SELECT guid, max(i) AS last FROM sg GROUP BY 1),
tr AS (SELECT guid, i, last FROM sg JOIN ln USING (guid) WHERE {trigger}),
st AS (SELECT guid, i, last, unnest(range(0, last + 1)) AS k FROM tr),
ed AS (SELECT *, i - least(i, greatest((k + 1) // 2, k - (last - i))) AS lo, i + k - least(i, greatest((k + 1) // 2, k - (last - i))) AS hi FROM st),
sz AS (SELECT e.guid, e.i, e.k, e.lo, e.hi, e.last, sum(s.w) AS words, string_agg(s.text, ' ' ORDER BY s.i) AS text FROM ed e JOIN sg s ON s.guid = e.guid AND s.i BETWEEN lo AND hi GROUP BY ALL),
gr AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY guid, i ORDER BY words < 140, CASE WHEN words < 140 THEN -k ELSE k END) = 1)
"""


@query("j10_expanded_passages", "WITH one AS (SELECT 1)" + _GROW.format(trigger="i % 2 = 0") + """
SELECT guid, CAST(i AS INTEGER) AS seg_idx, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, CAST(words AS BIGINT) AS words, lo * 30e0 AS start_s, md5(text) AS text_md5 FROM gr""")
def j10(spark, d):
    grown = G.expand_passages(A.segments(spark, d), F.col("seg_idx") % 2 == 0)
    return grown.select("guid", "seg_idx", "lo", "hi", F.col("words").cast("bigint").alias("words"), "start_s", _md5("text").alias("text_md5"))


_STEP = "(1 + conv_id % 4 * 20)"
_SPARSE = f"""
WITH pc AS (SELECT conv_id || ':' || turn AS guid, {_STEP} AS step, string_split(text, '.') AS ps FROM conversations),
sg AS (SELECT guid, k AS i, step, CASE WHEN k % step = 0 THEN trim(ps[k // step + 1]) ELSE '' END AS text
       FROM (SELECT *, unnest(range(len(ps) * step)) AS k FROM pc)),
sw AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM sg),
pf AS (SELECT *, sum(w) OVER (PARTITION BY guid ORDER BY i) AS upto, max(i) OVER (PARTITION BY guid) AS last FROM sw),
tr AS (SELECT guid, i, last, w FROM pf WHERE i % (3 * step) = 0),
st AS (SELECT *, unnest(range(0, last + 1)) AS k FROM tr),
ed AS (SELECT guid, i, k, w, i - least(i, greatest((k + 1) // 2, k - (last - i))) AS lo, i + k - least(i, greatest((k + 1) // 2, k - (last - i))) AS hi FROM st),
sz AS (SELECT e.guid, e.i, e.k, e.lo, e.hi, h.upto - l.upto + l.w AS words FROM ed e JOIN pf h ON h.guid = e.guid AND h.i = e.hi JOIN pf l ON l.guid = e.guid AND l.i = e.lo),
gr AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY guid, i ORDER BY words < 140, CASE WHEN words < 140 THEN -k ELSE k END) = 1)
SELECT g.guid, CAST(g.i AS INTEGER) AS seg_idx, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, CAST(any_value(g.words) AS BIGINT) AS words,
       lo * 1e0 AS start_s, md5(trim(string_agg(s.text, ' ' ORDER BY s.i))) AS text_md5
FROM gr g JOIN sg s ON s.guid = g.guid AND s.i BETWEEN lo AND hi GROUP BY g.guid, g.i, lo, hi"""


@query("j10_blank_segments", _SPARSE)
def j10_blank(spark, d):
    """Every turn an episode, its sentences the segments, with up to 60 blank segments between them."""
    step = F.expr(_STEP)
    pieces = A.table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("guid"), step.alias("step"), F.split("text", "[.]").alias("ps"))
    segments = (pieces.withColumn("seg_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.size("ps") * F.col("step") - 1))).select(
        "guid", F.col("seg_idx").cast("int").alias("seg_idx"), F.col("seg_idx").cast("double").alias("start"), F.lit(None).cast("string").alias("speaker"),
        F.when(F.col("seg_idx") % F.col("step") == 0, F.trim(F.get("ps", F.expr("cast(seg_idx div step as int)")))).otherwise("").alias("text"),
        (F.col("seg_idx") % (F.col("step") * 3) == 0).alias("named")))
    grown = G.expand_passages(segments, F.col("named"))
    return grown.select("guid", "seg_idx", "lo", "hi", F.col("words").cast("bigint").alias("words"), "start_s", _md5("text").alias("text_md5"))


_PASSAGES = ("WITH " + _hits_sql("SELECT conv_id || ':' || turn AS doc, lower(text) AS lc FROM conversations").rstrip().rstrip(",") + _GROW.format(
    trigger="guid || ':' || i IN (SELECT doc FROM cued)").replace("cued", "cued") + """,
ps AS (SELECT guid || ':' || i AS doc, lower(text) AS lc, * FROM gr WHERE words >= 25),
""" + _hits_sql("SELECT doc, lc FROM ps").replace("src AS", "src2 AS").replace("FROM src)", "FROM src2)").replace("al(subject", "al2(subject").replace("JOIN al ", "JOIN al2 ")
    .replace("tk AS", "tk2 AS").replace("FROM tk ", "FROM tk2 ").replace("po AS", "po2 AS").replace("FROM po ", "FROM po2 ").replace("h0 AS", "h02 AS").replace("FROM h0)", "FROM h02)")
    .replace("cued AS", "cued2 AS") + _equal_length(_STRICT).replace("FROM cued ", "FROM cued2 ") + """,
k AS (SELECT *, count(*) OVER (PARTITION BY doc) AS listed, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first_start, subject) AS r FROM n),
em AS (SELECT ps.guid, ps.i, ps.lo, ps.words, k.subject, k.n FROM k JOIN ps USING (doc) WHERE listed <= 4 AND (r = 1 OR n >= 2)),
f AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY guid, subject, lo * 30 // 60 ORDER BY i) = 1)
""")


@query("w9_passages_per_minute", _PASSAGES + """
SELECT 'x' || guid || ':' || subject || ':' || (lo * 30) AS external_id, subject, CAST(i AS INTEGER) AS seg_idx, CAST(words AS BIGINT) AS words, n AS mentions FROM f""")
def w9(spark, d):
    built = G.build_passages(A.segments(spark, d), _aliases(spark), cues=CUES)
    return built.select(X.passage_id(F.concat(F.lit("x"), "guid"), "subject", "start_s").alias("external_id"), "subject", "seg_idx",
                        F.col("words").cast("bigint").alias("words"), F.col("mentions").cast("bigint").alias("mentions"))


@query("w9_passage_records", _PASSAGES + """
SELECT guid || ':' || subject || ':' || (lo * 30) AS external_id, 'show ' || CAST(guid AS BIGINT) % 5 AS source, 'podcast' AS source_type, subject,
       'Episode ' || guid AS title, CASE WHEN CAST(guid AS BIGINT) % 7 <> 0 THEN 'https://audio.example/' || guid || '#t=' || (lo * 30) END AS url,
       strftime(make_timestamp((1704067200 + CAST(guid AS BIGINT) * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, CAST(words AS BIGINT) AS words, c.role AS speaker
FROM f JOIN conversations c ON c.conv_id = CAST(f.guid AS BIGINT) AND c.turn = f.i""")
def w9_records(spark, d):
    out = G.build_passages(A.segments(spark, d), _aliases(spark), A.episodes(spark, d), cues=CUES)
    return out.select("external_id", "source", "source_type", "subject", "title", "url", F.col("ts").cast("string").alias("ts"),
                      F.col("words").cast("bigint").alias("words"), "speaker")
