"""Readings, periods, citations, history and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara.functions import scalars as S
from opinara.functions.rounding import py_round
from opinara.operators import readings as R
from opinara.operators import records as P
from opinara.operators import search
from opinara.operators.coverage import (coverage_report, coverage_rows, passage_yield, requested_basket, resolve_subjects,
                                        with_display)
from opinara.plans import readings as V
from opinara.session import scratch_path
from opinara.verification.registry import query
from opinara.verification.sql_views import py_round as R_, sql, stamp

NOW = "2024-01-25 12:00:00"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _now():
    return F.to_timestamp(F.lit(NOW))


# --- A1, A2, A11, A12 ---------------------------------------------------------------------------
@query("a1_subject_reading", sql("items_e", f""",
r AS (SELECT subject, avg(score) m, avg(abs(score)) c, stddev_pop(score) d, count(*) volume FROM items_e GROUP BY 1),
q AS (SELECT subject, {R_('m', 1)} consensus_score, {R_('c', 1)} conviction, {R_('d', 1)} dispersion, volume FROM r)
SELECT *, CASE WHEN consensus_score > 15 THEN 'bullish' WHEN consensus_score < -15 THEN 'bearish' ELSE 'neutral' END AS label FROM q"""))
def a1(spark, d):
    return R.subject_reading(A.items_e(spark, d))


@query("a2_period_readings_month", sql("months", "SELECT subject, period, consensus, n FROM months WHERE n >= 3"))
def a2_month(spark, d):
    return R.period_readings(A.items_o(spark, d), "month", 3)


@query("a2_period_readings_week", sql("items_o", f""",
r AS (SELECT subject, strftime(date_trunc('week', ts), '%Y-%m-%d') period, avg(score) m, count(*) n FROM items_o GROUP BY 1, 2)
SELECT subject, period, {R_('m', 1)} AS consensus, n FROM r WHERE n >= 3"""))
def a2_week(spark, d):
    return R.period_readings(A.items_o(spark, d), "week", 3)


@query("a11_items_per_subject", sql("items_o", """
SELECT n_name || '' AS nation, count(external_id) AS n_items, (SELECT count(*) FROM items_o) AS corpus
FROM nation LEFT JOIN items_o ON nation = n_nationkey GROUP BY 1"""))
def a11(spark, d):
    items = A.items_o(spark, d).withColumn("subject", F.col("nation").cast("string"))
    subjects = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("subject"), F.col("n_name").alias("nation"))
    total = R.corpus_size(A.items_o(spark, d)).scalar()
    return R.items_per_subject(subjects, items).select("nation", "n_items", total.alias("corpus"))


@query("a11_readings_since", sql("readings_e", """
SELECT count(*) AS n FROM readings_e WHERE computed_at >= TIMESTAMP '2024-01-20 00:00:00'"""))
def a11_since(spark, d):
    return R.readings_since(A.readings_e(spark, d), F.to_timestamp(F.lit("2024-01-20 00:00:00")))


@query("a12_latest_instant", sql("readings_e", f"""
SELECT subject, {stamp('max(computed_at)')} AS computed_at FROM readings_e GROUP BY 1"""))
def a12(spark, d):
    return R.latest_instant(A.readings_e(spark, d)).select("subject", _stamp("computed_at").alias("computed_at"))


@query("a15_counts_by_category", sql("tiered", """
SELECT source_tier, event_type, count(*) AS n FROM tiered GROUP BY 1, 2"""))
def a15(spark, d):
    return R.counts_by(A.daily_e(spark, d).withColumn("event_type", F.regexp_extract("source", r"([a-z]+)$", 1))
                       .withColumn("event_type", F.when(F.col("source") == "arxiv", "error")
                                   .when(F.col("source") == "news:feed", "purchase").otherwise(F.col("event_type"))),
                       "source_tier", "event_type")


# --- T3, A26, P13 -----------------------------------------------------------------------------------
_PICK = """,
bulls AS (SELECT *, 0 AS g, row_number() OVER (PARTITION BY subject ORDER BY score DESC, similarity DESC, external_id) AS k
          FROM items_e WHERE score > 0 QUALIFY k <= 7),
bears AS (SELECT *, 1 AS g, row_number() OVER (PARTITION BY subject ORDER BY score, similarity DESC, external_id) AS k
          FROM items_e WHERE score < 0 QUALIFY k <= 7),
rest AS (SELECT *, 2 AS g, row_number() OVER (PARTITION BY subject ORDER BY similarity DESC, external_id) AS k FROM items_e
         WHERE external_id NOT IN (SELECT external_id FROM bulls UNION ALL SELECT external_id FROM bears)),
picked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY g, k) AS n
           FROM (SELECT * FROM bulls UNION ALL SELECT * FROM bears UNION ALL SELECT * FROM rest) QUALIFY n <= 14)
"""


@query("t3_balanced_citations", sql("items_e", _PICK + "SELECT subject, n, external_id, score FROM picked"))
def t3(spark, d):
    return R.pick_citations(A.items_e(spark, d)).select("subject", F.col("n").cast("bigint").alias("n"), "external_id", "score")


@query("p13_citation_lines", sql("items_e", _PICK + """
SELECT subject, n, '[' || n || '] (' || source || ', stance ' || CASE WHEN score >= 0 THEN '+' ELSE '' END || score || ') '
       || substr(text, 1, 280) AS line, substr(text, 1, 200) AS quote FROM picked"""))
def p13(spark, d):
    return R.pick_citations(A.items_e(spark, d)).select(
        "subject", F.col("n").cast("bigint").alias("n"), P.report_line().alias("line"), F.substring("text", 1, 200).alias("quote"))


@query("a26_citation_arrays", sql("items_e", _PICK + """
SELECT subject, len(list(n)) AS n_citations, string_agg(n || '|' || source || '|' || url || '|' || score || '|' || substr(text, 1, 200),
       ';' ORDER BY n) AS citations FROM picked GROUP BY 1"""))
def a26(spark, d):
    arrays = R.citation_arrays(R.pick_citations(A.items_e(spark, d)))
    line = lambda c: F.concat_ws("|", c["n"].cast("string"), c["source"], c["url"], c["score"].cast("string"), c["quote"])
    return arrays.select("subject", F.size("citations").cast("bigint").alias("n_citations"),
                         F.array_join(F.transform("citations", line), ";").alias("citations"))


# --- T4..T8 ------------------------------------------------------------------------------------------
_READ = f"subject, {stamp('computed_at')} AS computed_at, consensus_score, volume"


def _read(df):
    return df.select("subject", _stamp("computed_at").alias("computed_at"), "consensus_score", "volume")


@query("t4_latest_reading", sql("readings_e", f"""
SELECT {_READ} FROM readings_e r WHERE r.computed_at = (SELECT max(x.computed_at) FROM readings_e x WHERE x.subject = r.subject)"""))
def t4(spark, d):
    return _read(R.latest_reading(A.readings_e(spark, d)))


@query("t5_reading_history", sql("readings_e", f"""
SELECT {_READ}, row_number() OVER (PARTITION BY subject ORDER BY readings_e.computed_at) AS position FROM readings_e QUALIFY position <= 9"""))
def t5(spark, d):
    h = R.reading_history(A.readings_e(spark, d), 9)
    return h.select("subject", _stamp("computed_at").alias("computed_at"), "consensus_score", "volume",
                    F.col("position").cast("bigint").alias("position"))


@query("t6_recent_days", sql("tiered", """
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, count(*) AS n FROM tiered GROUP BY tiered.run_date
ORDER BY tiered.run_date DESC LIMIT 7"""))
def t6(spark, d):
    days = A.daily_e(spark, d).groupBy("run_date").agg(F.count(F.lit(1)).alias("n"))
    return R.recent_history(days, 7).select(F.col("run_date").cast("string").alias("run_date"), "n")


@query("t7_stale_readings", sql("readings_e", f""",
m AS (SELECT subject, max(computed_at) AS last_at FROM readings_e WHERE subject <> 'U3' OR computed_at < TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1),
a AS (SELECT subject, (epoch_us(TIMESTAMP '2024-02-03 12:00:00') - epoch_us(last_at)) / 3600000000e0 AS age FROM m)
SELECT subject, {R_('age', 4)} AS age_h FROM a WHERE age > 24 ORDER BY age DESC, subject LIMIT 8"""))
def t7(spark, d):
    rows = A.readings_e(spark, d).filter("subject != 'U3' or computed_at < '2024-01-10 00:00:00'")
    return (R.stale_readings(rows, F.to_timestamp(F.lit("2024-02-03 12:00:00")), 24.0, 8)
            .select("subject", py_round("age_h", 4).alias("age_h")))


@query("t8_first_n_per_group", sql("items_e", """
SELECT source, external_id FROM items_e QUALIFY row_number() OVER (PARTITION BY source ORDER BY ingest_seq) <= 25"""))
def t8(spark, d):
    from opinara.operators.coverage import first_n
    return first_n(A.items_e(spark, d), 25, ["source"]).select("source", "external_id")


# --- A29, W11, W12 --------------------------------------------------------------------------------------
@query("a29_series_deltas", sql("aligned", f""",
r AS (SELECT subject, arg_max(conviction, period) - arg_min(conviction, period) AS dc,
             (arg_max(close, period) - arg_min(close, period)) / arg_min(close, period) AS dp
      FROM aligned WHERE close IS NOT NULL OR conviction IS NOT NULL GROUP BY 1)
SELECT subject, {R_('dc', 1)} AS conviction_change, {R_('dp', 6)} AS price_change FROM r"""))
def a29(spark, d):
    from opinara.operators.study import conviction_with_returns
    series = conviction_with_returns(R.period_readings(A.items_o(spark, d)), _prices(spark, d)).withColumnRenamed("close", "price")
    return R.series_deltas(series).select("subject", py_round("conviction_change", 1).alias("conviction_change"),
                                          py_round("price_change", 6).alias("price_change"))


def _prices(spark, d, fine=False):
    from opinara.sources.tables import price_series
    return price_series(A.bars(spark, d, fine))


@query("w11_scaled_series", sql("aligned", f""",
b AS (SELECT *, min(conviction) OVER w AS lo0, max(conviction) OVER w AS hi0 FROM aligned WINDOW w AS (PARTITION BY subject)),
c AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 1 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 1 ELSE hi0 END AS hi FROM b),
e AS (SELECT subject, period, (conviction - (lo - (hi - lo) * 0.12e0)) / ((hi + (hi - lo) * 0.12e0) - (lo - (hi - lo) * 0.12e0)) AS p FROM c)
SELECT subject, period, {R_('p', 6)} AS conviction_pos FROM e"""))
def w11(spark, d):
    series = R.period_readings(A.items_o(spark, d)).withColumnRenamed("consensus", "conviction")
    return R.scale_series(series, "conviction").select("subject", "period", py_round("conviction_pos", 6).alias("conviction_pos"))


@query("w12_reading_trend", sql("readings_e", f"""
SELECT subject, {stamp('computed_at')} AS computed_at, consensus_score,
       row_number() OVER (PARTITION BY subject ORDER BY readings_e.computed_at) AS position,
       count(*) OVER (PARTITION BY subject) >= 2 AS drawable FROM readings_e"""))
def w12(spark, d):
    t = R.reading_trend(A.readings_e(spark, d))
    return t.select("subject", _stamp("computed_at").alias("computed_at"), "consensus_score",
                    F.col("position").cast("bigint").alias("position"), "drawable")


# --- A25, A28 ------------------------------------------------------------------------------------------------
@query("a25_coverage_report", sql("items_n", """,
v AS (SELECT c.subject, c.kind, coalesce(n, 0) AS volume, c.failed FROM
      (SELECT DISTINCT c_mktsegment || '-' || c_nationkey || '-' || (c_custkey % 14 + 1) AS subject, CASE WHEN c_nationkey % 5 = 0 THEN 'probe' ELSE 'core' END AS kind,
              c_nationkey = 7 AS failed FROM customer) c
      LEFT JOIN (SELECT subject || '-' || month(ts) AS subject, count(*) AS n FROM items_n GROUP BY 1) USING (subject)),
w AS (SELECT kind, CASE WHEN failed THEN 0 ELSE volume END AS volume,
             CASE WHEN failed THEN 'error' WHEN volume >= 40 THEN 'rich' WHEN volume >= 15 THEN 'ok' WHEN volume >= 1 THEN 'thin' ELSE 'empty' END AS b FROM v)
SELECT kind, count(*) AS n, list_sort(list(volume))[count(*) // 2 + 1] AS median_items, count(*) FILTER (b = 'rich') AS rich,
       count(*) FILTER (b = 'ok') AS ok, count(*) FILTER (b = 'thin') AS thin, count(*) FILTER (b = 'empty') AS empty,
       count(*) FILTER (b = 'error') AS error FROM w GROUP BY 1"""))
def a25(spark, d):
    nation = F.col("c_nationkey")
    subjects = A.table(spark, d, "customer").select(
        F.concat_ws("-", "c_mktsegment", nation, F.col("c_custkey") % 14 + 1).alias("subject"),
        F.when(nation % 5 == 0, "probe").otherwise("core").alias("kind"), (nation == 7).alias("failed")).distinct()
    by_month = F.concat_ws("-", "subject", F.month("ts")).alias("subject")
    volumes = A.items_n(spark, d).select(by_month).groupBy("subject").agg(F.count(F.lit(1)).alias("volume"))
    return coverage_report(coverage_rows(subjects.join(volumes, "subject", "left"), F.col("failed")))


@query("a28_passage_yield", sql("items_e", """
SELECT subject, count(*) AS candidates, count(*) FILTER (score > 20) AS kept FROM items_e GROUP BY 1"""))
def a28(spark, d):
    items = A.items_e(spark, d)
    return passage_yield(items, items.filter("score > 20"), "subject")


# --- subjects: J7, J8, J14, J15, P8, P9, P10 -------------------------------------------------------------------
def _dim(spark, d):
    """A subject dimension out of customers: one subject per (segment, nation), with gaps."""
    nation, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    return A.table(spark, d, "customer").select(nation, seg).distinct().select(
        F.lower(F.concat_ws(" ", seg, nation)).alias("input_key"), F.concat_ws(" ", seg, nation).alias("display"),
        F.lit("sector").alias("asset_type"), (nation % 4 != 0).alias("is_financial"),
        F.when(nation % 3 != 0, F.concat(F.substring(seg, 1, 2), F.lit("-"), nation)).alias("proxy"))


_DIM = """,
dim AS (SELECT DISTINCT lower(c_mktsegment || ' ' || c_nationkey) AS input_key, c_mktsegment || ' ' || c_nationkey AS display,
        c_nationkey % 4 <> 0 AS is_financial, CASE WHEN c_nationkey % 3 <> 0 THEN substr(c_mktsegment, 1, 2) || '-' || c_nationkey END AS proxy FROM customer),
asked AS (SELECT c_custkey, '  ' || c_mktsegment || ' ' || (c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END) || ' ' AS text FROM customer)
"""


def _asked(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", F.concat(
        F.lit("  "), "c_mktsegment", F.lit(" "), F.col("c_nationkey") + F.when(F.col("c_custkey") % 10 == 0, 100).otherwise(0), F.lit(" ")).alias("text"))


_ONE = "WITH one AS (SELECT 1)"


@query("j8_subject_resolution", _ONE + _DIM + """
SELECT c_custkey, upper(coalesce(nullif(proxy, ''), display)) AS subject FROM asked JOIN dim ON input_key = lower(trim(text))
UNION ALL SELECT c_custkey, 'unresolved' FROM asked WHERE lower(trim(text)) NOT IN (SELECT input_key FROM dim)""")
def j8(spark, d):
    known, unknown = resolve_subjects(_asked(spark, d), _dim(spark, d))
    return known.select("c_custkey", "subject").unionByName(unknown.select("c_custkey", F.lit("unresolved").alias("subject")))


@query("p9_market_subjects", _ONE + _DIM + """
SELECT display, coalesce(is_financial, FALSE) AND coalesce(proxy, '') <> '' AS in_scope FROM dim""")
def p9(spark, d):
    inside, outside = P.market_split(_dim(spark, d))
    return inside.select("display", F.lit(True).alias("in_scope")).unionByName(outside.select("display", F.lit(False).alias("in_scope")))


@query("p8_fresh_readings", sql("readings_e", f"""
SELECT {_READ}, TRUE AS cached FROM readings_e
WHERE (epoch_us(TIMESTAMP '{NOW}') - epoch_us(readings_e.computed_at)) / 3600000000e0 <= 24"""))
def p8(spark, d):
    f = P.fresh_readings(A.readings_e(spark, d), _now())
    return f.select("subject", _stamp("computed_at").alias("computed_at"), "consensus_score", "volume", "cached")


# Subjects cut by month of the year, so that counts stay small; months 13 and 14 have no items.
_BY_MONTH = """, asked AS (SELECT DISTINCT c_mktsegment || '-' || c_nationkey || '-' || (c_custkey % 14 + 1) AS subject, c_nationkey FROM customer),
cut AS (SELECT subject || '-' || month(ts) AS subject, external_id FROM items_n)
"""


def _asked_by_month(spark, d):
    return A.table(spark, d, "customer").select(
        F.concat_ws("-", "c_mktsegment", "c_nationkey", F.col("c_custkey") % 14 + 1).alias("subject"), "c_nationkey").distinct()


def _items_by_month(spark, d):
    return A.items_n(spark, d).withColumn("subject", F.concat_ws("-", "subject", F.month("ts")))


@query("p10_thin_subjects", sql("items_n", _BY_MONTH + """
SELECT s.subject, count(i.external_id) AS n_items FROM asked s LEFT JOIN cut i ON s.subject = i.subject GROUP BY 1 HAVING count(i.external_id) < 25"""))
def p10(spark, d):
    return P.thin_subjects(R.items_per_subject(_asked_by_month(spark, d).select("subject"), _items_by_month(spark, d)))


@query("j7_item_counts", sql("items_n", _BY_MONTH + """
SELECT s.subject, count(i.external_id) AS n_items FROM asked s LEFT JOIN cut i ON s.subject = i.subject GROUP BY 1"""))
def j7(spark, d):
    return R.items_per_subject(_asked_by_month(spark, d).select("subject"), _items_by_month(spark, d))


@query("j14_display_names", _ONE + _DIM + """
SELECT c_custkey, coalesce(display, substr(c_mktsegment, 1, 2) || '-' || c_nationkey) AS display
FROM customer LEFT JOIN dim ON proxy = substr(c_mktsegment, 1, 2) || '-' || c_nationkey""")
def j14(spark, d):
    keyed = A.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.substring("c_mktsegment", 1, 2), F.lit("-"), F.col("c_nationkey")).alias("subject"))
    return with_display(keyed, _dim(spark, d).filter("proxy is not null")).select("c_custkey", "display")


@query("j15_requested_basket", """
SELECT t.ticker, coalesce(k.query, t.ticker) AS query FROM (SELECT DISTINCT upper(trim(c_name)) AS ticker FROM customer) t
LEFT JOIN (SELECT upper(c_name) AS ticker, c_mktsegment AS query FROM customer WHERE c_custkey % 2 = 0) k ON t.ticker = k.ticker""")
def j15(spark, d):
    customer = A.table(spark, d, "customer")
    known = customer.filter("c_custkey % 2 = 0").select(F.upper("c_name").alias("ticker"), F.col("c_mktsegment").alias("query"))
    return requested_basket(customer.select(F.concat(F.lit(" "), F.lower("c_name"), F.lit(" ")).alias("ticker")), known).select("ticker", "query")


# --- T1, T2 ----------------------------------------------------------------------------------------------------
def _query_vector(spark, d):
    return list(A.vectors(spark, d).filter("external_id = 0").select("embedding").first()[0])


@query("t1_cosine_top_k", sql("vectors", f""",
s AS (SELECT v.external_id, list_cosine_similarity(v.embedding, q.embedding) AS s FROM vectors v, (SELECT embedding FROM vectors WHERE external_id = 0) q)
SELECT external_id, {R_('s', 4)} AS similarity FROM s ORDER BY s DESC, external_id LIMIT 200"""))
def t1(spark, d):
    top = search.semantic_search(A.vectors(spark, d), _query_vector(spark, d), 200)
    return top.select("external_id", py_round("similarity", 4).alias("similarity"))


@query("t1_cosine_top_k_per_subject", sql("vectors", f""",
q AS (SELECT subject, arg_min(embedding, external_id) AS v FROM vectors GROUP BY 1),
s AS (SELECT x.subject, x.external_id, list_cosine_similarity(x.embedding, q.v) AS s FROM vectors x JOIN q USING (subject))
SELECT subject, external_id, {R_('s', 4)} AS similarity, row_number() OVER (PARTITION BY subject ORDER BY s DESC, external_id) AS rank
FROM s QUALIFY rank <= 20"""))
def t1_many(spark, d):
    vectors = A.vectors(spark, d)
    return _ranked(search.search_many(vectors, _first_of_each(vectors), 20))


def _first_of_each(vectors):
    """The first item of each subject as that subject's query."""
    first = vectors.groupBy("subject").agg(F.min("external_id").alias("external_id"))
    return vectors.join(first, ["subject", "external_id"]).select(
        F.col("subject").alias("query_id"), "subject", F.col("embedding").alias("query_vector"))


def _ranked(found):
    return found.select(
        "subject", "external_id", py_round("similarity", 4).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _written_index(spark, vectors, copies=1):
    centres = search.train_cells(vectors, 100)
    path = scratch_path(spark, "index")
    search.write_index(vectors, centres, path, copies)
    return spark.read.parquet(path), centres


@query("t2_all_cells_probed", sql("vectors", f""",
s AS (SELECT v.external_id, list_cosine_similarity(v.embedding, q.embedding) AS s FROM vectors v, (SELECT embedding FROM vectors WHERE external_id = 0) q)
SELECT external_id, {R_('s', 4)} AS similarity FROM s ORDER BY s DESC, external_id LIMIT 50"""))
def t2_all(spark, d):
    """A written index of which every cell is probed gives the exact result."""
    index, centres = _written_index(spark, A.vectors(spark, d))
    found = search.match_items(index, centres, _query_vector(spark, d), 50, probes=len(centres))
    return found.select("external_id", py_round("similarity", 4).alias("similarity"))


@query("t2_inverted_file_search")
def t2(spark, d):
    vectors = A.vectors(spark, d)
    index, centres = _written_index(spark, vectors)
    found = search.match_items(index, centres, _query_vector(spark, d), 50, probes=20)
    return found.select("external_id", "cell", py_round("similarity", 4).alias("similarity"))


@query("t2_many_queries_all_cells", sql("vectors", f""",
q AS (SELECT subject, arg_min(embedding, external_id) AS v FROM vectors GROUP BY 1),
s AS (SELECT x.subject, x.external_id, list_cosine_similarity(x.embedding, q.v) AS s FROM vectors x JOIN q USING (subject))
SELECT subject, external_id, {R_('s', 4)} AS similarity, row_number() OVER (PARTITION BY subject ORDER BY s DESC, external_id) AS rank
FROM s QUALIFY rank <= 20"""))
def t2_many(spark, d):
    """A batch of queries over an index that half of the items were added to later, every cell probed."""
    vectors = A.vectors(spark, d)
    centres = search.train_cells(vectors, 100)
    path = scratch_path(spark, "index")
    search.write_index(vectors.filter("external_id % 2 = 0"), centres, path)
    search.add_to_index(vectors.filter("external_id % 2 = 1"), centres, path)
    return _ranked(search.match_many(spark.read.parquet(path), centres, _first_of_each(vectors), 20, probes=len(centres)))


@query("t2_recall_at_20_probes", sql("vectors", """,
n AS (SELECT count(*) AS n FROM vectors)
SELECT (SELECT count(*) FROM vectors WHERE external_id % 100 = 0) AS queries,
       (SELECT count(*) FROM vectors WHERE external_id % 100 = 0) * least(n, 10) AS wanted, TRUE AS enough FROM n"""))
def t2_recall(spark, d):
    """Of the ten closest items of every hundredth item, the share found in 20 of 100 cells; enough is 0.9.

    Items lie in four cells each: with one, 20 probes find about 0.7.
    """
    vectors = A.vectors(spark, d)
    index, centres = _written_index(spark, vectors, 4)
    queries = vectors.filter("external_id % 100 = 0").select(
        F.col("external_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = search.match_many(index, centres, queries, 10, probes=len(centres)).select("query_id", "external_id")
    found = search.match_many(index, centres, queries, 10, probes=20).select("query_id", "external_id", F.lit(1).alias("hit"))
    met = exact.join(found, ["query_id", "external_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"),
                   (F.sum(F.coalesce("hit", F.lit(0))) >= F.lit(0.9) * F.count(F.lit(1))).alias("enough"))


# --- views ---------------------------------------------------------------------------------------------------------
@query("v1_corpus_stats", sql("items_e", "SELECT count(*) AS items FROM items_e"))
def v1(spark, d):
    return V.corpus_stats(A.items_e(spark, d))


def _user_dim(spark, d):
    """Users grouped by last digit; the resolver key is ``user group n``."""
    n = F.col("user_id") % 10
    return A.table(spark, d, "events").select(n.alias("n")).distinct().select(
        F.concat(F.lit("user group "), F.col("n")).alias("input_key"), F.concat(F.lit("Group "), F.col("n")).alias("display"),
        F.lit("group").alias("asset_type"), (F.col("n") != 4).alias("is_financial"), F.concat(F.lit("U"), F.col("n")).alias("proxy"))


def _user_requests(spark, d):
    return A.table(spark, d, "events").select(F.concat(F.lit(" User group "), F.col("user_id") % 12).alias("text")).distinct()


_ASK = """, asked AS (SELECT DISTINCT ' User group ' || (user_id % 12) AS text FROM events),
known AS (SELECT text, 'U' || replace(lower(trim(text)), 'user group ', '') AS subject FROM asked
          WHERE lower(trim(text)) IN (SELECT 'user group ' || (user_id % 10) FROM events))
"""


@query("v2_latest_for_request", sql("readings_e", _ASK + f"""
SELECT text, {_READ} FROM known JOIN readings_e USING (subject) QUALIFY row_number() OVER (PARTITION BY text ORDER BY readings_e.computed_at DESC) = 1"""))
def v2(spark, d):
    out = V.latest_for(_user_requests(spark, d), _user_dim(spark, d), A.readings_e(spark, d))
    return out.select("text", "subject", _stamp("computed_at").alias("computed_at"), "consensus_score", "volume")


@query("v3_history_for_request", sql("readings_e", _ASK + f"""
SELECT text, {_READ}, row_number() OVER (PARTITION BY text ORDER BY readings_e.computed_at) AS position FROM known JOIN readings_e USING (subject)
QUALIFY position <= 5"""))
def v3(spark, d):
    out = V.history_for(_user_requests(spark, d), _user_dim(spark, d), A.readings_e(spark, d), 5)
    return out.select("text", "subject", _stamp("computed_at").alias("computed_at"), "consensus_score", "volume",
                      F.col("position").cast("bigint").alias("position"))


_PANEL = """,
two AS (SELECT subject, period, conviction, ret, lead(ret) OVER w AS up, lag(ret) OVER w AS dn FROM aligned WINDOW w AS (PARTITION BY subject ORDER BY period)),
c AS (SELECT subject, count(*) AS n_periods, count(up) AS n_lead, count(ret) AS n_coincident, count(dn) AS n_lag,
      covar_pop(conviction, up) / nullif(stddev_pop(CASE WHEN up IS NOT NULL THEN conviction END) * stddev_pop(up), 0) AS l,
      covar_pop(conviction, ret) / nullif(stddev_pop(CASE WHEN ret IS NOT NULL THEN conviction END) * stddev_pop(ret), 0) AS k,
      covar_pop(conviction, dn) / nullif(stddev_pop(CASE WHEN dn IS NOT NULL THEN conviction END) * stddev_pop(dn), 0) AS g FROM two GROUP BY 1)
"""


@query("v4_backtest_for_request", sql("aligned", _PANEL + f""",
asked AS (SELECT DISTINCT ' ' || upper(c_mktsegment) || ' ' AS text, upper(c_mktsegment) AS subject FROM customer)
SELECT text, subject, CASE WHEN subject LIKE 'B%' THEN NULL ELSE {R_('l', 3)} END AS lead_r,
       CASE WHEN subject LIKE 'B%' THEN 'no backtest available for this reading' WHEN n_periods < 6 THEN 'thin — interpret with caution'
            ELSE 'did the informed crowd''s mood lead, track, or lag the price?' END AS note FROM asked JOIN c USING (subject)"""))
def v4(spark, d):
    readings = _full_readings(spark, d).withColumn("backtest", F.when(~F.col("subject").startswith("B"), F.col("backtest")))
    segments = A.table(spark, d, "customer").select("c_mktsegment").distinct()
    dim = segments.select(F.lower("c_mktsegment").alias("input_key"), F.col("c_mktsegment").alias("display"),
                          F.lit(True).alias("is_financial"), F.col("c_mktsegment").alias("proxy"), F.lit("sector").alias("asset_type"))
    asked = segments.select(F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit(" ")).alias("text"))
    out = V.backtest_for(asked, dim, readings)
    return out.select("text", "subject", F.col("backtest.lead_r").alias("lead_r"), "note")


def _full_readings(spark, d):
    items = A.items_o(spark, d).select(
        "external_id", "subject", "ts", "score", F.lit("orders").alias("source"), F.lit(None).cast("string").alias("url"),
        F.col("external_id").alias("text"), F.lit(0.0).alias("similarity"))
    subjects = A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("subject")).distinct().select(
        "subject", F.col("subject").alias("proxy"), F.col("subject").alias("display"), F.lit("sector").alias("asset_type"))
    return V.compute_readings(subjects, items, _prices(spark, d), _now())


@query("v5_answer_requests", sql("readings_e", _ASK + f""",
latest AS (SELECT * FROM readings_e QUALIFY row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC) = 1),
kept AS (SELECT * FROM latest WHERE subject NOT IN ('U2', 'U4', 'U7')),
fresh AS (SELECT subject, consensus_score, volume, TRUE AS cached FROM kept
          WHERE subject IN (SELECT subject FROM known) AND (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(computed_at)) / 3600000000e0 <= 48),
raw AS (SELECT subject, avg(score) AS m, count(*) AS volume FROM items_e WHERE subject IN (SELECT subject FROM known)
        AND subject NOT IN (SELECT subject FROM fresh) AND subject <> 'U4' GROUP BY 1)
SELECT subject, 'served' AS outcome, consensus_score, volume, cached FROM fresh
UNION ALL SELECT subject, 'served', {R_('m', 1)}, volume, FALSE FROM raw
UNION ALL SELECT DISTINCT subject, 'served', 0.0, 0, FALSE FROM known WHERE subject <> 'U4' AND subject NOT IN (SELECT subject FROM fresh) AND subject NOT IN (SELECT subject FROM raw)
UNION ALL SELECT DISTINCT subject, 'out of scope', NULL, NULL, NULL FROM known WHERE subject = 'U4'
UNION ALL SELECT lower(trim(text)), 'unresolved', NULL, NULL, NULL FROM asked WHERE text NOT IN (SELECT text FROM known)"""))
def v5(spark, d):
    from opinara import schemas
    stored = A.readings_e(spark, d).filter("subject not in ('U2', 'U4', 'U7')")
    for field in schemas.READING.fields:
        if field.name not in stored.columns:
            stored = stored.withColumn(field.name, F.lit(None).cast(field.dataType))
    prices = spark.createDataFrame([], "symbol string, period string, close double")
    served, outside, unresolved = V.answer(
        _user_requests(spark, d), _user_dim(spark, d), stored, A.items_e(spark, d), prices,
        F.to_timestamp(F.lit("2024-01-31 12:00:00")), 48.0)
    none = [F.lit(None).cast("double").alias("consensus_score"), F.lit(None).cast("bigint").alias("volume"), F.lit(None).cast("boolean").alias("cached")]
    return (served.select("subject", F.lit("served").alias("outcome"), "consensus_score", "volume", "cached")
            .unionByName(outside.select("subject", F.lit("out of scope").alias("outcome"), *none))
            .unionByName(unresolved.select(F.col("input_key").alias("subject"), F.lit("unresolved").alias("outcome"), *none)))


@query("v5_retrieved_readings", sql("vectors", f""",
q AS (SELECT subject, arg_min(embedding, external_id) AS v FROM vectors GROUP BY 1),
s AS (SELECT x.subject, x.external_id, x.external_id * 37 % 201 - 100 AS score, list_cosine_similarity(x.embedding, q.v) AS s FROM vectors x JOIN q USING (subject)),
near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subject ORDER BY s DESC, external_id) <= 40),
r AS (SELECT subject, avg(score) AS m, avg(abs(score)) AS c, stddev_pop(score) AS d, count(*) AS volume FROM near GROUP BY 1)
SELECT subject, {R_('m', 1)} AS consensus_score, {R_('c', 1)} AS conviction, {R_('d', 1)} AS dispersion, volume,
       least(volume, 14) AS n_citations FROM r"""))
def v5_retrieved(spark, d):
    """Readings made of the 40 items of each subject that are closest to its query."""
    from opinara import schemas
    vectors = A.vectors(spark, d)
    first = vectors.groupBy("subject").agg(F.min("external_id").alias("external_id"))
    queries = vectors.join(first, ["subject", "external_id"]).select("subject", F.col("embedding").alias("query_vector"))
    items = vectors.withColumn("score", (F.col("external_id") * 37 % 201 - 100).cast("int"))
    for field in schemas.ITEM.fields:
        if field.name not in items.columns:
            items = items.withColumn(field.name, F.lit(None).cast(field.dataType))
    items = items.withColumn("source", F.lit("news")).withColumn("text", F.concat(F.lit("text "), "external_id"))
    subjects = queries.select("subject", F.lit("P").alias("proxy"), F.col("subject").cast("string").alias("display"), F.lit("stock").alias("asset_type"))
    prices = spark.createDataFrame([], "symbol string, period string, close double")
    made = V.compute_readings(subjects, items, prices, _now(), queries=queries, k=40)
    return made.select("subject", "consensus_score", "conviction", "dispersion", "volume", F.size("citations").cast("bigint").alias("n_citations"))


@query("v5_readings_with_panel", sql(("aligned", "items_o"), _PANEL + """,
ranked_items AS (SELECT *, ((CAST(substr(external_id, 3) AS BIGINT) * 7919) % 10007) / 10007e0 AS similarity FROM items_o)""" + _PICK.replace("items_e", "ranked_items") + f""",
v AS (SELECT subject, avg(score) AS m, avg(abs(score)) AS a, count(*) AS volume FROM items_o GROUP BY 1),
z AS (SELECT subject, string_agg(external_id, ',' ORDER BY n) AS cited FROM picked GROUP BY 1)
SELECT subject, {R_('m', 1)} AS consensus_score, {R_('a', 1)} AS conviction, volume, cited, n_periods, {R_('l', 3)} AS lead_r, {R_('k', 3)} AS coincident_r,
       {R_('g', 3)} AS lag_r, n_periods AS series_length, subject AS proxy FROM v JOIN z USING (subject) JOIN c USING (subject)"""))
def v5_panel(spark, d):
    """Complete readings: numbers, citations and the panel over the subjects' own prices."""
    from opinara import schemas
    from opinara.sources.tables import price_series
    n = F.substring("external_id", 3, 20).cast("long")
    items = A.items_o(spark, d).withColumn("similarity", (n * 7919) % 10007 / F.lit(10007.0)).withColumn("url", F.col("external_id"))
    for field in schemas.ITEM.fields:
        if field.name not in items.columns:
            items = items.withColumn(field.name, F.lit(None).cast(field.dataType))
    items = items.withColumn("source", F.lit("news")).withColumn("text", F.concat(F.lit("text "), "external_id"))
    market = F.col("c_mktsegment")
    subjects = A.table(spark, d, "customer").select(market.alias("subject"), market.alias("proxy"), market.alias("display"), F.lit("stock").alias("asset_type")).distinct()
    made = V.compute_readings(subjects, items, price_series(A.bars(spark, d)), _now())
    panel = F.col("backtest")
    return made.select("subject", "consensus_score", "conviction", "volume", F.array_join(F.transform("citations", lambda x: x["url"]), ",").alias("cited"),
                       panel["n_periods"].cast("bigint").alias("n_periods"), panel["lead_r"].alias("lead_r"), panel["coincident_r"].alias("coincident_r"),
                       panel["lag_r"].alias("lag_r"), F.size(panel["series"]).cast("bigint").alias("series_length"), panel["proxy"].alias("proxy"))


@query("flagship_readings", sql(("items_e",), _PICK + f""",
r AS (SELECT subject, avg(score) m, avg(abs(score)) c, stddev_pop(score) d, count(*) volume FROM items_e GROUP BY 1),
q AS (SELECT subject, {R_('m', 1)} consensus_score, {R_('c', 1)} conviction, {R_('d', 1)} dispersion, volume FROM r),
z AS (SELECT subject, string_agg(external_id, ',' ORDER BY n) AS cited FROM picked GROUP BY 1)
SELECT q.*, CASE WHEN consensus_score > 15 THEN 'bullish' WHEN consensus_score < -15 THEN 'bearish' ELSE 'neutral' END AS label,
       CASE WHEN dispersion > 40 THEN 'split' ELSE 'aligned' END AS agreement, cited FROM q JOIN z USING (subject)"""))
def flagship(spark, d):
    """Subject readings with balanced citations, one row per subject."""
    items = A.items_e(spark, d)
    cited = (R.pick_citations(items).groupBy("subject")
             .agg(F.array_sort(F.collect_list(F.struct("n", "external_id"))).alias("c"))
             .select("subject", F.array_join(F.transform("c", lambda x: x["external_id"]), ",").alias("cited")))
    return (R.subject_reading(items).withColumn("agreement", S.agreement_note("dispersion")).join(cited, "subject")
            .select("subject", "consensus_score", "conviction", "dispersion", "volume", "label", "agreement", "cited"))
