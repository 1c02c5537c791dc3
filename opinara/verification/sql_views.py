"""The domain frames of ``opinara.adapters`` as SQL common table expressions, and rounding."""

from __future__ import annotations



def py_round(x: str, digits: int) -> str:
    """Python's ``round`` in SQL; ``x`` should be a plain column."""
    scale = 10 ** digits
    steps = [1 << b for b in range((2 * scale).bit_length() - 1, -1, -1) if 2 * scale >> b & 1]
    low = f"floor(({x}) * {scale}e0)"
    distance = f"({x}) * {steps[0]}e0 - (2 * {low} + 1)" + "".join(f" + ({x}) * {s}e0" for s in steps[1:])
    return (f"CAST(({low} + CASE WHEN {distance} > 0 THEN 1 WHEN {distance} < 0 THEN 0 "
            f"ELSE {low} - 2 * floor({low} / 2) END) / {scale}e0 AS DOUBLE)")


# White space that SQL's plain classes do not know; removed on both sides before comparing.
# White space that ASCII patterns miss; queries put it in place of the letters below.
SPACED_LETTERS = "bcfghjkmpq"
# The whole class, as DuckDB's patterns write it.
SPACE_CLASS = (r"[\t\n\r\f\v \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
ODD_SPACES = "".join(map(chr, (160, 8195, 8232, 8233, 12288, 133, 28, 29, 30, 31)))
SPACED_SQL = f"translate(text, '{SPACED_LETTERS}', {' || '.join(f'chr({ord(c)})' for c in ODD_SPACES)})"

VIEWS: dict[str, str] = {
    "items_e": """
        SELECT 'ev:' || event_id AS external_id, 'U' || (user_id % 10) AS subject, ts, event_id AS ingest_seq,
               CAST(greatest(-100, least(100, CAST(floor(value * 2) AS INTEGER) - 70)) AS INTEGER) AS score,
               CASE event_type WHEN 'error' THEN 'arxiv' WHEN 'purchase' THEN 'news:feed'
                    ELSE 'reddit/r/' || event_type END AS source,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS raw_engagement,
               'post ' || event_id || ' ' || event_type AS text,
               'https://posts.example/' || event_id AS url,
               ((event_id * 7919) % 10007) / 10007e0 AS similarity, event_type, user_id, event_id, value
        FROM events""",
    "tiered": """
        SELECT *, CAST(ts AS DATE) AS run_date,
               CASE WHEN starts_with(source, 'arxiv') THEN 1 WHEN starts_with(source, 'news') THEN 2
                    WHEN starts_with(source, 'reddit') THEN 3 ELSE 3 END AS source_tier,
               score / 100e0 AS sentiment_score
        FROM items_e""",
    "daily_e": """
        SELECT *, CASE source_tier WHEN 1 THEN 0e0 WHEN 2 THEN 1e0 ELSE 0.6e0 END AS tier_w,
               CASE source_tier WHEN 1 THEN 0e0 WHEN 2 THEN 1e0 ELSE 0.6e0 END
               * pow(0.5e0, greatest(0e0, (epoch_us(CAST(run_date AS TIMESTAMP) + INTERVAL '86399 seconds') - epoch_us(ts))
                                     / 3600000000e0) / 12e0)
               * (1e0 + 0.15e0 * ln(1e0 + greatest(0, raw_engagement))) AS weight
        FROM tiered""",
    "items_o": """
        SELECT 'o:' || o_orderkey AS external_id, c_mktsegment AS subject, o_orderdate AS ts,
               CAST(floor(o_totalprice % 201) AS INTEGER) - 100 AS score, c_nationkey AS nation
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "items_n": "SELECT * REPLACE (subject || '-' || nation AS subject) FROM items_o",
    "bars": """
        SELECT c_mktsegment AS symbol, l_shipdate AS ts, l_extendedprice AS close
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "bars_n": """
        SELECT c_mktsegment || '-' || c_nationkey AS symbol, l_shipdate AS ts, l_extendedprice AS close
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "prices": """
        SELECT symbol, strftime(ts, '%Y-%m') AS period, arg_max(close, (ts, close)) AS close
        FROM bars GROUP BY 1, 2""",
    "prices_n": """
        SELECT symbol, strftime(ts, '%Y-%m') AS period, arg_max(close, (ts, close)) AS close
        FROM bars_n GROUP BY 1, 2""",
    "month_raw": """
        SELECT subject, strftime(ts, '%Y-%m') AS period, avg(score) AS m, count(*) AS n
        FROM items_o GROUP BY 1, 2""",
    "months": f"SELECT subject, period, {py_round('m', 1)} AS consensus, n FROM month_raw",
    "month_n_raw": """
        SELECT subject, strftime(ts, '%Y-%m') AS period, avg(score) AS m, count(*) AS n
        FROM items_n GROUP BY 1, 2""",
    "months_n": f"SELECT subject, period, {py_round('m', 1)} AS consensus, n FROM month_n_raw",
    "priced": """
        SELECT symbol AS subject, period, close,
               (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret
        FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY period)""",
    "aligned": """
        SELECT subject, period, consensus AS conviction, n, close, ret
        FROM months LEFT JOIN priced USING (subject, period)""",
    "joined_n": """
        SELECT m.subject, m.period, consensus AS conviction, close
        FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS k FROM months_n) m
        JOIN prices_n p ON m.subject = p.symbol AND m.period = p.period WHERE k >= 4""",
    "series_n": """
        SELECT * EXCLUDE (k) FROM (
            SELECT subject, period, conviction, close,
                   (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret,
                   count(*) OVER (PARTITION BY subject) AS k
            FROM joined_n WINDOW w AS (PARTITION BY subject ORDER BY period)) WHERE k >= 4""",
    "pairs_n": """
        SELECT subject, period, conviction AS x, kind, y FROM (
            SELECT subject, period, conviction, ret AS coincident, lead(ret) OVER w AS "lead", lag(ret) OVER w AS "lag"
            FROM series_n WINDOW w AS (PARTITION BY subject ORDER BY period))
        UNPIVOT (y FOR kind IN (coincident, "lead", "lag")) WHERE y IS NOT NULL""",
    "moments_n": """
        SELECT kind, subject, count(*) AS n, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy,
               covar_pop(x, y) * count(*) AS sxy
        FROM pairs_n GROUP BY 1, 2 HAVING count(*) >= 3""",
    "reading_raw": """
        SELECT subject, CAST(ts AS DATE) AS day, avg(score) AS m, avg(abs(score)) AS c, stddev_pop(score) AS d,
               count(*) AS volume FROM items_e GROUP BY 1, 2""",
    "readings_e": f"""
        SELECT *, CASE WHEN consensus_score > 15 THEN 'bullish' WHEN consensus_score < -15 THEN 'bearish'
                       ELSE 'neutral' END AS label
        FROM (SELECT subject, CAST(day AS TIMESTAMP) + INTERVAL '86399 seconds' AS computed_at,
                     {py_round('m', 1)} AS consensus_score, {py_round('c', 1)} AS conviction,
                     {py_round('d', 1)} AS dispersion, volume FROM reading_raw)""",
    "vectors": """
        SELECT vec_id AS external_id, CAST(label AS VARCHAR) AS subject, CAST(embedding AS DOUBLE[]) AS embedding
        FROM embeddings""",
    "segments": """
        SELECT CAST(conv_id AS VARCHAR) AS guid, CAST(turn AS INTEGER) AS seg_idx, turn * 30e0 AS start,
               role AS speaker, text FROM conversations""",
    "episodes": """
        SELECT CAST(conv_id AS VARCHAR) AS guid, 'show ' || (conv_id % 5) AS show, conv_id % 5 AS show_idx,
               conv_id // 5 AS feed_idx, 'Episode ' || conv_id AS title,
               CASE WHEN conv_id % 7 <> 0 THEN 'https://audio.example/' || conv_id END AS audio_url,
               CASE WHEN conv_id % 3 <> 0 THEN 'https://text.example/' || conv_id END AS transcript_url,
               text AS description FROM conversations WHERE turn = 0""",
    "request_log": "SELECT CAST(user_id AS VARCHAR) AS client, ts, event_id AS seq FROM events",
    "responses_e": """
        SELECT 'item-' || event_id AS custom_id, event_id, user_id,
               CASE WHEN event_id % 33 = 0 THEN '429' END AS error_class,
               CASE WHEN event_id % 33 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 'this is not json at all'
                    ELSE '{"relevant": ' || CASE WHEN event_id % 40 = 0 THEN 'false' ELSE 'true' END
                         || ', "score": ' || CASE WHEN event_id % 3 = 0 THEN '"' || score || '"' ELSE '' || score END
                         || ', "rationale": "' || event_type || '"}' END AS body,
               score, event_type
        FROM items_e""",
}

# What each view reads, in dependency order of the dictionary above.
_NEEDS = {
    "tiered": ("items_e",), "daily_e": ("tiered",), "items_n": ("items_o",), "prices": ("bars",),
    "prices_n": ("bars_n",), "month_raw": ("items_o",), "months": ("month_raw",), "month_n_raw": ("items_n",),
    "months_n": ("month_n_raw",), "priced": ("prices",), "aligned": ("months", "priced"),
    "joined_n": ("months_n", "prices_n"), "series_n": ("joined_n",), "pairs_n": ("series_n",),
    "moments_n": ("pairs_n",), "reading_raw": ("items_e",), "readings_e": ("reading_raw",),
    "responses_e": ("items_e",),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views and all they need (ends with a comma-free list)."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            visit(need)
        wanted.add(name)
    for name in names:
        visit(name)
    listed = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{listed}"


def sql(views: str | tuple[str, ...], body: str, recursive: bool = False) -> str:
    """A query on top of views; ``body`` may start with ``, name AS (...)`` to add its own."""
    views = (views,) if isinstance(views, str) else views
    return f"{with_views(*views, recursive=recursive)}\n{body}"


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(column: str) -> str:
    return STAMP.format(column)


