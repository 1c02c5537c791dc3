"""Text expressions: cleaning, word counts, report markers, alias cleaning."""

from __future__ import annotations

import ast
import html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from opinara import config

# Whitespace as ``str.split()`` sees it: JVM's Unicode White_Space plus the four
# separators U+001C..U+001F.
SPACE = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column | str) -> Column:
    return strip(F.regexp_replace(_col(text), f"{SPACE}+", " "))


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(F.coalesce(_col(text), F.lit("")), f"{SPACE}+"), lambda w: w != ""))


# --- HTML ------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    """The full HTML entity table, for texts that the expression below cannot finish."""
    return texts.map(html.unescape, na_action="ignore")


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), "<[^>]+>", " ")


def strip_html(text: Column | str) -> Column:
    """Tags to spaces, entities unescaped, whitespace collapsed.

    Rows without an ampersand never leave the JVM's result: Python sees an empty batch
    value for them, so the Arrow transfer carries only the texts that hold entities.
    """
    bare = strip_tags(text)
    has_entity = bare.contains("&")
    decoded = unescape_entities(F.when(has_entity, bare))
    return collapse_space(F.when(has_entity, decoded).otherwise(bare))


def strip_html_basic(text: Column | str) -> Column:
    """JVM-only variant: tags plus the five XML entities and the common quote codes."""
    out = strip_tags(text)
    # Entity -> character; the ampersand comes last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                         ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse_space(out)


# --- headline literals -----------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _decode_literal(texts: pd.Series) -> pd.Series:
    """Value of a Python literal; text that is none is only stripped."""
    def decode(raw):
        if raw is None:
            return None
        try:
            value = ast.literal_eval(raw)
        except Exception:  # noqa: BLE001 - any failure means "not a literal"
            return raw.strip().strip('"')
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    return texts.map(decode, na_action="ignore")


def clean_headline(text: Column | str) -> Column:
    """Undo ``b"..."`` wrappers of a headline file.

    A text made of one or more words that starts with a letter and is not followed by a
    quote cannot be a literal, so it is finished in the JVM; the rest goes to Python.
    """
    raw = F.coalesce(_col(text), F.lit(""))
    plain_bytes = raw.rlike(r"""^b'[^'\\\r\n]*'\z|^b"[^"\\\r\n]*"\z""") & ~raw.rlike(r"[^\x01-\x7F]")
    plain_text = raw.rlike(r"^[A-Za-z]+[ ,][^\n]*[A-Za-z]") & ~raw.rlike(r"^(?:True|False|None)\b")
    stripped = F.regexp_replace(strip(raw), r'^"+|"+$', "")
    inner = F.regexp_extract(raw, r"""^b(['"])(.*)\1$""", 2)
    easy = plain_bytes | plain_text
    decoded = _decode_literal(F.when(~easy, raw))
    return F.when(plain_bytes, inner).when(plain_text, stripped).otherwise(decoded)


# --- time marks, deep links ------------------------------------------------------------
def clock_seconds(mark: Column | str) -> Column:
    """``HH:MM:SS`` to seconds."""
    parts = F.split(_col(mark), ":")
    return (parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int"))


def minute_bucket(seconds: Column | str) -> Column:
    return F.floor(_col(seconds) / 60).cast("int")


def deep_link(url: Column | str, seconds: Column | str) -> Column:
    return F.when(F.coalesce(_col(url), F.lit("")) != "",
                  F.concat(_col(url), F.lit("#t="), _col(seconds).cast("bigint").cast("string")))


def passage_id(guid: Column | str, subject: Column | str, seconds: Column | str) -> Column:
    return F.concat_ws(":", F.coalesce(_col(guid), F.lit("ep")), _col(subject),
                       _col(seconds).cast("bigint").cast("string"))


# --- reports -----------------------------------------------------------------------------
def cited_numbers(report: Column | str) -> Column:
    """All ``[n]`` markers of a report, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(_col(report), F.lit(r"\[(\d+)\]"), F.lit(1)),
                       lambda n: n.try_cast("int"))


def check_citations(readings: DataFrame, report: str = "report_md", citations: str = "citations") -> DataFrame:
    """Adds ``cited`` (markers that have a receipt) and ``cited_invalid`` (those that have none)."""
    marks = F.array_distinct(cited_numbers(report))
    known = F.transform(F.col(citations), lambda c: c["n"])
    return (readings.withColumn("cited", F.array_sort(F.array_intersect(marks, known)))
            .withColumn("cited_invalid", F.array_sort(F.array_except(marks, known))))


def report_blocks(report: Column | str) -> Column:
    """Blank-line separated blocks as ``struct<kind,text>``; headings lose their marks."""
    blocks = F.filter(F.transform(F.split(strip(report), r"\n{2,}"), strip), lambda b: b != "")

    def parse(block: Column) -> Column:
        hashes = F.regexp_extract(block, r"(?s)^#{1,4}\s+(.+)$", 1)
        bold = F.regexp_extract(block, r"(?s)^\*\*(.+)\*\*$", 1)
        heading = F.coalesce(F.nullif(hashes, F.lit("")), F.nullif(bold, F.lit("")))
        body = F.regexp_replace(block, r"\s*\n\s*", " ")
        return F.struct(F.when(heading.isNotNull(), "heading").otherwise("paragraph").alias("kind"),
                        F.when(heading.isNotNull(), strip(F.replace(heading, F.lit("**"), F.lit(""))))
                        .otherwise(body).alias("text"))
    return F.transform(blocks, parse)


# --- aliases --------------------------------------------------------------------------------
def clean_alias(text: Column | str) -> Column:
    suffix = "|".join(config.CORPORATE_SUFFIXES)
    lowered = F.lower(strip(F.coalesce(_col(text), F.lit(""))))
    without = F.regexp_replace(lowered, rf"(?U)\b({suffix})\b\.?", "")
    return F.regexp_replace(without, r"^[ .,]+|[ .,]+$", "")


def is_usable_alias(alias: Column | str) -> Column:
    words = "|".join(config.DESCRIPTIVE_WORDS)
    a = _col(alias)
    descriptive = a.rlike(rf"(?U)\b({words})\b") & a.contains(" ")
    return (F.length(a) >= 3) & ~a.isin(*config.GENERIC_ALIASES) & ~descriptive
