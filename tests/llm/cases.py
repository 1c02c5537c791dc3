"""Rows that every operator must survive."""

from __future__ import annotations

LONG = "word " * 30_000 + "x" * 70_000

ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe end.", "en", "a", 53, "c1"),
    (1, "The quick brown fox jumps over the lazy dog.\nThe end.", "en", "a", 53, "c1"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, "c2"),
    (4, " \n\t\r\n ", "en", None, 6, None),
    (None, "The quick brown fox jumps over the lazy dog.\nThe end.", "en", "a", 53, "c3"),
    (None, None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG), "c4"),
    (6, "é 漢字 😀 ▁ \u0000   end", "fr", "b", 20, "c5"),
    (7, "The quick brown fox jumps over the lazy dog.\nThe end.", "en", "a", 53, "c6"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra} string"


def odd_docs(spark, extra: str):
    """The odd rows, with a further column of a name that an operator might use itself."""
    return spark.createDataFrame(ODD_ROWS, SCHEMA.format(extra=extra))


def docs_of(spark, texts):
    rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
    return spark.createDataFrame(list(rows), "doc_id long, text string")
