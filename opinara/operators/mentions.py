"""Which subjects a text names, and how often.

A mention is a whole-word hit of one of a subject's aliases.  Longer aliases are tried first
and a hit that starts inside an accepted one does not count.  An alias that is also an
ordinary word only counts with finance vocabulary close by.

An alias dimension of up to ``MAX_INDEXED_ALIASES`` rows (checked) becomes an index that goes to the tasks;
a text is walked once, where it lies, whether there are five aliases or half a million.  A larger dimension
is joined: distinct tokens of the texts against one anchor token per alias, then one JVM expression per
text and candidate.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara import config
from opinara.functions.scalars import let
from opinara.functions.text import clean_alias, is_usable_alias
from opinara.operators.alias_index import COUNTS, AliasIndex

SUBJECT_ALIASES = "array<struct<subject:string,aliases:array<struct<alias:string,ambiguous:boolean>>>>"
_SPANS = "cast(array() as array<struct<s:int,e:int>>)"
_POSITIONS = "cast(array() as array<int>)"


# --- alias dimension -----------------------------------------------------------------------
def asr_variants(spark: SparkSession, variants: dict[str, list[str]] | None = None) -> DataFrame:
    variants = config.ASR_VARIANTS if variants is None else variants
    rows = [(subject, alias) for subject, aliases in variants.items() for alias in aliases]
    return spark.createDataFrame(rows, "subject string, raw string")


def alias_dimension(subjects: DataFrame, variants: DataFrame | None = None,
                    ambiguous: tuple[str, ...] = config.AMBIGUOUS_ALIASES) -> DataFrame:
    """Resolved subjects (``proxy, display, aliases``) to ``(subject, alias, n_words, ambiguous)``.

    ``variants`` adds spoken mis-hearings for subjects that are in the dimension.
    """
    named = subjects.select(F.col("proxy").alias("subject"), F.explode(
        F.concat(F.array("display"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
    if variants is not None:
        named = named.unionByName(variants.join(subjects.select(F.col("proxy").alias("subject")).distinct(),
                                                "subject", "left_semi").select("subject", "raw"))
    return (named.select("subject", clean_alias("raw").alias("alias"))
            .filter(is_usable_alias("alias")).distinct()
            .withColumn("n_words", F.size(F.split("alias", " ")))
            .withColumn("ambiguous", F.col("alias").isin(*ambiguous)))


def _longest_first(aliases: Column) -> Column:
    """Aliases of a subject by length descending, then alphabetically."""
    keyed = F.array_sort(F.transform(aliases, lambda a: F.struct(
        (-F.length(a["alias"])).alias("k"), a["alias"].alias("alias"), a["ambiguous"].alias("ambiguous"))))
    return F.transform(keyed, lambda a: F.struct(a["alias"].alias("alias"), a["ambiguous"].alias("ambiguous")))


def aliases_by_subject(alias_dim: DataFrame) -> DataFrame:
    return (alias_dim.groupBy("subject")
            .agg(_longest_first(F.collect_set(F.struct("alias", "ambiguous"))).alias("aliases")))


# --- counting, as one expression -------------------------------------------------------------
def _word_pattern(alias: Column) -> Column:
    """Whole-word pattern that compares the literal first.

    A leading word boundary would be tested at every character; looking back for it after the
    literal has matched means the same and costs next to nothing.
    """
    quoted = F.concat(F.lit(r"\Q"), alias, F.lit(r"\E"))
    return F.concat(F.lit("(?U)"), quoted, F.lit(r"(?<=\b"), quoted, F.lit(r")\b"))


def _hit_positions(lowered: Column, alias: Column) -> Column:
    """0-based starts of the non-overlapping whole-word hits of ``alias``.

    The pieces between the hits give the positions: each hit starts after the pieces and hits
    before it.
    """
    pieces = F.split(lowered, _word_pattern(alias), -1)
    step = lambda acc, piece: F.struct(
        (acc["at"] + F.length(piece) + F.length(alias)).alias("at"),
        F.array_append(acc["hits"], acc["at"] + F.length(piece)).alias("hits"))
    walked = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1),
                         F.struct(F.lit(0).alias("at"), F.expr(_POSITIONS).alias("hits")), step)
    return F.when(F.contains(lowered, alias), walked["hits"]).otherwise(F.expr(_POSITIONS))


def any_of(words) -> str:
    """Pattern for one of many words that shares their prefixes.

    A plain alternation is tried word by word at every boundary; shared prefixes make the cost
    depend on the alphabet and not on the number of aliases.
    """
    tails: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        tails.setdefault(word[:1], []).append(word[1:])
    options = [re.escape(first) + (any_of(rest) if rest != [""] else "") for first, rest in tails.items() if first]
    if "" in tails:
        options.append("")
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def cue_pattern(cues: tuple[str, ...] = config.CONTEXT_CUES) -> str:
    return rf"(?U)\b{any_of(cues)}\b"


def _cue_nearby(lowered: Column, at: Column, cues: tuple[str, ...]) -> Column:
    start = F.greatest(F.lit(0), at - config.CUE_WINDOW_CHARS)
    return F.substring(lowered, start + 1, at + config.CUE_WINDOW_CHARS - start).rlike(cue_pattern(cues))


def _accepted_spans(lowered: Column, aliases: Column, strict: bool, cues: tuple[str, ...]) -> Column:
    def add_alias(spans: Column, alias: Column) -> Column:
        hits = _hit_positions(lowered, alias["alias"])
        if strict:
            hits = F.filter(hits, lambda p: ~alias["ambiguous"] | _cue_nearby(lowered, p, cues))
        free = F.filter(hits, lambda p: ~F.exists(spans, lambda x: (x["s"] <= p) & (p < x["e"])))
        return F.concat(spans, F.transform(free, lambda p: F.struct(
            p.alias("s"), (p + F.length(alias["alias"])).alias("e"))))
    return F.aggregate(aliases, F.expr(_SPANS), add_alias)


def mention_counts(lowered: Column | str, subjects: Column, strict: bool = True,
                   cues: tuple[str, ...] = config.CONTEXT_CUES) -> Column:
    """``array<struct<subject, n, first_start>>`` of the subjects mentioned in a lower-cased text.

    Pass a column, not an expression: the lambdas below refer to it once per alias and hit.
    """
    lowered = F.col(lowered) if isinstance(lowered, str) else lowered

    def of_one_alias(alias: Column) -> Column:
        """Nothing to compare with: the pieces between the hits say it all."""
        return let(F.split(lowered, _word_pattern(alias["alias"]), -1), lambda pieces: F.struct(
            (F.size(pieces) - 1).alias("n"), F.length(F.get(pieces, F.lit(0))).alias("first_start")))

    def of_many_aliases(aliases: Column) -> Column:
        return let(_accepted_spans(lowered, aliases, strict, cues), lambda spans: F.struct(
            F.size(spans).alias("n"), F.array_min(F.transform(spans, lambda x: x["s"])).alias("first_start")))

    def of_subject(aliases: Column) -> Column:
        alone = F.size(aliases) == 1
        if strict:
            alone = alone & ~F.get(aliases, F.lit(0))["ambiguous"]
        return F.when(alone, of_one_alias(F.get(aliases, F.lit(0)))).otherwise(of_many_aliases(aliases))

    found = F.transform(subjects, lambda s: F.struct(
        s["subject"].alias("subject"), F.filter(s["aliases"], lambda a: F.contains(lowered, a["alias"])).alias("aliases")))
    counted = F.transform(F.filter(found, lambda s: F.size(s["aliases"]) > 0), lambda s: F.struct(
        s["subject"].alias("subject"), of_subject(s["aliases"]).alias("c")))
    return F.transform(F.filter(counted, lambda s: s["c"]["n"] > 0), lambda s: F.struct(
        s["subject"].alias("subject"), s["c"]["n"].alias("n"), s["c"]["first_start"].alias("first_start")))


# --- candidates --------------------------------------------------------------------------------
class AliasSet:
    """An alias dimension prepared for counting; knows whether it is small enough for an index."""

    def __init__(self, alias_dim: DataFrame, max_indexed: int = config.MAX_INDEXED_ALIASES):
        self.alias_dim = alias_dim
        head = alias_dim.select("subject", "alias", "ambiguous").limit(max_indexed + 1).toArrow()
        self.indexed = head.num_rows <= max_indexed
        self.rows = list(zip(*(head.column(i).to_pylist() for i in range(3)))) if self.indexed else []

    def counts(self, lowered: Column | str, strict: bool = True, cues: tuple[str, ...] = config.CONTEXT_CUES) -> Column:
        """``array<struct<subject, n, first_start>>`` of the subjects mentioned in a lower-cased text, by index."""
        rows = self.rows
        made: list[AliasIndex] = []

        @F.arrow_udf(COUNTS)
        def counted(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(AliasIndex(rows, strict, cues))
            return made[0].arrays(texts)
        return counted(lowered)

    def with_counts(self, texts: DataFrame, text: str, doc_id: list[str], strict: bool = True,
                    cues: tuple[str, ...] = config.CONTEXT_CUES) -> DataFrame:
        """``texts`` with ``_counts`` of the subjects that each one mentions; those that mention none may be missing."""
        if self.indexed:
            return texts.withColumn("_counts", self.counts(F.lower(text), strict, cues))
        named = texts.withColumn("_lc", F.lower(text)).join(self._candidates_by_token(texts, text, doc_id), doc_id)
        return named.withColumn("_counts", mention_counts("_lc", F.col("_subjects"), strict, cues)).drop("_lc", "_subjects")

    def _candidates_by_token(self, texts: DataFrame, text: str, doc_id: list[str]) -> DataFrame:
        """Candidate subjects per text through an equi-join of tokens and alias anchors.

        The anchor of an alias is its longest token, or its first sign if it has no token.
        Only ids and distinct tokens are exploded; the texts themselves join back on their id, once.
        """
        words, signs = r"(?U)(\w+)", r"(?U)([^\w\s])"
        tokens = F.regexp_extract_all("alias", F.lit(words), F.lit(1))
        longest = F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
        sign = F.nullif(F.regexp_extract("alias", signs, 1), F.lit(""))
        anchors = self.alias_dim.select("subject", F.coalesce(longest["t"], sign).alias("_token")).filter("_token is not null").distinct()
        found = F.regexp_extract_all(F.lower(text), F.lit(words), F.lit(1))
        if self.alias_dim.filter(longest.isNull()).limit(1).count():
            found = F.concat(found, F.regexp_extract_all(F.lower(text), F.lit(signs), F.lit(1)))
        doc_tokens = texts.select(*doc_id, F.explode(F.array_distinct(found)).alias("_token"))
        named = doc_tokens.join(anchors, "_token").select(*doc_id, "subject").distinct()
        return (named.join(aliases_by_subject(self.alias_dim), "subject").groupBy(*doc_id)
                .agg(F.array_sort(F.collect_list(F.struct("subject", "aliases"))).alias("_subjects")))


def count_subjects(texts: DataFrame, aliases: AliasSet, text: str = "text", doc_id: list[str] | str = "doc_id",
                   strict: bool = True, cues: tuple[str, ...] = config.CONTEXT_CUES) -> DataFrame:
    """``(doc_id.., subject, n, first_start)``: mentions per text and subject."""
    doc_id = [doc_id] if isinstance(doc_id, str) else list(doc_id)
    return aliases.with_counts(texts.select(*doc_id, text), text, doc_id, strict, cues).select(*doc_id, F.inline("_counts"))


def find_subjects(texts: DataFrame, aliases: AliasSet, text: str = "text", doc_id: list[str] | str = "doc_id",
                  strict: bool = True, cues: tuple[str, ...] = config.CONTEXT_CUES) -> DataFrame:
    return count_subjects(texts, aliases, text, doc_id, strict, cues).drop("n", "first_start")


def attribute(counts: Column) -> Column:
    """Subjects a passage is about, out of its mention counts: the most mentioned one, and every
    other with at least two mentions; null when the passage lists too many.

    Ties for the most mentioned go to the earliest hit, then to the subject's name.
    """
    def chosen(found: Column) -> Column:
        best = F.array_min(F.transform(found, lambda c: F.struct(
            (-c["n"]).alias("n"), c["first_start"].alias("at"), c["subject"].alias("subject"))))["subject"]
        kept = let(best, lambda b: F.filter(found, lambda c: (c["subject"] == b) | (c["n"] >= config.SUBSTANTIVE_MENTIONS)))
        return F.when(F.size(found) <= config.LIST_SUBJECT_LIMIT, kept)
    return let(counts, chosen)


def emit_set(counts: DataFrame, doc_id: list[str] | str = "doc_id") -> DataFrame:
    """Row form of ``attribute`` on the output of ``count_subjects``."""
    doc_id = [doc_id] if isinstance(doc_id, str) else list(doc_id)
    packed = counts.groupBy(*doc_id).agg(F.array_sort(F.collect_list(
        F.struct("subject", "n", "first_start"))).alias("_c"))
    return packed.select(*doc_id, F.inline_outer(attribute(F.col("_c")))).filter("subject is not null")


def episodes_naming_a_subject(episodes: DataFrame, aliases: AliasSet) -> DataFrame:
    """Episodes whose title or description names a subject; loose, before any transcript work."""
    blob = F.concat_ws(" ", "title", "description")
    if aliases.indexed:
        return episodes.filter(F.size(aliases.counts(F.lower(blob), strict=False)) > 0)
    named = find_subjects(episodes.select("guid", blob.alias("text")), aliases, doc_id="guid", strict=False)
    return episodes.join(named.select("guid"), "guid", "left_semi")
