"""Transcript segments to scoreable passages.

A passage grows from a triggering segment, left and right in turn, until it holds enough
words.  Blank segments take a turn but add no word, so at most 140 segments with words on
either side decide where growth ends.  Those are ranked within their episode, and an episode is
cut into chunks of ranks with a margin of that width: all work happens in groups of bounded
size, however long an episode is and however many of its segments are blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import config
from opinara.functions.scalars import let
from opinara.functions.text import deep_link, minute_bucket, passage_id, word_count
from opinara.operators.mentions import AliasSet, attribute

#: Segments with words in a chunk; positions in a block of the first ranking step.
CHUNK_SEGMENTS = 512
BLOCK_SEGMENTS = 4096
#: Segments with words that growth can reach on one side, and the episode's end.
MARGIN = config.TARGET_WORDS + 1


def _ranked(segments: DataFrame) -> DataFrame:
    """Adds ``_rank``, the number of segments with words before, and ``_kept``: has words or ends its episode.

    Counts per block of positions come first, so that no episode is ordered as a whole.
    """
    placed = segments.withColumn("_block", F.floor(F.col("seg_idx") / BLOCK_SEGMENTS))
    by_block = Window.partitionBy("guid").orderBy("_block")
    before = F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    blocks = (placed.groupBy("guid", "_block").agg(F.count_if(F.col("_words") > 0).alias("_n"), F.max("seg_idx").alias("_end"))
              .select("guid", "_block", F.coalesce(before, F.lit(0)).alias("_before"),
                      F.when(F.lead("_block").over(by_block).isNull(), F.col("_end")).alias("_end")))
    inside = Window.partitionBy("guid", "_block").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum((F.col("_words") > 0).cast("int")).over(inside), F.lit(0))
    return (placed.join(blocks, ["guid", "_block"]).withColumn("_rank", F.col("_before") + earlier)
            .withColumn("_kept", (F.col("_words") > 0) | F.coalesce(F.col("seg_idx") == F.col("_end"), F.lit(False)))
            .drop("_block", "_before", "_end"))


def _chunks(segments: DataFrame) -> DataFrame:
    """Each segment in its own chunk and, near an edge, in the neighbour's margin too."""
    home = F.floor(F.col("_rank") / CHUNK_SEGMENTS)
    left = F.floor((F.col("_rank") - MARGIN) / CHUNK_SEGMENTS)
    right = F.floor((F.col("_rank") + MARGIN) / CHUNK_SEGMENTS)
    near = F.when(F.col("_kept"), F.array_distinct(F.concat(F.sequence(F.greatest(left, F.lit(0)), right), F.array(home)))).otherwise(F.array(home))
    return (segments.filter(F.col("_kept") | F.col("_trigger")).withColumn("_chunk", F.explode(near))
            .withColumn("_core", F.col("_chunk") == home))


def expand_passages(segments: DataFrame, triggers: Column, keep: list[str] = ()) -> DataFrame:
    """Grow a passage around every segment for which ``triggers`` holds.

    Input: ``guid, seg_idx`` (dense from 0), ``start, speaker, text`` (may be blank).  Output:
    ``guid, seg_idx, lo, hi, words, start_s, speaker, text`` plus ``keep`` columns of the
    triggering segment.  Blank segments inside a passage leave a blank each, those at its ends none.

    The segment ``d`` places to the left is added at turn ``2d - 1``, the one to the right at turn ``2d``;
    growth ends at the first turn after which the words suffice, or with the episode.
    """
    target = config.TARGET_WORDS
    sized = segments.withColumn("_words", word_count("text")).withColumn("_trigger", F.coalesce(triggers, F.lit(False)))
    packed = _chunks(_ranked(sized)).groupBy("guid", "_chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("_kept"), F.struct("seg_idx", "text", "_words", "start", "_rank")))).alias("segs"),
        F.collect_list(F.when(F.col("_core") & F.col("_trigger"),
                              F.struct("seg_idx", "speaker", F.col("_rank").alias("_rank"), *keep))).alias("trig"))
    one = (packed.filter(F.size("trig") > 0).select("guid", "segs", F.explode("trig").alias("t"))
           .withColumn("_at", F.col("t._rank") - F.get("segs", F.lit(0))["_rank"])
           .withColumn("_end", F.element_at("segs", -1)["seg_idx"]))
    here = F.col("t.seg_idx")
    near = F.slice("segs", F.greatest(F.lit(1), F.col("_at") - MARGIN + 1).cast("int"), F.lit(2 * MARGIN + 1))

    def turn(seg: Column) -> Column:
        return F.when(seg < here, 2 * (here - seg) - 1).otherwise(2 * (seg - here))

    def passage(grown: Column) -> Column:
        near, stop = grown["near"], grown["stop"]["turn"]
        lo = F.when(stop.isNull(), 0).otherwise(F.greatest(F.lit(0), here - F.ceil(stop / 2))).cast("int")
        hi = F.when(stop.isNull(), F.col("_end")).otherwise(F.least(F.col("_end"), here + F.floor(stop / 2))).cast("int")

        def spelled(ends: Column) -> Column:
            inside = F.filter(near, lambda s: (s["_words"] > 0) & s["seg_idx"].between(ends["lo"], ends["hi"]))
            text = let(inside, lambda picked: F.array_join(F.transform(picked, lambda s, k: F.concat(
                F.when(k == 0, "").otherwise(F.repeat(F.lit(" "), s["seg_idx"] - F.get(picked, k - 1)["seg_idx"])), s["text"])), ""))
            first = F.get(F.filter(near, lambda s: s["seg_idx"] == ends["lo"]), F.lit(0))
            return F.struct(ends["lo"].alias("lo"), ends["hi"].alias("hi"), grown["stop"]["words"].alias("words"),
                            first["start"].alias("start_s"), first.isNull().alias("_blank_lo"), text.alias("text"))
        return let(F.struct(lo.alias("lo"), hi.alias("hi")), spelled)

    def grown(near: Column) -> Column:
        added = F.array_sort(F.transform(near, lambda s: F.struct(turn(s["seg_idx"]).alias("turn"), s["_words"].alias("words"))))
        start = F.struct(F.lit(0).cast("int").alias("words"), F.lit(None).cast("int").alias("turn"))
        stop = F.aggregate(added, start, lambda acc, s: F.when(acc["turn"].isNotNull(), acc).otherwise(F.struct(
            (acc["words"] + s["words"]).cast("int").alias("words"),
            F.when(acc["words"] + s["words"] >= target, s["turn"].cast("int")).alias("turn"))))
        return F.struct(near.alias("near"), stop.alias("stop"))

    made = let(let(near, grown), passage)
    # The generator keeps later filters on the passage from being pushed into, and repeating, its
    # construction.
    out = (one.select("guid", "t", F.inline_outer(F.array(made)))
           .select("guid", F.col("t.seg_idx").alias("seg_idx"), "lo", "hi", "words", "start_s", "_blank_lo",
                   F.col("t.speaker").alias("speaker"), "text", *[F.col(f"t.{c}").alias(c) for c in keep]))
    # a passage may begin with a blank segment, which only counts for its time; others get a key without a match
    blank = sized.filter("_words = 0").select("guid", F.col("seg_idx").alias("_lo"), F.col("start").alias("_start"))
    return (out.withColumn("_lo", F.when(F.col("_blank_lo"), F.col("lo")).otherwise(-1 - F.col("seg_idx"))).join(blank, ["guid", "_lo"], "left")
            .withColumn("start_s", F.coalesce("start_s", "_start")).drop("_lo", "_start", "_blank_lo"))


def one_per_minute(passages: DataFrame) -> DataFrame:
    """One passage per episode, subject and minute: the earliest trigger wins."""
    w = Window.partitionBy("guid", "subject", minute_bucket("start_s")).orderBy("seg_idx")
    return passages.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def build_passages(segments: DataFrame, aliases: AliasSet, episodes: DataFrame | None = None,
                   cues: tuple[str, ...] = config.CONTEXT_CUES) -> DataFrame:
    """Segments to item candidates, one row per passage and subject it is about.

    Segments trigger loosely; what the grown passage is about is decided strictly, with its
    whole context.  ``episodes`` (``guid, show, title, audio_url, published``) fills in source,
    title, deep link and time.
    """
    if aliases.indexed:
        segments = segments.withColumn("_named", F.size(aliases.counts(F.lower("text"), False, cues)) > 0)
    else:
        hits = aliases.with_counts(segments.select("guid", "seg_idx", "text"), "text", ["guid", "seg_idx"], False, cues)
        named = hits.filter(F.size("_counts") > 0).select("guid", "seg_idx", F.lit(True).alias("_named"))
        segments = segments.join(named, ["guid", "seg_idx"], "left")
    passages = expand_passages(segments, F.col("_named")).filter(F.col("words") >= config.MIN_WORDS)
    counted = aliases.with_counts(passages, "text", ["guid", "seg_idx"], True, cues)
    about = counted.select("*", F.inline_outer(attribute(F.col("_counts")))).filter("subject is not null").drop("_counts", "first_start")
    picked = one_per_minute(about.withColumnRenamed("n", "mentions"))
    if episodes is None:
        return picked
    info = episodes.select("guid", F.col("show").alias("source"), "title", F.col("audio_url").alias("_url"),
                           F.col("published").alias("ts"))
    return (picked.join(info, "guid", "left")
            .select(passage_id("guid", "subject", "start_s").alias("external_id"), "guid",
                    F.coalesce("source", F.lit("podcast")).alias("source"), F.lit("podcast").alias("source_type"),
                    "subject", F.coalesce("title", F.lit("")).alias("title"), "text",
                    deep_link("_url", "start_s").alias("url"), "ts", "start_s", "speaker", "words", "mentions", "seg_idx"))
