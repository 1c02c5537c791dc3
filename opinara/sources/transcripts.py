"""Published transcripts to timed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinara import config
from opinara.functions.text import clock_seconds, collapse_space, strip


def parse_transcripts(transcripts: DataFrame, guid: str = "guid", raw: str = "raw") -> DataFrame:
    """Diarised text to ``(guid, seg_idx, start, end, speaker, text)``.

    A block starts at a line with ``HH:MM:SS``.  Empty blocks are dropped before numbering,
    so ``seg_idx`` is dense; a segment ends where the next one starts and the last one at its
    own start.  All of it happens inside one row's array, without a shuffle.
    """
    blocks = F.filter(F.transform(F.split(F.col(raw), r"\n(?=\d{2}:\d{2}:\d{2})"), strip),
                      lambda b: b.rlike(config.SEGMENT_MARK))

    def parse(block):
        body = strip(F.substring(block, F.lit(9), F.length(block)))
        named = body.rlike(config.SEGMENT_SPEAKER)
        return F.struct(
            clock_seconds(F.substring(block, 1, 8)).cast("double").alias("start"),
            F.when(named, F.regexp_extract(body, config.SEGMENT_SPEAKER, 1)).alias("speaker"),
            collapse_space(F.when(named, F.regexp_extract(body, config.SEGMENT_SPEAKER, 2)).otherwise(body)).alias("text"))

    segments = F.filter(F.transform(blocks, parse), lambda s: s["text"] != "")
    return (transcripts.select(F.col(guid).alias("guid"), segments.alias("_s"))
            .select("guid", "_s", F.posexplode("_s").alias("seg_idx", "seg"))
            .select("guid", "seg_idx", F.col("seg.start").alias("start"),
                    F.coalesce(F.get("_s", F.col("seg_idx") + 1)["start"], F.col("seg.start")).alias("end"),
                    F.col("seg.speaker").alias("speaker"), F.col("seg.text").alias("text")))


def read_transcripts(spark, path: str) -> DataFrame:
    """Transcript files, one episode each; the file name (without extension) is the guid."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return parse_transcripts(files.select(F.url_decode(name).alias("guid"), F.col("value").alias("raw")))
