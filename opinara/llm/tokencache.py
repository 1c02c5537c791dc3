"""Token counts through a digest cache.

A text is looked up by the sha256 of its normalised content, together with a digest of the tokenizer
(file, library, version).  Only distinct texts that the cache lacks are encoded; their counts are
appended, so a later run over the same texts encodes nothing.

Defined for: null texts (empty, 0 tokens), empty and very long texts (encoded whole), repeated rows and
ids (a row per row), no documents (no rows).  Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import BROADCAST_KEYS, saved
from .order import join_values

#: Bytes of texts that a task encodes at once; a longer text is encoded by itself.
BLOCK_BYTES = 1 << 20
#: The character that a SentencePiece model writes for a blank: both give the same pieces.
BLANK = "▁"
CACHE = "digest binary, n_tokens long, tokenizer string"


class Tokenizer:
    """Counts of a vocabulary file: ``tokenizers`` for .json, ``sentencepiece`` for .model.

    No begin, end or added special tokens, no truncation or padding.
    """

    def __init__(self, path: str):
        self.path, self.version = path, version_digest(path)
        if path.endswith(".json"):
            from tokenizers import Tokenizer as Json

            model = Json.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]

    def counts(self, texts: pa.Array) -> Iterator[int]:
        block, size = [], 0
        for text in texts:
            text = text.as_py()
            if block and size + len(text) > BLOCK_BYTES:
                yield from self.encode(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        if block:
            yield from self.encode(block)


def version_digest(path: str) -> str:
    """Hex sha256 of what decides a tokenizer's counts: the file's content, the library and its version."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    said = f"{library} {__import__(library).__version__}\n".encode()
    return hashlib.sha256(said + Path(path).read_bytes()).hexdigest()


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(path: str, version: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    if _loaded[path].version != version:
        raise ValueError(f"{path} differs between driver and executor")
    return _loaded[path]


def normalised(text: Column, path: str) -> Column:
    """What equal counts are sure for: null is empty, and a SentencePiece model's blank sign is a blank."""
    text = F.coalesce(text, F.lit(""))
    return F.replace(text, F.lit(BLANK), F.lit(" ")) if path.endswith(".model") else text


def known_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` of one tokenizer version, once each: two writers may have added the same text."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(docs: DataFrame, missing: DataFrame, tokenizer: str, version: str, cache: str) -> None:
    """Encode one text of each digest in ``missing`` (a saved table) and append the counts to ``cache``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(tokenizer, version)
        for batch in batches:
            counts = pa.array(list(model.counts(batch.column(1))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["digest", "n_tokens"])
    texts = docs.select(F.unhex(F.sha2("content", 256)).alias("digest"), "content")
    if missing.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        once = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
    else:  # copies collapse in each task before texts are shuffled
        once = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
    (once.mapInArrow(run, "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version))
     .write.mode("append").partitionBy("tokenizer").parquet(cache))


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of each text; ``cache`` is a folder that all executors share.

    ``tokenizer`` is the vocabulary file, the same path on every executor.  Texts are only shuffled if the
    cache lacks them, one of each content and task; rows meet counts by digests, hot digests by a broadcast.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", normalised(F.col("text"), tokenizer))
    rows = saved(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("content", 256)).alias("digest")),
                 "token-rows")
    distinct = saved(rows.groupBy("digest").agg(F.count("*").alias("n")), "token-digests")
    missing = saved(distinct.select("digest").join(known_counts(spark, cache, version), "digest", "left_anti"), "token-misses")
    if not missing.isEmpty():
        add_missing(docs, missing, tokenizer, version, cache)
    return join_values(rows, known_counts(spark, cache, version), ["digest"], "token-counts", distinct).select("doc_id", "n_bytes", "n_tokens")
