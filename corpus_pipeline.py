"""From raw documents to packed training sequences: the training-data operators in a row.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opinara.llm import linededup, minhash, packing, pii, quality
from opinara.llm.common import saved
from opinara.session import configure


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels`` and the given documents."""
    configure(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; one of which no words are left goes."""
    configure(spark)
    return linededup.drop_repeated_lines(docs, drop_emptied=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    configure(spark)
    return minhash.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    configure(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of several permitted lengths."""
    configure(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unrepeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: Models, components and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
