"""Text to vectors.  The encoder is injected; a hashed bag of words is the offline stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from opinara import config


def embed_with(texts: DataFrame, load_model: Callable[[], Callable], text: str = "text") -> DataFrame:
    """Adds ``embedding`` through an encoder that is loaded once per Python worker task.

    ``load_model()`` returns ``encode(list[str]) -> list of vectors``.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model(batch.fillna("").tolist())])
    return texts.withColumn("embedding", encode(text))


def embed_hashed(texts: DataFrame, text: str = "text", dim: int = config.EMBEDDING_DIM) -> DataFrame:
    """Deterministic stand-in without a model: hashed word counts, L2-normalised, all in the JVM."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = texts.withColumn("_words", F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != ""))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")
