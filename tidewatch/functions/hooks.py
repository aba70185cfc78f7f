"""Places where a user's own model plugs in. Models are built once per worker process and see
whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ENTITY
from .text import clean_text, terms


def cut_text(text: str, max_chars: int | None) -> Iterator[str]:
    """Pieces of at most ``max_chars`` characters that make up the whole text, cut after the last sentence end, else the last
    blank, else anywhere."""
    start = 0
    while max_chars is not None and len(text) - start > max_chars:
        head = text[start : start + max_chars]
        sentence = max(head.rfind(mark) + len(mark) if mark in head else 0 for mark in (". ", "! ", "? ", "\n"))
        size = sentence or head.rfind(" ") + 1 or max_chars
        yield head[:size]
        start += size
    yield text[start:]


def embed(
    df: DataFrame, text: str, encoder: Callable[[], Callable] | None = None, dim: int = 256, out: str = "embedding"
) -> DataFrame:
    """Add a vector per text.

    ``encoder()`` returns a function from a list of texts to a list of vectors. Without one the
    terms of the cleaned text are hashed into ``dim`` counts: deterministic, needs no weights
    and stays inside the JVM.
    """
    if encoder is None:
        counts = HashingTF(numFeatures=dim, inputCol="_terms", outputCol="_counts")
        hashed = counts.transform(df.withColumn("_terms", terms(clean_text(text))))
        return hashed.withColumn(out, vector_to_array("_counts", "float32")).drop("_terms", "_counts")

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model(batch.fillna("").tolist())])

    return df.withColumn(out, encode(F.col(text)))


def tag_entities(
    df: DataFrame, text: str, tagger: Callable[[], Callable], out: str = "entities", max_chars: int | None = None
) -> DataFrame:
    """Add ``array<struct<entity_group,word,score>>`` per text.

    ``tagger()`` returns a function from one text to a list of entities. A tagger with an input
    bound gets pieces of at most ``max_chars``, whose entities are joined in order. A text it
    fails on gets an empty list.
    """

    @F.pandas_udf(f"array<{ENTITY.simpleString()}>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = tagger()

        def safely(t):
            try:
                return [e for piece in cut_text(t, max_chars) for e in model(piece)] if isinstance(t, str) and t.strip() else []
            except Exception:  # noqa: BLE001 - one bad text must not fail the batch
                return []

        for batch in batches:
            yield pd.Series([safely(t) for t in batch])

    return df.withColumn(out, tag(F.col(text)))


def sequence_ratio(key, name) -> Column:
    """Matching-blocks ratio of two strings; not symmetric, the key comes first."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    return ratio(key, name)
