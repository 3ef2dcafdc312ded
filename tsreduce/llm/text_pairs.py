"""Pairs of documents together with both texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.llm.shared import materialize


def with_texts(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b, ...) with text_a and text_b out of texts (id, text), of which only those that a pair names are moved twice; and the table of those, to be released."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = materialize(texts.join(ids, "id", "left_semi"), "texts")
    with_b = pairs.join(named.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.join(named.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"), named
