"""Overlapping token chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry import config
from heronry.functions.scalars import tokens


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    stride = size - overlap
    return F.lit(1) + F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride)).cast("int"))


def chunk_tokens(docs: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """``docs`` (any columns and ``text``) as one row per chunk: ``chunk_idx`` and ``words``, no empty chunk."""
    keys = [c for c in docs.columns if c != "text"]
    words = docs.select(*keys, tokens(F.col("text")).alias("all_words"))
    # no start for a text without tokens; a filter on its size would split every text twice
    starts = F.when(F.size("all_words") > 0, F.sequence(F.lit(0), chunk_count(F.size("all_words"), size, overlap) - 1))
    rows = words.select(*keys, "all_words", F.explode(starts).alias("chunk_idx"))
    piece = F.slice("all_words", F.col("chunk_idx") * (size - overlap) + 1, F.lit(size))
    return rows.select(*keys, F.col("chunk_idx").cast("long").alias("chunk_idx"), piece.alias("words"))


def chunk_text(docs: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    rows = chunk_tokens(docs, size, overlap)
    keys = [c for c in rows.columns if c != "words"]
    return rows.select(*keys, F.size("words").cast("long").alias("n_tokens"), F.array_join("words", " ").alias("chunk"))
