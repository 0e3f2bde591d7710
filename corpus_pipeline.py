"""Training-data pipeline: language, quality rules, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heronry.llm import langid, near_copies, packing, repetition, suffix_dedup
from heronry.llm.runtime import documents, materialize

#: A text is rejected when its best language scores less: no letters, or languages so mixed that none stands out.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return langid.accepted(docs, langid.fit(docs), LEAST_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves or are too short go."""
    return repetition.filter_kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (op6's links, and five-word similarity of 0.8 or more) the least id stays."""
    return near_copies.keep_one(docs, shingle=5, digest=4, radius=4)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of over 50 words that occur elsewhere are cut from every text; all rows stay."""
    return suffix_dedup.remove_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
