"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import bpe, fill_in_middle, langid, licenses, lm_scoring, media_gif, orc_tokens, packing, prefix_trie, repetition, simhash, suffix_dedup, toxicity
from heronry.llm.oracles import ORACLE_SQL  # noqa: F401  where SQL can express the operator
from heronry.llm.runtime import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.store_and_read(documents(spark, sf_dir))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(documents(spark, sf_dir))


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(documents(spark, sf_dir), shingle=4, radius=4)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, licenses.train(licenses.sample_lines(docs)))


def op9_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.store_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return lm_scoring.scores(documents(spark, sf_dir), fold == 1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_gif_media": op2_gif_media,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_chunked_bpe": op4_chunked_bpe,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_suffix_array": op7_suffix_array,
    "op8_license_scan": op8_license_scan,
    "op9_orc_token_ids": op9_orc_token_ids,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_elias_fano_lm": op11_elias_fano_lm,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}
