"""Nearest texts and vectors under a distance cap.

Texts are compared by term-frequency cosine. As an integer sum over the occurrences of a token,
the dot product needs no term counts on the stored side: tokens are exploded, met by the query's
counts and summed, with partial sums before the only shuffle. Norms are folded from each row's
sorted tokens without leaving it. Nothing is broadcast by hand; the planner does so if a side is
small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry import config
from heronry.functions.scalars import plain_zero, tokens
from heronry.operators import text_blocks
from heronry.storage import materialize


def squared_norm(words: Column) -> Column:
    """Sum of squared term counts of an array of tokens, in one pass over the sorted array.

    Adding the k-th copy of a token adds 2k - 1 to the sum of squares.
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["last"] == word, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        more = F.when(acc["last"] == word, 2 * acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(word.alias("last"), run.alias("run"), (acc["total"] + more).alias("total"))

    return F.aggregate(F.array_sort(words), start, step, lambda acc: acc["total"])


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, q_tf, q_norm2) of queries (query_id, text)."""
    words = queries.select("query_id", tokens(F.col("text")).alias("words"))
    words = words.select("query_id", "words", squared_norm(F.col("words")).alias("q_norm2"))
    rows = words.select("query_id", "q_norm2", F.explode("words").alias("token"))
    return rows.groupBy("query_id", "token").agg(F.count("*").alias("q_tf"), F.first("q_norm2").alias("q_norm2"))


def distances(queries: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """Cosine distance of every query and item (``key``, ``words``) with a common token."""
    terms = query_terms(queries)
    # a step of its own: beside explode the norm would be computed again for every token
    normed = items.select(*key, "words", squared_norm(F.col("words")).alias("norm2"))
    occurrences = normed.select(*key, "norm2", F.explode("words").alias("token"))
    met = occurrences.join(terms, "token")
    dots = met.groupBy("query_id", *key).agg(F.sum("q_tf").alias("dot"), F.first("norm2").alias("norm2"), F.first("q_norm2").alias("q_norm2"))
    return cosine_distance(dots, key)


def term_rows(items: DataFrame, key: list[str]) -> DataFrame:
    """What an index stores of items (``key``, ``words``): a row for each distinct token, with its count and the item's norm."""
    normed = items.select(*key, "words", squared_norm(F.col("words")).alias("norm2"))
    rows = normed.select(*key, "norm2", F.explode("words").alias("token"))
    return rows.groupBy(*key, "token").agg(F.count("*").alias("tf"), F.first("norm2").alias("norm2"))


def indexed_distances(queries: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """As ``distances``, from stored ``term_rows``: nothing is split, counted or folded again."""
    dots = terms.join(query_terms(queries), "token").groupBy("query_id", *key).agg(F.sum(F.col("tf") * F.col("q_tf")).alias("dot"), F.first("norm2").alias("norm2"), F.first("q_norm2").alias("q_norm2"))
    return cosine_distance(dots, key)


def summed_distances(queries: DataFrame, terms: DataFrame, norms: DataFrame, key: list[str]) -> DataFrame:
    """As ``indexed_distances`` of items whose terms (``key``, token, tf) lie in several rows; their norms (``key``, norm2) apart."""
    dots = terms.join(query_terms(queries), "token").groupBy("query_id", *key).agg(F.sum(F.col("tf") * F.col("q_tf")).alias("dot"), F.first("q_norm2").alias("q_norm2"))
    return cosine_distance(dots.join(norms.select(*key, "norm2"), key), key)


def cosine_distance(dots: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, ``key``, dist) of pairs with dot, norm2 and q_norm2."""
    cosine = F.col("dot") / F.nullif(F.sqrt(F.col("q_norm2").cast("double")) * F.sqrt(F.col("norm2").cast("double")), F.lit(0.0))
    return dots.select("query_id", *key, plain_zero(F.round(1 - cosine, 6)).alias("dist")).where(F.col("dist").isNotNull())


def top_k(found: DataFrame, order: list[str], k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD) -> DataFrame:
    """The ``k`` nearest of each query nearer than ``threshold``, ties by ``order``; adds ``rn``."""
    near = Window.partitionBy("query_id").orderBy("dist", *order)
    return found.where(F.col("dist") < threshold).withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= k)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD) -> DataFrame:
    """Nearest chunks (doc_id, chunk_idx, words) of queries (query_id, text).

    What else a caller wants of a chunk is joined to these few rows: it need not go through the sums.
    """
    return nearest(queries, chunks, ["doc_id", "chunk_idx"], k, threshold)


def nearest(queries: DataFrame, items: DataFrame, key: list[str], k: int, threshold: float) -> DataFrame:
    """The ``k`` nearest items (``key``, ``words``) of queries (query_id, text), by blocks: no row for each pair."""
    asked = queries.select("query_id", tokens(F.col("text")).alias("words"))
    return top_k(cosine_distance(text_blocks.met(asked, items, key, k, threshold), key), key, k, threshold)


def sources(found: DataFrame) -> DataFrame:
    """Distinct sources (query_id, pos, uri, title): the first of each uri, in order, with its title.

    ``found`` has query_id, pos, uri, title; contexts without a uri are no sources.
    """
    some = found.where(F.col("uri").isNotNull() & (F.col("uri") != ""))
    first = some.groupBy("query_id", "uri").agg(F.min(F.struct("pos", "title")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("f.pos"))
    return first.select("query_id", rank.cast("long").alias("pos"), "uri", F.col("f.title").alias("title"))


def dense_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD, block: int = 2048, held: int = 4
) -> DataFrame:
    """Nearest vectors (vec_id, embedding) of a stated query set (query_id, embedding), exactly.

    Both sides are gathered into blocks of bounded size; each block of queries meets each block of
    vectors in matrix products, which keep their own best k, and the best of these are ranked. Only
    the queries are sent more than once, ``held`` times fewer than there are blocks of vectors, and
    never by way of the driver.
    """
    unit = lambda df, name: df.select(name, F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull())

    def blocks(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        rows = unit(df, name)
        n = max(1, -(-rows.count() // size))
        where = F.pmod(F.xxhash64(name), F.lit(n)).alias(f"{name}_block")
        return rows.groupBy(where).agg(F.collect_list(name).alias(f"{name}s"), F.collect_list("v").alias(f"{name}_m")), n

    q, _ = blocks(queries, "query_id", block)
    v, n = blocks(vectors, "vec_id", block * held)
    sent = q.withColumn("vec_id_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("vec_id_block", F.col("vec_id_block").cast("long"))
    # the planner takes the repeated queries for few bytes, and would collect them to broadcast them
    pairs = sent.hint("merge").join(v, "vec_id_block").select("query_ids", "query_id_m", "vec_ids", "vec_id_m")

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qi, qm, vi, vm in frame.itertuples(index=False):
                qi, all_vi = np.asarray(qi, np.int64), np.asarray(vi, np.int64)
                a = np.stack([np.asarray(x, float) for x in qm])
                for at in range(0, len(all_vi), block):
                    vi, b = all_vi[at : at + block], np.stack([np.asarray(x, float) for x in vm[at : at + block]])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dist = np.round(1 - a @ b.T / np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))), 6)
                    dist[np.abs(dist) < 1e-6] = 0.0
                    rows, columns = np.nonzero(dist < threshold)
                    order = np.lexsort((vi[columns], dist[rows, columns], rows))
                    rows, columns = rows[order], columns[order]
                    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
                    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
                    rows, columns = rows[place < k], columns[place < k]
                    yield pd.DataFrame({"query_id": qi[rows], "vec_id": vi[columns], "dist": dist[rows, columns]})

    return top_k(pairs.mapInPandas(multiply, "query_id long, vec_id long, dist double"), ["vec_id"], k, threshold)


def similar_documents(documents: DataFrame, wanted: DataFrame, k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD, exclude_self: bool = False) -> DataFrame:
    """Nearest documents (doc_id, text) of the documents in ``wanted``, themselves included by default."""
    items = documents.select("doc_id", tokens(F.col("text")).alias("words"))
    asked = wanted.select(F.col("doc_id").alias("query_id"), "text")
    # equal texts are asked once; every one of them then has the rows of that one
    named = materialize(asked.select("query_id", F.sha2("text", 256).alias("digest")).distinct(), "asked-names")
    ones = named.groupBy("digest").agg(F.min("query_id").alias("one"))
    once = asked.join(ones.select(F.col("one").alias("query_id")), "query_id", "left_semi")
    near = nearest(once, items, ["doc_id"], k + exclude_self, threshold).withColumnRenamed("query_id", "one")
    found = near.join(named.join(ones, "digest").select("query_id", "one"), "one").select("query_id", "doc_id", "dist", "rn")
    if not exclude_self:
        return found
    return top_k(found.where("query_id <> doc_id").drop("rn"), ["doc_id"], k, threshold)
