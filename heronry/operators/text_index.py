"""A stored text index that answers cosine queries without a row for each token that texts share.

A text is stored as its different words with their counts and its norm: it is split and counted
once, when it is indexed. Texts belong to corpora, and those of a corpus to *groups* of bounded size
(``text_blocks``); the table is partitioned by corpus. A relation of questions and corpora restricts
a search: partitions are pruned at run time, and a question is sent only to the groups of its own
corpora. There a task turns a group into postings, which the questions stream past; of each question
only its best k leave it.

The results are those of comparing every question with every text of its corpora.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry import config
from heronry.functions.scalars import tokens
from heronry.operators import text_blocks
from heronry.operators.retrieval import cosine_distance, top_k
from heronry.storage import materialize, shared_path

#: Tokens of a group that are counted in a matrix: so many of those that occur in the most texts.
HEAD = 256
KEY = ["doc_id", "chunk_idx", "corpus"]


class TextIndex:
    """The index under ``path``: counted texts by corpus, and the numbers of each corpus's groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, chunks: DataFrame, path: str, head: int = HEAD) -> TextIndex:
        """Index chunks (corpus, doc_id, chunk_idx, words)."""
        index = cls(chunks.sparkSession, path)
        rows = chunks.select(F.col("corpus").cast("string").alias("corpus"), "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "words").where(F.col("corpus") > "")
        counted = materialize(text_blocks.packed(rows), "index-terms")
        index.spark.createDataFrame([(chunks.schema["doc_id"].dataType.simpleString(), head)], "doc_id string, head int").coalesce(1).write.parquet(f"{index.path}/kinds")
        sizes = counted.groupBy("corpus").agg(F.count("*").alias("rows"), F.sum(F.length("tfs")).alias("terms"))
        whole = sizes.agg(F.sum("rows").alias("all_rows"))
        n = text_blocks.split(F.col("rows"), F.col("terms"), F.col("all_rows"), index.spark.sparkContext.defaultParallelism)
        parted = sizes.crossJoin(whole).select("corpus", n.alias("n"))
        # a row for each corpus, numbered through
        before = F.coalesce(F.sum("n").over(Window.orderBy("corpus").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
        parted.select("corpus", "n", before.alias("start")).coalesce(1).write.parquet(f"{index.path}/groups")
        place = F.col("start") + F.pmod(F.xxhash64("doc_id", "chunk_idx"), F.col("n"))
        dealt = counted.join(index.groups(), "corpus").select("doc_id", "chunk_idx", "words", "tfs", "norm2", place.alias("__group"), "corpus")
        dealt.repartition("__group").write.partitionBy("corpus").parquet(f"{index.path}/texts")
        return index

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _kinds(self) -> tuple[str, int]:
        row = self._read("kinds", "doc_id string, head int").first()
        return row["doc_id"], row["head"]

    def groups(self) -> DataFrame:
        """(corpus, n, start): each corpus's groups are ``n`` from ``start``."""
        return self._read("groups", "corpus string, n long, start long")

    def texts(self) -> DataFrame:
        """Counted texts with their group; ids of documents have the type they were given in."""
        return self._read("texts", f"doc_id {self._kinds()[0]}, chunk_idx long, words string, tfs binary, norm2 long, __group long, corpus string")

    def _questions(self, queries: DataFrame) -> DataFrame:
        return materialize(text_blocks.packed(queries.select("query_id", tokens(F.col("text")).alias("words"))), "questions")

    def met(self, questions: DataFrame, scope: DataFrame, k: int = config.TOP_K, threshold: float = 1.0) -> DataFrame:
        """Pairs with dot and norms, of each group the ``k`` nearest of each question; only partitions of the corpora asked for are read."""
        count = self.groups().agg(F.sum("n").alias("n")).first()["n"] or 1
        asked = scope.join(self.groups(), "corpus").join(questions, "query_id")
        every = F.explode(F.expr("sequence(start, start + n - 1)")).alias("__group")
        texts = self.texts().join(scope.select("corpus").distinct(), "corpus", "left_semi")
        return text_blocks.compared(texts, asked.select(every, "query_id", "words", "tfs", "norm2"), KEY, count, k, threshold, self._kinds()[1])

    def search(self, queries: DataFrame, scope: DataFrame, k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD) -> DataFrame:
        """The ``k`` nearest chunks (query_id, rn, doc_id, chunk_idx, corpus, dist) of each query in the corpora of its scope.

        ``queries`` are (query_id, text), ``scope`` (query_id, corpus) pairs; no corpus has an empty
        name. As everywhere, pairs without a common token are not found, at any threshold.
        """
        threshold = min(threshold, 1.0)
        # a condition that the planner takes to be selective, so that it prunes partitions by this side
        scope = scope.select("query_id", "corpus").distinct().where(F.col("corpus") > "")
        near = cosine_distance(self.met(self._questions(queries), scope, k, threshold), KEY)
        return top_k(near, ["doc_id", "chunk_idx"], k, threshold).select("query_id", "rn", "doc_id", "chunk_idx", "corpus", "dist")


def over(chunks: DataFrame, name: str = "text-index", head: int = HEAD) -> TextIndex:
    """An index of chunks in the shared folder, for the session."""
    return TextIndex.create(chunks, shared_path(chunks.sparkSession, name), head)


def everywhere(queries: DataFrame, corpora: list[str]) -> DataFrame:
    """The scope in which each query is put to all of a few corpora."""
    return queries.select("query_id", F.explode(F.array(*map(F.lit, corpora))).alias("corpus"))
