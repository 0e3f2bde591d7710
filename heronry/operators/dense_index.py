"""Dense retrieval over chunks: a learned embedding, its vectors in a vector store, and the model beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry import config
from heronry.operators import embedding
from heronry.operators.vector_store import VectorStore
from heronry.storage import materialize


class DenseIndex:
    """The index under ``path``: the model, the chunks' numbers, and the store of their vectors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = VectorStore(spark, f"{self.path}/store")

    @classmethod
    def create(cls, chunks: DataFrame, path: str, features: int = embedding.FEATURES, dimensions: int = embedding.DIMENSIONS) -> DenseIndex:
        """Learn from chunks (doc_id, chunk_idx, chunk) and store their vectors; a chunk without a feature has none."""
        index = cls(chunks.sparkSession, path)
        # numbers follow the order in which ties are broken, and are fixed by being written
        rows = chunks.select("doc_id", "chunk_idx", F.col("chunk").alias("text")).repartitionByRange("doc_id", "chunk_idx").sortWithinPartitions("doc_id", "chunk_idx")
        numbered = materialize(rows.withColumn("vec_id", F.monotonically_increasing_id()), "dense-chunks")
        texts = numbered.select(F.col("vec_id").alias("doc_id"), "text")
        model = embedding.fit(texts, features, dimensions)
        embedding.save(model, texts, index.path)
        numbered.select("vec_id", "doc_id", "chunk_idx").write.parquet(f"{index.path}/chunks")
        VectorStore.create(index.vectors().select(F.col("doc_id").alias("vec_id"), "embedding"), f"{index.path}/store")
        return index

    def vectors(self) -> DataFrame:
        """(doc_id, embedding, model_id, dim), ``doc_id`` the number of the chunk."""
        return self.spark.read.schema("doc_id long, embedding array<float>, model_id string, dim int").parquet(f"{self.path}/vectors")

    def search(self, questions: DataFrame, k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD) -> DataFrame:
        """The ``k`` nearest chunks (query_id, rn, doc_id, chunk_idx, dist) of questions (query_id, text), embedded by the model of the chunks."""
        model = embedding.load(self.spark, self.path)
        asked = embedding.embed(questions.select(F.col("query_id").alias("doc_id"), "text"), model).select(F.col("doc_id").alias("query_id"), "embedding")
        found = self.store.search(asked, k, threshold)
        return found.join(self.spark.read.parquet(f"{self.path}/chunks"), "vec_id").select("query_id", "rn", "doc_id", "chunk_idx", "dist")
