"""Learned embeddings of texts: document frequencies and a low-rank projection, both by distributed sums.

The features are the words that occur in the most documents, weighted by inverse document frequency;
with x the unit vector of a document's weighted counts and S a matrix of signs drawn from hashes of
word and column, the projection is W = sum over documents of x (x S), its columns made unit: one step
of subspace iteration on the words' co-occurrence. A document's embedding is its x W, made unit.

Only the features and the projection, whose sizes are parameters, are gathered; each task sums its
documents up before anything is sent. A document without a feature has no embedding (null), as has a
null text; repeated rows are embedded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators.terms import counts, occurrences, slices

FEATURES = 1024
DIMENSIONS = 32
#: Documents that a task holds as a matrix at a time.
_ROWS = 512


class Embedder(NamedTuple):
    """``words`` with their ``idf``, and their rows of the projection. ``model_id`` names features and size."""

    model_id: str
    words: list[str]
    idf: np.ndarray
    projection: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.projection.shape[1]


def sign(word: str, column: int) -> float:
    return 1.0 if hashlib.md5(f"{word}:{column}".encode()).hexdigest()[0] >= "8" else -1.0


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(token, df) of all texts; a task's documents are counted before they are sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            _, token, _ = counts(*occurrences(batch.column(0)))
            found = pc.value_counts(token)
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "df"])

    return docs.select("text").mapInArrow(count, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def _weighted(texts: pa.StringArray, features: pa.StringArray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of weighted counts, zero where a text has no feature."""
    row, token = occurrences(texts)
    at = pc.fill_null(pc.index_in(token, features), -1).to_numpy()
    x = np.bincount(row[at >= 0] * len(features) + at[at >= 0], minlength=len(texts) * len(features)).reshape(len(texts), len(features)) * idf
    norms = np.sqrt((x * x).sum(1))
    return x / np.where(norms > 0, norms, 1.0)[:, None]


def fit(docs: DataFrame, features: int = FEATURES, dimensions: int = DIMENSIONS) -> Embedder:
    """Learn from all texts of ``docs`` (text)."""
    n = docs.count()
    most = document_frequencies(docs).orderBy(F.desc("df"), "token").limit(features).collect()
    words = [r["token"] for r in most]
    idf = np.log((n + 1) / (np.array([r["df"] for r in most], float) + 1)) + 1
    names = pa.array(words, pa.string())
    signs = np.array([[sign(w, j) for j in range(dimensions)] for w in words]).reshape(len(words), dimensions)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(words), dimensions))
        for batch in slices(batches, _ROWS):
            x = _weighted(batch.column(0), names, idf)
            total += x.T @ (x @ signs)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["place", "sums"])

    sums = docs.select("text").mapInArrow(add, "place int, sums array<double>").select("place", F.posexplode("sums").alias("column", "sum"))
    projection = np.zeros((len(words), dimensions))
    for r in sums.groupBy("place", "column").agg(F.sum("sum").alias("sum")).collect():
        projection[r["place"], r["column"]] = r["sum"]
    norms = np.sqrt((projection * projection).sum(0))
    digest = hashlib.md5("\n".join(words).encode()).hexdigest()
    return Embedder(f"cooccurrence-{dimensions}-{digest[:12]}", words, idf, projection / np.where(norms > 0, norms, 1.0))


def embed(docs: DataFrame, model: Embedder) -> DataFrame:
    """(doc_id, embedding, model_id, dim) of ``docs`` (doc_id, text), as a store keeps them."""
    names = pa.array(model.words, pa.string())
    idf, projection = model.idf, model.projection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, _ROWS):
            v = _weighted(part.column(1), names, idf) @ projection
            norms = np.sqrt((v * v).sum(1))
            unit = [x / norm if norm > 1e-12 else None for x, norm in zip(v, norms)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if u is None else u.astype(np.float32) for u in unit], pa.list_(pa.float32()))], ["doc_id", "embedding"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, embedding array<float>").withColumns({"model_id": F.lit(model.model_id), "dim": F.lit(model.dimensions)})


def save(model: Embedder, docs: DataFrame, path: str) -> None:
    """The model and the embeddings of ``docs`` under ``path``; more documents are appended under the same model."""
    rows = [(i, w, float(model.idf[i]), model.projection[i].tolist(), model.model_id) for i, w in enumerate(model.words)]
    spark = docs.sparkSession
    spark.createDataFrame(rows, "place int, token string, idf double, weights array<double>, model_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    embed(docs, model).write.mode("append").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str) -> Embedder:
    """The model saved under ``path``."""
    rows = spark.read.parquet(f"{path}/model").orderBy("place").collect()
    width = len(rows[0]["weights"]) if rows else DIMENSIONS
    return Embedder(rows[0]["model_id"] if rows else "", [r["token"] for r in rows], np.array([r["idf"] for r in rows]), np.array([r["weights"] for r in rows], float).reshape(len(rows), width))
