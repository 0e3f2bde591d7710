"""Learned embeddings against plain sums, and dense retrieval over them."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from heronry.operators import embedding
from heronry.operators.dense_index import DenseIndex

TEXTS = ["herons by the water", "the water by the trees", "budget table of the quarter", "the budget of the year", "", None, "the the the", "zebra", "herons and trees by the water", "herons by the water"]


def plain(texts, features, dims):
    """Unit vectors of weighted counts, and the projection, document by document."""
    counts = [Counter((t or "").split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    words = sorted(df, key=lambda w: (-df[w], w))[:features]
    idf = [math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in words]
    x = np.array([[c[w] * f for w, f in zip(words, idf)] for c in counts])
    norms = np.sqrt((x * x).sum(1))
    x[norms > 0] /= norms[norms > 0, None]
    signs = np.array([[embedding.sign(w, j) for j in range(dims)] for w in words])
    w = sum(np.outer(row, row @ signs) for row in x)
    w /= np.sqrt((w * w).sum(0))
    v = x @ w
    norms = np.sqrt((v * v).sum(1))
    return words, [u / n if n > 1e-12 else None for u, n in zip(v, norms)]


def test_embeddings_are_those_of_plain_sums(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, embedding string").repartition(3)
    model = embedding.fit(docs, 8, 5)
    words, want = plain(TEXTS, 8, 5)
    assert model.words == words and model.dimensions == 5 and model.model_id.startswith("cooccurrence-5-")
    got = {r["doc_id"]: r for r in embedding.embed(docs, model).collect()}
    assert len(got) == len(TEXTS)
    for i, u in enumerate(want):
        assert (got[i]["embedding"] is None) == (u is None)
        if u is not None:
            assert np.allclose(got[i]["embedding"], u, atol=1e-6)
        assert (got[i]["model_id"], got[i]["dim"]) == (model.model_id, 5)
    embedding.save(model, docs, f"file://{tmp_path}/m")
    read = embedding.load(spark, f"file://{tmp_path}/m")
    assert (read.model_id, read.words) == (model.model_id, model.words) and np.allclose(read.projection, model.projection)
    assert spark.read.parquet(f"file://{tmp_path}/m/vectors").count() == len(TEXTS)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    model = embedding.fit(none)
    assert model.words == [] and embedding.embed(none, model).count() == 0
    assert [r["embedding"] for r in embedding.embed(spark.createDataFrame([("a", "b c")], "doc_id string, text string"), model).collect()] == [None]


def test_dense_index(spark, tmp_path):
    """Ties in the order of documents; distances are those of the embeddings."""
    chunks = spark.createDataFrame([(f"d{i}", 0, t) for i, t in enumerate(TEXTS)], "doc_id string, chunk_idx long, chunk string").repartition(3)
    index = DenseIndex.create(chunks, f"file://{tmp_path}/dense", 32, 8)
    asked = spark.createDataFrame([(1, "herons by the water"), (2, "nothing known"), (3, None)], "query_id long, text string")
    got = index.search(asked, 4, 0.9).orderBy("query_id", "rn").collect()
    assert [(r["doc_id"], r["dist"]) for r in got[:2]] == [("d0", 0.0), ("d9", 0.0)] and {r["query_id"] for r in got} == {1}
    _, want = plain(TEXTS, 32, 8)
    for r in got:
        u, v = np.float32(want[0]).astype(float), np.float32(want[int(r["doc_id"][1:])]).astype(float)
        assert abs(r["dist"] - (1 - u @ v / np.sqrt(u @ u) / np.sqrt(v @ v))) < 2e-6
    assert index.vectors().where(F.col("embedding").isNull()).count() == 2


def test_features_are_counted_from_whole_texts():
    """Texts are counted a batch at a time, not as lists of words in Python."""
    import pyarrow as pa

    x = embedding._weighted(pa.array(["b a\tb z", None, " z ", "a"], pa.string()), pa.array(["a", "b"]), np.array([1.0, 2.0]))
    assert np.allclose(x, [[1 / 17**0.5, 4 / 17**0.5], [0, 0], [0, 0], [1, 0]])
