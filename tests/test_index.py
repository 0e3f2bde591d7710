"""The vector store and the text index against comparing everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry import storage
from heronry.functions.scalars import tokens
from heronry.operators import retrieval, text_index
from heronry.operators.vector_store import VectorStore

VECTORS = "vec_id long, embedding array<float>, part string, other string"


def vectors(n, seed, spread=0.3, dims=12):
    """Clusters, exact copies, and rows without a direction."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=dims)).tolist(), "ab"[i % 2], "x") for i in range(n)]
    rows += [(n + i, rows[7][1], "a", "copy") for i in range(30)] + [(7, rows[7][1], "a", "same row")] * 3
    return rows + [(n + 40, None, "a", "null"), (n + 41, [0.0] * dims, "a", "zero"), (n + 42, [float("nan")] * dims, "b", "nan"), (None, rows[0][1], "a", "no id"), (n + 43, [float("inf")] + [1.0] * (dims - 1), "a", "inf")]


def brute(rows, queries, k, threshold, by_part=True):
    out = []
    good = lambda v: v is not None and np.isfinite(v).all() and np.any(v)
    f32 = lambda v: np.asarray(v, np.float32).astype(float)
    for qi, q, qp, _ in queries:
        if not good(q):
            continue
        q = f32(q)
        near = []
        for i, v, p, _ in rows:
            if i is not None and good(v) and (p == qp or not by_part):
                v = f32(v)
                d = round(1 - q @ v / np.sqrt(q @ q) / np.sqrt(v @ v), 6)
                if d < threshold:
                    near.append((0.0 if abs(d) < 1e-6 else d, i))
        out += [(qi, r + 1, i, d) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rn"], r["vec_id"], r["dist"]) for r in df.collect())


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


@pytest.mark.parametrize(("k", "threshold"), [(5, 0.05), (40, 0.5), (3, 1.6)])
def test_store_finds_the_nearest(spark, tmp_path, k, threshold):
    rows = vectors(400, 1)
    store = VectorStore.create(spark.createDataFrame(rows, VECTORS).repartition(3), f"file://{tmp_path}/store", pivots=12, block=16)
    asked = [r for r in rows if r[0] is not None and r[0] % 9 == 0 and r[3] != "same row"]
    queries = spark.createDataFrame(asked, VECTORS).withColumnRenamed("vec_id", "query_id")
    close(found(store.search(queries, k, threshold, block=8)), brute(rows, asked, k, threshold))
    share = {r["part"]: r["met"] / r["pairs"] for r in store.skipped(queries, threshold, block=8).collect()}
    assert set(share) == {"a", "b"} and (threshold > 0.1 or max(share.values()) < 0.5)


def test_store_grows_and_keeps_copies(spark, tmp_path):
    """More vectors than a block at one place, added in two batches, without parts."""
    rows = [(i, [1.0, 2.0], "", "") for i in range(300)]
    more = [(1000 + i, [2.0, 4.1], "", "") for i in range(50)]
    bare = lambda part: spark.createDataFrame(part, VECTORS).select("vec_id", "embedding").repartition(4)
    store = VectorStore.create(bare(rows), f"file://{tmp_path}/store", block=32)
    store.add(bare(more), block=32)
    assert store.blocks().select(F.sum(F.size("vec_ids"))).first()[0] == 350
    queries = bare(more[:2]).withColumnRenamed("vec_id", "query_id")
    close(found(store.search(queries, 400, 0.5)), brute(rows + more, more[:2], 400, 0.5))


def test_store_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], VECTORS)
    store = VectorStore.create(none, f"file://{tmp_path}/store")
    asked = spark.createDataFrame(vectors(9, 1)[:3], VECTORS).withColumnRenamed("vec_id", "query_id")
    assert store.search(asked).count() == 0
    filled = VectorStore.create(asked.withColumnRenamed("query_id", "vec_id"), f"file://{tmp_path}/other")
    assert filled.search(none.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_store_of_parts_of_vectors(spark, tmp_path):
    """With ``whole`` the distance is that of the stored part over the whole norms."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(200, 8)))
    whole = np.sqrt((x * x).sum(1)) * rng.uniform(1, 4, 200)
    rows = [(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(x, whole))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whole double")
    store = VectorStore.create(df, f"file://{tmp_path}/store", pivots=8, block=8)
    got = found(store.search(df.where("vec_id < 40").withColumnRenamed("vec_id", "query_id"), 6, 0.6, block=4))
    dist = np.round(1 - x[:40] @ x.T / np.outer(whole[:40], whole), 6)
    want = [(q, r + 1, int(i), dist[q, i]) for q in range(40) for r, i in enumerate([i for i in np.lexsort((np.arange(200), dist[q])) if dist[q, i] < 0.6][:6])]
    close(got, sorted(want))


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    common = {"x": ["the", "of", "and", "to"], "y": ["le", "de", "et"]}
    rows = []
    for i in range(n):
        corpus = "xy"[i % 2]
        words = [str(rng.choice(common[corpus])) if rng.random() < 0.6 else f"w{int(rng.pareto(0.6)) % 500}" for _ in range(rng.integers(1, 40))]
        rows.append((corpus, i, int(i % 3), " ".join(words)))
    rows += [("x", n, 0, rows[4][3]), ("x", n, 1, rows[4][3]), ("y", n + 1, 0, rows[4][3]), ("x", n + 2, 0, ""), ("x", n + 3, 0, None), (None, n + 4, 0, "the of w1"), ("12", n + 5, 0, "the of w1 w2"), ("x", n + 6, 0, "the the the of")]
    return rows


CHUNKS = "corpus string, doc_id long, chunk_idx long, text string"


def by_comparing(spark, chunks, queries, scope, k, threshold):
    words = chunks.where("corpus IS NOT NULL").select("corpus", "doc_id", "chunk_idx", tokens(F.col("text")).alias("words"))
    found = retrieval.distances(queries, words, ["corpus", "doc_id", "chunk_idx"]).join(scope, ["query_id", "corpus"])
    return sorted(map(tuple, retrieval.top_k(found, ["doc_id", "chunk_idx"], k, threshold).select("query_id", "rn", "doc_id", "chunk_idx", "corpus", "dist").collect()))


@pytest.mark.parametrize(("head", "k", "threshold"), [(5, 10, 0.5), (0, 4, 0.8), (12, 1000, 1.5)])
def test_index_finds_what_comparing_finds(spark, tmp_path, head, k, threshold):
    """With some, no and all words in the head; copies are ties."""
    rows = texts(150)
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(3)
    asked = [(i, rows[i][3]) for i in range(0, 60, 4)] + [(900, "the the of"), (901, ""), (902, None), (903, "never seen"), (904, "the of w1 w2")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    scope = text_index.everywhere(queries, ["x", "y"]).where("query_id % 8 <> 0 OR corpus = 'x'").unionByName(spark.createDataFrame([(904, "12"), (904, "nowhere"), (903, "12")], "query_id long, corpus string"))
    index = text_index.TextIndex.create(chunks.select("corpus", "doc_id", "chunk_idx", tokens(F.col("text")).alias("words")), f"file://{tmp_path}/index", head)
    got = sorted(map(tuple, index.search(queries, scope, k, threshold).collect()))
    assert got == by_comparing(spark, chunks, queries, scope, k, min(threshold, 1.0))
    assert len(got) > 20


def test_index_joins_fewer_rows_and_prunes_partitions(spark, tmp_path):
    rows = texts(300, 9)
    chunks = spark.createDataFrame(rows, CHUNKS).select("corpus", "doc_id", "chunk_idx", tokens(F.col("text")).alias("words"))
    index = text_index.TextIndex.create(chunks, f"file://{tmp_path}/index", 8)
    queries = spark.createDataFrame([(i, rows[i][3]) for i in range(0, 40, 2)], "query_id long, text string")
    scope = storage.materialize(text_index.everywhere(queries, ["x"]), "scope").where(F.col("corpus") > "")
    met = index.met(index._questions(queries), scope)
    plan = met._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    everything = chunks.where("corpus = 'x'").select(F.explode("words").alias("token")).join(retrieval.query_terms(queries), "token").count()
    assert met.count() * 5 < everything


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "corpus string, doc_id string, chunk_idx long, words array<string>")
    index = text_index.TextIndex.create(none, f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(1, "the of")], "query_id long, text string")
    assert index.search(queries, text_index.everywhere(queries, ["x"])).count() == 0


def test_blocks_find_what_a_join_by_token_finds(spark, monkeypatch):
    from heronry.functions import scalars
    from heronry.operators import retrieval, text_blocks

    for name, size in (("ROWS", 20), ("COMMON", 3), ("QUERIES", 2), ("ITEMS", 7)):
        monkeypatch.setattr(text_blocks, name, size)
    text = F.expr("concat_ws(' ', transform(sequence(0, cast(id % 9 as int)), i -> concat('w', pmod(xxhash64(id % 37, i), 11))), repeat('w1 ', cast(if(id = 5, 300, id % 4) as int)))")
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 7, text).alias("text"))
    asked = docs.where("doc_id % 5 < 3").select(F.col("doc_id").alias("query_id"), "text")
    items = docs.select("doc_id", scalars.tokens(F.col("text")).alias("words"))
    for k, threshold in ((3, 0.5), (4, 1.0)):
        want = retrieval.top_k(retrieval.distances(asked, items, ["doc_id"]), ["doc_id"], k, threshold)
        got = retrieval.nearest(asked, items, ["doc_id"], k, threshold)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    # no row for each pair that shares a token leaves a task
    assert text_blocks.met(asked.select("query_id", scalars.tokens(F.col("text")).alias("words")), items, ["doc_id"], 1, 1.0).count() <= asked.count() * 8


def test_millionths_are_rounded_as_spark_rounds(spark):
    import numpy as np

    from heronry.operators import text_blocks

    x = [0.1234565, 0.1234575, 0.0000005, 0.3333335, 0.2, 1 / 3, 0.4999995, 0.2500005]
    want = [round(r[0] * 1e6) for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert text_blocks.half_up(np.array(x)).astype(int).tolist() == want


def test_index_makes_no_row_for_a_shared_token(spark, tmp_path):
    """Every text shares rare words with every question: at most k rows of a question leave a group, and only its corpora's groups are asked."""
    rows = [("xy"[i % 2], i, 0, " ".join(f"rare{j}" for j in range(30)) + f" own{i}") for i in range(200)]
    chunks = spark.createDataFrame(rows, CHUNKS).select("corpus", "doc_id", "chunk_idx", tokens(F.col("text")).alias("words"))
    index = text_index.TextIndex.create(chunks, f"file://{tmp_path}/index", 4)
    queries = spark.createDataFrame([(i, rows[i][3]) for i in range(10)], "query_id long, text string")
    scope = text_index.everywhere(queries, ["x", "y"]).where("query_id > 4 OR corpus = 'x'")
    groups = {r["corpus"]: r["n"] for r in index.groups().collect()}
    assert index.met(index._questions(queries), scope).count() <= 10 * (10 * groups["x"] + 5 * groups["y"])
    assert all(r["corpus"] == "x" for r in index.search(queries, scope).where("query_id < 5").collect())
    by_task = index.texts().groupBy("__group").agg(F.countDistinct("corpus").alias("n")).agg(F.max("n")).first()[0]
    assert by_task == 1


def test_tokens_are_split_as_spark_splits(spark):
    import pyarrow as pa

    from heronry.operators import terms

    texts = ["a b", None, "", " \t\n", "x y z \x1cw\x0bv\x0c\r\x85 é　ü", "  a a  b "]
    want = [(i, t) for i, text in enumerate(texts) for t in spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] or []]
    row, token = terms.occurrences(pa.array(["cut off", *texts], pa.string()).slice(1))
    assert list(zip(row.tolist(), token.to_pylist())) == want
    row, token, tf = terms.counts(row, token)
    assert sorted(zip(row.tolist(), token.to_pylist(), tf.tolist()))[-2:] == [(5, "a", 2), (5, "b", 1)] and terms.squares(row, tf, 6).tolist()[5] == 5
