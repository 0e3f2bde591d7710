"""Imports that keep each file's outcome, streams that are replayed, replaced rows, and compaction."""

import re

import pytest
from pyspark.sql import functions as F

from heronry import config
from heronry.corpus_store import CorpusStore
from heronry.engine import Engine
from heronry.operators import retrieval
from heronry.sources import writers

FILES = "file_id string, name string, mime_type string, content binary"
NATIVE = "application/vnd.google-apps.document"


def native(spark, texts):
    return spark.createDataFrame([(i, f"{i}.gdoc", NATIVE, t.encode()) for i, t in texts], FILES)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/corpora")
    e.create_corpus("c")
    return e


def store_of(e):
    return e.store(e.catalog.find("c", e.session))


def test_every_file_has_an_outcome(spark, engine):
    rows = [("1", "a.docx", "", writers.docx(writers.docx_paragraph("fine text"))), ("2", "b.docx", "", b"broken"), ("3", "c.html", "text/html", b"<p>"), ("4", "d.gdoc", NATIVE, b"\xff"), ("5", "e.gdoc", NATIVE, b""), ("1", "a.docx", "", b"again"), ("6", None, None, None)]
    counted = store_of(engine).add(spark.createDataFrame(rows[:5] + rows[6:], FILES))
    assert counted == {"n_files": 6, "n_failed": 4, "n_chunks": 1}
    got = {r["doc_id"]: r for r in engine.import_outcomes("c").collect()}
    assert {i: r["status"] for i, r in got.items()} == {"1": "success", "2": "error", "3": "error", "4": "error", "5": "success", "6": "error"}
    assert all((r["message"] is None) == (r["status"] == "success") for r in got.values())
    assert "text/html" in got["3"]["message"] and "UTF-8" in got["4"]["message"]
    # read again, one is mended and one is broken: the last outcome counts, and a broken file has no chunks
    store_of(engine).add(spark.createDataFrame([("2", "b.docx", "", rows[0][3]), ("1", "a.docx", "", b"broken")], FILES))
    got = {r["doc_id"]: r["status"] for r in engine.import_outcomes("c").collect()}
    assert got == {"1": "error", "2": "success", "3": "error", "4": "error", "5": "success", "6": "error"}
    assert [r["doc_id"] for r in store_of(engine).live("chunks").collect()] == ["2"]
    assert store_of(engine).add(spark.createDataFrame([], FILES)) == {"n_files": 0, "n_failed": 0, "n_chunks": 0}


def test_stream_is_imported_once(spark, engine, tmp_path):
    source, check = f"{tmp_path}/in", f"{tmp_path}/check"
    native(spark, [("1", "herons by the water"), ("2", "a budget table")]).write.parquet(source)
    stream = lambda: spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(source)
    engine.stream_data(stream(), "c", check).awaitTermination()
    first = sorted(map(tuple, engine.chunks(engine.catalog.find("c", engine.session)).collect()))
    assert len(first) == 2
    native(spark, [("2", "a table of herons"), ("3", "new words")]).write.mode("append").parquet(source)
    engine.stream_data(stream(), "c", check).awaitTermination()
    store = store_of(engine)
    assert sorted(r["chunk"] for r in store.live("chunks").collect()) == ["a table of herons", "herons by the water", "new words"]
    rows = spark.table(store.table("documents")).count()
    # a batch that is sent again after its import changes nothing; one that broke off before its end never counts
    assert any(store.has(check, epoch) for epoch in range(4)) and not store.has(check, 99) and not store.has("other", 0)
    query = Engine(spark, engine.catalog.root)
    query.stream_data(stream(), "c", check).awaitTermination()
    assert spark.table(store.table("documents")).count() == rows
    batch = 10**18 * 9
    store._append("chunks", store._dealt(spark.createDataFrame([("1", "u", "t", 0, 1, "half an import", batch)], "doc_id string, uri string, title string, chunk_idx long, n_tokens long, chunk string, batch long")))
    assert "half an import" not in [r["chunk"] for r in store.live("chunks").where("doc_id <> '1'").collect()]


def test_replayed_batch_is_passed_over(spark, engine, tmp_path):
    """The same epoch handed over twice, as after a failure between the import and the stream's own commit."""
    store = store_of(engine)
    files = native(spark, [("1", "one two")])
    store.add(files, "stream", 4)
    before = [spark.table(store.table(k)).count() for k in ("chunks", "terms", "documents")]
    if not store.has("stream", 4):
        store.add(files, "stream", 4)
    assert [spark.table(store.table(k)).count() for k in ("chunks", "terms", "documents")] == before == [1, 2, 1]


def test_live_rows_need_no_shuffle(spark, engine):
    store = store_of(engine)
    for turn in range(3):
        store.add(native(spark, [(str(i), f"text {i} of turn {turn}") for i in range(8 - turn)]))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for kind in ("chunks", "terms"):
            plan = store.live(kind)._jdf.queryExecution().executedPlan().toString()
            assert not re.search("Exchange", plan) and "SortMergeJoin" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted(r["chunk"] for r in store.live("chunks").collect()) == sorted(f"text {i} of turn {2 if i < 6 else 1 if i < 7 else 0}" for i in range(8))


def test_compaction_removes_what_was_replaced(spark, engine):
    store = store_of(engine)
    for turn in range(3):
        store.add(native(spark, [("1", f"turn {turn} herons"), ("2", "same words")] + [("3", "only once")] * (turn == 0)))
    store.add(spark.createDataFrame([("2", "b.docx", "", b"broken")], FILES))
    live = {k: sorted(map(repr, store.live(k).collect())) for k in ("chunks", "terms")}
    outcomes = sorted(map(repr, store.outcomes().collect()))
    assert spark.table(store.table("chunks")).count() == 7
    assert engine.compact("c") == 1 and store.generation() == 1
    assert {k: sorted(map(repr, store.live(k).collect())) for k in live} == live and sorted(map(repr, store.outcomes().collect())) == outcomes
    assert spark.table(store.table("chunks")).count() == 2
    # and goes on: the next import replaces rows of the new generation
    store.add(native(spark, [("3", "changed")]))
    assert sorted(r["chunk"] for r in store.live("chunks").collect()) == ["changed", "turn 2 herons"] and engine.compact("c") == 2
    # another session finds the tables where they are
    other = CorpusStore(spark, store.path)
    for kind in ("chunks", "terms", "documents"):
        spark.sql(f"DROP TABLE {store.table(kind)}")
    assert sorted(r["chunk"] for r in other.live("chunks").collect()) == ["changed", "turn 2 herons"]
    engine.delete_corpus("c", confirm=True)
    assert engine.catalog.folders(store.path) == []


def test_question_is_told_to_the_scan(spark, engine):
    store_of(engine).add(native(spark, [(str(i), f"herons {i} by the water") for i in range(9)]))
    resource = engine.catalog.find("c", engine.session)
    plan = engine._asked_terms(resource, ["herons", "water"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(token", plan)
    ask = spark.createDataFrame([("q", "water 3 herons")], "query_id string, text string")
    assert engine.retrieve("c", ask).orderBy("rn").first()["uri"].endswith("/3")


def test_similar_documents_come_from_the_index(spark, engine):
    """Overlapping chunks add up to the document: the distances of whole texts."""
    size, stride = config.CHUNK_SIZE, config.CHUNK_SIZE - config.CHUNK_OVERLAP
    texts = [("1", " ".join(f"w{i % 97}" for i in range(size + stride))), ("2", " ".join(f"w{i % 89}" for i in range(1500))), ("3", "w1 w2 w3"), ("4", " ".join(f"w{i % 97}" for i in range(size + 1)))]
    files = native(spark, texts)
    engine.files = files
    store_of(engine).add(files)
    got = [tuple(r) for r in engine.similar_documents("c", "https://x/d/1", threshold=0.9).orderBy("rn").collect()]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    want = retrieval.similar_documents(docs, docs.where("doc_id = '1'"), threshold=0.9).orderBy("rn").collect()
    assert [(t, d, n) for _, t, d, n in got] == [(f"{r['doc_id']}.gdoc", r["dist"], r["rn"]) for r in want] and len(got) >= 3
    assert [r["title"] for r in engine.similar_documents("c", "https://x/d/1", threshold=0.9, exclude_self=True).collect()][0] != "1.gdoc"


def test_batch_answers_from_a_corpus(spark, engine):
    store_of(engine).add(native(spark, [("1", "herons by the water"), ("2", "budget table")]))
    asked = spark.createDataFrame([(1, "the water"), (2, "zebra"), (3, "budget")], "query_id long, text string")
    got = {r["query_id"]: r for r in engine.answer("c", asked, lambda: lambda text, chunks: f"{len(chunks)}: {chunks[0]}", threshold=0.9).collect()}
    assert (got[1]["answer"], got[2]["status"], got[3]["answer"]) == ("1: herons by the water", "warning", "1: budget table")
    terms = store_of(engine).live("terms").groupBy("doc_id").agg(F.sum("own_tf").alias("n"))
    assert {r["doc_id"]: r["n"] for r in terms.collect()} == {"1": 4, "2": 2}


def test_terms_are_those_of_the_chunks(spark):
    """Counts, own counts and norms of every chunk, by counting word by word."""
    from collections import Counter

    from heronry.corpus_store import term_rows, with_norms

    texts = [("a", "x y x z " * 5), ("b", ""), ("c", None), ("d", "w1 w2 w1"), ("e", " ".join(f"w{i % 3}" for i in range(7))), ("f", " ".join(f"w{i * i % 5}" for i in range(8)))]
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(2)
    for size, overlap in ((4, 1), (5, 3), (6, 0)):
        want = []
        for i, text in texts:
            words, stride = (text or "").split(), size - overlap
            for c in range(1 + max(0, -(-(len(words) - size) // stride)) if words else 0):
                held = words[c * stride : c * stride + size]
                found, own = Counter(held), Counter(held[overlap if c else 0 :])
                want += [(i, c, w, n, own[w], sum(m * m for m in found.values())) for w, n in found.items()]
        assert sorted(map(tuple, term_rows(docs, size, overlap).collect())) == sorted(want)
    norms = {r["doc_id"]: r["norm2"] for r in with_norms(docs).collect()}
    assert norms == {i: sum(n * n for n in Counter((t or "").split()).values()) for i, t in texts}


def test_compaction_sends_no_rows(spark, engine):
    """Tables are read and written in their buckets, one file each."""
    store = store_of(engine)
    for turn in range(2):
        store.add(native(spark, [(str(i), f"text {i} of turn {turn}") for i in range(40)]))
    for kind in ("chunks", "terms"):
        plan = store._kept(kind, 0)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "ShuffledHashJoin" in plan, plan
    engine.compact("c")
    for kind in ("chunks", "terms", "documents"):
        assert len(spark.table(store.table(kind)).inputFiles()) <= store.buckets
    assert store.live("terms").where("token = 'turn'").count() == 40


def test_terms_come_in_the_order_of_their_files(spark):
    """A task's rows are one sorted run for each slice of texts, which a sort only merges; slices are cut by bytes."""
    import pyarrow as pa

    from heronry.corpus_store import term_rows
    from heronry.operators.terms import text_slices

    docs = spark.createDataFrame([(str(i), f"b{i} é a{i % 3} z the") for i in range(50)], "doc_id string, text string").coalesce(1)
    got = [r["token"].encode() for r in term_rows(docs).collect()]
    assert got == sorted(got) and len(got) == 250
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "t": ["x" * 30, None, "y" * 5, "", "z" * 5, "w"]})
    assert [p.column(0).to_pylist() for p in text_slices([batch], 1, 3, 10)] == [[0], [1, 2, 3], [4, 5]]
