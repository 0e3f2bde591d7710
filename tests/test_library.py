import math
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry import catalog
from heronry.engine import Engine
from heronry.functions import scalars
from heronry.operators import chunking, retrieval
from heronry.sources import parsers, writers
from heronry.streaming.ingest import ingest

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (511, 1), (512, 1), (513, 2), (924, 2), (925, 3)])
def test_chunk_counts(spark, n, chunks):
    docs = spark.createDataFrame([(1, "\n" + " ".join(f"w{i}" for i in range(n)), "x")], "doc_id long, text string, chunk_idx string").drop("chunk_idx")
    rows = chunking.chunk_text(docs).orderBy("chunk_idx").collect()
    assert len(rows) == chunks
    if rows:
        assert rows[-1]["chunk"].split()[-1] == f"w{n - 1}"
        assert {w for r in rows for w in r["chunk"].split()} == {f"w{i}" for i in range(n)}


@quick
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_sanitize_keeps_length_and_is_idempotent(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalars.sanitize(F.col("n")).alias("s"))
    for r in rows.select("n", "s", scalars.sanitize(F.col("s")).alias("t")).collect():
        assert len(r["s"]) == len(r["n"]) and r["s"] == r["t"]


def test_truncation_counts_code_points(spark):
    rows = spark.createDataFrame([("a" * 9999 + "😀b",), ("a" * 10000,), (None,)], "t string")
    got = [r[0] for r in rows.select(scalars.truncate(F.col("t"))).collect()]
    assert got == ["a" * 9999 + "😀", "a" * 10000, None]


@quick
@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30))
def test_squared_norm(spark, words):
    got = spark.createDataFrame([(words,)], "w array<string>").select(retrieval.squared_norm(F.col("w"))).first()[0]
    assert got == sum(words.count(w) ** 2 for w in set(words))


@quick
@given(st.lists(st.tuples(st.sampled_from([None, "", "u1", "u2", "u3"]), st.sampled_from([None, "t1", "t2"])), max_size=12))
def test_sources_are_first_seen(spark, contexts):
    rows = [("q", i, u, t) for i, (u, t) in enumerate(contexts)]
    got = retrieval.sources(spark.createDataFrame(rows, "query_id string, pos long, uri string, title string")).orderBy("pos").collect()
    seen = {}
    for u, t in contexts:
        if u and u not in seen:
            seen[u] = t
    assert [(r["uri"], r["title"]) for r in got] == list(seen.items())


def test_dense_top_k_sends_nothing_by_the_driver(spark):
    vectors = spark.range(40).selectExpr("id AS vec_id", "array(cos(id), sin(id), 0.5D) AS embedding")
    asked = vectors.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    one, many = (retrieval.dense_top_k(asked, vectors, 3, 0.5, block=b, held=h) for b, h in ((64, 1), (3, 2)))
    assert one.count() == 30 and sorted(one.collect()) == sorted(many.collect())
    assert "Broadcast" not in many._jdf.queryExecution().toString()


def test_dense_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.5, math.sqrt(0.75)]), (4, [0.8, 0.6]), (5, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id in (0, 2, 5)").withColumnRenamed("vec_id", "query_id")
    got = retrieval.dense_top_k(asked, vectors, 10, 0.5, block=2).orderBy("query_id", "rn").collect()
    # the zero vector has no distance, and one at the threshold is not nearer than it
    assert [(r["query_id"], r["vec_id"], r["dist"]) for r in got] == [(0, 0, 0.0), (0, 1, 0.0), (0, 4, 0.2)]


def test_parsers_order_and_emptiness():
    p, w = writers.docx_paragraph, writers.docx
    table = f"<w:tbl><w:tr><w:tc>{p('c1')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    assert parsers.docx(w(p("one") + p("") + table + p("two"))) == "one\ntwo\nc1\n"
    shape = writers.pptx_shape
    group = f"<p:grpSp>{shape('hidden')}</p:grpSp>"
    assert parsers.pptx(writers.pptx([shape("a") + "<p:pic/>" + shape("") + group, shape("b")])) == "a\n\nb"
    t, n = writers.xlsx_text, lambda v: f't="n"><v>{v}</v>'
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
    sheet = [[t("name"), t("k"), t("ok"), t("day")], [t('x, "y"'), n(1), 't="b"><v>1</v>', 's="1"><v>45292</v>'], [t("z"), "", 't="b"><v>0</v>', 's="1"><v>45293</v>']]
    assert parsers.xlsx(writers.xlsx([sheet, [[t("other")]]], styles)) == 'name,k,ok,day\n"x, ""y""",1.0,True,2024-01-01\nz,,False,2024-01-02\n'
    assert parsers.pdf(writers.pdf(["first (1) \\ line\nsecond", ""])) == "first (1) \\ line\nsecond"


def test_damaged_and_unsupported_files_are_rows(spark):
    rows = [("1", "a.docx", "", b"no zip"), ("2", "b.html", "text/html", b""), ("3", "c", "application/vnd.google-apps.document", "é".encode()), ("4", "d.pdf", "application/pdf", None)]
    got = {r["file_id"]: r for r in parsers.parse_files(spark.createDataFrame(rows, "file_id string, name string, mime_type string, content binary")).collect()}
    assert [got[k]["status"] for k in "1234"] == ["error", "error", "success", "error"]
    assert "text/html" in got["2"]["message"] and got["3"]["content"] == "é"


def test_docx_tab_stops_are_no_text():
    stop = '<w:pPr><w:tabs><w:tab w:val="left" w:pos="720"/></w:tabs></w:pPr>'
    body = f"<w:p>{stop}</w:p><w:p>{stop}<w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>"
    assert parsers.docx(writers.docx(body)) == "x\ty"


def test_xlsx_headers_and_missing_words():
    t, n = writers.xlsx_text, lambda v: f't="n"><v>{v}</v>'
    sheet = [[t("a"), t("a"), "", t("a.1")], [t("NA"), n(1), n(2), t("x")], [t("b"), n(3), n(4), t("null")]]
    assert parsers.xlsx(writers.xlsx([sheet])) == "a,a.1,Unnamed: 2,a.1.1\n,1,2,x\nb,3,4,\n"


def raw_pdf(objects, trailer=b"<< /Root 1 0 R >>"):
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k, o) for k, o in objects.items()) + b"\ntrailer\n" + trailer + b"\nstartxref\n0\n%%EOF"


def flate(data, extra=b""):
    body = zlib.compress(data)
    return b"<< /Filter /FlateDecode /Length %d %s >>\nstream\n%s\nendstream" % (len(body), extra, body)


def test_pdf_page_trees_object_streams_and_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    inside = [(3, b"<< /Type /Pages /Kids [5 0 R] /Parent 2 0 R >>"), (4, b"<< /Type /Page /Contents 11 0 R >>"), (5, b"<< /Type /Page /Contents [12 0 R] >>")]
    head, at = [], 0
    for k, o in inside:
        head.append(b"%d %d" % (k, at))
        at += len(o) + 1
    first = len(b" ".join(head)) + 1
    packed = b" ".join(head) + b" " + b" ".join(o for _, o in inside)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Kids [4 0 R 3 0 R] /Type /Pages /Resources << /Font << /F1 8 0 R /F2 9 0 R >> >> >>",
        7: flate(packed, b"/Type /ObjStm /N 3 /First %d" % first),
        8: b"<< /Type /Font /Subtype /Type1 >>",
        9: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>",
        10: flate(cmap),
        11: flate(b"BT /F1 12 Tf (one \\(1\\) \\351) Tj 0 -14 Td [(ni)-20(ne)] TJ ET"),
        12: flate(b"BT /F2 9 Tf <000100020003> Tj ET"),
    }
    assert parsers.pdf(raw_pdf(objects)) == "one (1) é\nnine\néab"
    for bad in (raw_pdf(objects, b"<< /Root 1 0 R /Encrypt 5 0 R >>"), raw_pdf({**objects, 9: b"<< /Subtype /Type0 >>"}), raw_pdf({**objects, 2: b"<< /Kids [2 0 R] >>"}), b"%PDF-1.4 nothing"):
        assert parsers.parse_one("pdf", bad)[0] == "error"


def test_pdf_streams_that_end_like_a_line():
    pages = ["a" * i for i in range(1, 257)]  # checksums with every last byte
    assert any(zlib.compress(b"BT (%b) Tj T* ET" % p.encode()).endswith(b"\r") for p in pages)
    assert all(parsers.parse_one("pdf", writers.pdf([p])) == ("success", p, None) for p in pages)
    made = writers.pdf(["one"])
    cut = re.sub(rb"stream\n(.*?).{6}\nendstream", rb"stream\n\1\nendstream", made, flags=re.S)
    assert cut != made and parsers.parse_one("pdf", cut)[0] == "error"


def test_files_of_a_folder_are_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(writers.docx(writers.docx_paragraph("first")))
    (tmp_path / "sub" / "b.gdoc").write_bytes("é".encode())
    (tmp_path / "sub" / "c.gdoc").write_bytes(b"\xff\xfe")
    files = parsers.read_folder(spark, str(tmp_path), {"gdoc": "application/vnd.google-apps.document"})
    got = {r["title"]: (r["status"], r["content"]) for r in parsers.parse_files(files).collect()}
    assert got == {"a.docx": ("success", "first"), "b.gdoc": ("success", "é"), "c.gdoc": ("error", None)}


def test_importing_twice_changes_nothing(spark, tmp_path):
    folder = spark.createDataFrame([("f1", "plans", "application/vnd.google-apps.folder", False)], "folder_id string, name string, mime_type string, trashed boolean")

    def files(texts):
        rows = [(i, f"{i}.docx", "", writers.docx(writers.docx_paragraph(t)), "f1") for i, t in texts]
        return spark.createDataFrame(rows, "file_id string, name string, mime_type string, content binary, folder_id string")

    e = Engine(spark, str(tmp_path), folder, files([("1", "the heron stands by the water"), ("2", "a table of numbers"), ("2", "a table of numbers")]))
    e.create_corpus("c")
    e.create_corpus("other")
    ask = spark.createDataFrame([("q", "the heron by the water")], "query_id string, text string")
    assert e.add_data(["plans"], "c")["n_files"] == 2 and e.session.current.endswith(e.catalog.find("other", e.session).rsplit("/", 1)[-1])
    once = sorted(e.retrieve("c", ask, threshold=1.0).collect())
    e.add_data(["plans"], "c")
    assert sorted(e.retrieve("c", ask, threshold=1.0).collect()) == once and all(0 <= r["dist"] <= 1 for r in once)
    plain = retrieval.retrieve(ask, e.chunks(e.catalog.find("c", e.session)).select("doc_id", "chunk_idx", scalars.tokens(F.col("chunk")).alias("words")), threshold=1.0)
    assert [(r["uri"], r["dist"]) for r in once] == [(f"file:///d/{r['doc_id']}", r["dist"]) for r in plain.orderBy("rn").collect()]
    e.files = files([("1", "entirely different words"), ("2", "a table of numbers")])
    e.add_data(["plans"], "c")
    assert e.retrieve("c", ask, threshold=1.0).count() == 0 and e.list_files("c").count() == 2
    e.files = e.files.drop("content")
    assert e.add_data(["plans"], "c")["status"] == "error" and e.get_document_content("https://x/d/1")["status"] == "error"


def test_registry_folds_events(spark):
    rows = [("r1", "a", "create", "2024-01-01", 0), ("r2", "a", "create", "2024-01-02", 1), ("r1", "", "delete", "2024-01-03", 2)]
    events = spark.createDataFrame(rows, "resource_name string, display_name string, event string, t string, seq long").withColumn("at", F.col("t").cast("timestamp"))
    assert [(r["resource_name"], r["display_name"]) for r in catalog.fold(events).collect()] == [("r2", "a")]


def test_engine_end_to_end(spark, tmp_path):
    mime = "application/vnd.google-apps.folder"
    folder = spark.createDataFrame([("f1", "plans", mime, False), ("f2", "it's", mime, False), ("f3", "old", mime, True)], "folder_id string, name string, mime_type string, trashed boolean")
    texts = [("1", "herons nest in tall trees by the water", "f1"), ("2", "budget table for the second quarter", "f1"), ("3", "herons eat fish from the water", "f2")]
    rows = [(i, f"{i}.docx", "", writers.docx(writers.docx_paragraph(t)), f) for i, t, f in texts]
    files = spark.createDataFrame(rows, "file_id string, name string, mime_type string, content binary, folder_id string")
    e = Engine(spark, str(tmp_path), folder, files)
    assert e.rag_query("nothing", "x")["status"] == "error"
    made = e.create_corpus("my notes")
    assert made["display_name"] == "my_notes" and made["corpus_created"]
    assert e.add_data(["missing", "old"], "my notes") == {"status": "error", "message": "No folder found: missing, old"}
    added = e.add_data(["plans", "it's", "plans", "missing"], "")
    assert (added["status"], len(added["paths"]), added["not_found"], added["n_files"], added["n_chunks"]) == ("success", 3, ["missing"], 3, 3)
    found = e.rag_query("my notes", "herons by the water", generator=lambda q, c: f"{len(c)} contexts")
    assert found["status"] == "success" and found["results"]["answer"] == ["2 contexts"]
    assert [s["title"] for s in found["results"]["sources"]] == ["1.docx", "3.docx"]
    assert e.rag_query("my_notes", "zebra")["status"] == "warning"
    assert e.get_document_content("https://x/d/2/edit")["content"].startswith("budget")
    assert e.get_document_content("https://x/none")["status"] == "error"
    near = e.similar_documents("", "https://x/d/1", threshold=0.9, exclude_self=True).collect()
    assert [r["title"] for r in near] == ["3.docx"] or near[0]["title"] == "3.docx"
    assert e.list_corpora().count() == 1 and e.list_files("my notes").count() == 3
    assert e.delete_corpus("my notes")["status"] == "error"
    assert e.delete_corpus("my notes", confirm=True)["status"] == "success"
    assert e.list_corpora().count() == 0 and e.session.current is None and e.delete_corpus("my_notes", True)["status"] == "error"


def test_streaming_ingest_takes_each_file_once(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs.where("doc_id < 100").write.parquet(src)
    ingest(spark, src, out, check).awaitTermination()
    docs.where("doc_id >= 100").write.mode("append").parquet(src)
    ingest(spark, src, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == chunking.chunk_text(docs.select("doc_id", "text")).count()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
