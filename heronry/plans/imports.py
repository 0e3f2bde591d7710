"""Queries that import whole tables into a corpus, each with the same query in SQL.

``documents`` are native files, ``pages`` are files of a kind that cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.corpus_store import CorpusStore
from heronry.plans import queries as base
from heronry.storage import shared_path

NATIVE = "application/vnd.google-apps.document"
HTML = "text/html"
#: Of the files imported twice every so-manieth is broken the second time; the others come with another beginning.
BROKEN = 5


def _store(spark: SparkSession) -> CorpusStore:
    return CorpusStore(spark, shared_path(spark, "corpus"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _native(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("document "), "doc_id").alias("name"), F.lit(NATIVE).alias("mime_type"), F.encode("text", "UTF-8").alias("content"))


def _chunks(store: CorpusStore) -> DataFrame:
    return store.live("chunks").select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_idx", "n_tokens", "chunk")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files came to which outcome, and why."""
    pages = base._table(spark, sf_dir, "pages")
    bad = pages.select(F.concat(F.lit("page "), "page_id").alias("file_id"), F.col("url").alias("name"), F.lit(HTML).alias("mime_type"), F.encode("html", "UTF-8").alias("content"))
    store = _store(spark)
    store.add(_native(base._table(spark, sf_dir, "documents")).unionByName(bad))
    return store.outcomes().groupBy("status", "message").agg(F.count("*").alias("n_files"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a corpus to which all documents were streamed."""
    path = f"{sf_dir}/documents.parquet"
    store = _store(spark)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may be one file or a folder
    store.stream(_native(stream), shared_path(spark, "stream")).awaitTermination()
    return _chunks(store)


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a compacted corpus of which every third file was imported again, changed or broken."""
    docs = base._table(spark, sf_dir, "documents")
    store = _store(spark)
    store.add(_native(docs))
    again = docs.where(F.col("doc_id") % 3 == 0).withColumn("text", F.concat(F.lit("changed "), F.col("text")))
    broken = F.when(F.col("file_id").cast("long") % BROKEN == 0, F.lit(b"\xff").cast("binary")).otherwise(F.col("content"))
    store.add(_native(again).withColumn("content", broken))
    store.compact()
    return _chunks(store)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"import_outcomes": _outcomes, "stream_import": _streamed, "replaced_files": _replaced}

_CHUNKS = "SELECT doc_id, chunk_idx, CAST(len(words) AS BIGINT) AS n_tokens, array_to_string(words, ' ') AS chunk FROM chunks"
_CHANGED = f"(SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % {BROKEN} = 0 THEN '' ELSE 'changed ' || text END ELSE text END AS text FROM documents) AS documents"

ORACLE_SQL: dict[str, str] = {
    "import_outcomes": f"SELECT 'success' AS status, NULL::VARCHAR AS message, count(*) AS n_files FROM documents UNION ALL SELECT 'error', 'Unsupported file type: {HTML}', count(*) FROM pages",
    "stream_import": f"WITH {base._CHUNKS_SQL} {_CHUNKS}",
    "replaced_files": f"WITH {base._CHUNKS_SQL.replace('FROM documents', 'FROM ' + _CHANGED)} {_CHUNKS}",
}
