"""What a corpus stores: append-only bucketed tables, of which each file's last import counts.

An import appends chunks and index terms, and last a row for each file, good or bad, with its
outcome. Rows count if their batch is the last one in which their file has an outcome; an import
that broke off has none and never counts. All tables are bucketed by ``doc_id``, so telling live
rows is a join of buckets: neither side is shuffled, however large the corpus. Compaction writes the
live rows as a new generation and removes the old one; it must not run beside an import.

A corpus keeps the number of buckets it was made with, as the files of an import must match those
there: choose it so that a bucket of the corpus as it will be suits a task.
"""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronry import config, storage
from heronry.operators import chunking
from heronry.operators.terms import counts, occurrences, slices, squares, text_slices
from heronry.sources import parsers

#: Buckets of a corpus for which nothing else is asked.
BUCKETS = 16
#: Columns of the tables, and how the files of each are sorted: terms by token, so that a question reads few row groups.
TABLES = {
    "chunks": ("doc_id string, uri string, title string, chunk_idx long, n_tokens long, chunk string, batch long", "doc_id"),
    "terms": ("doc_id string, chunk_idx long, token string, tf long, own_tf long, norm2 long, batch long", "token"),
    "documents": ("doc_id string, uri string, title string, status string, message string, norm2 long, stream string, epoch long, batch long", "doc_id"),
}
log = logging.getLogger(__name__)


class CorpusStore:
    """The tables of one corpus under ``path``; ``buckets`` counts only for a corpus without imports."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        target, fs = self._fs(f"{self.path}/buckets")
        if not fs.exists(target):
            fs.create(self._fs(f"{self.path}/buckets/{buckets}")[0]).close()
        self.buckets = int(fs.listStatus(target)[0].getPath().getName())

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The last generation that was finished; the first needs no mark."""
        target, fs = self._fs(f"{self.path}/finished")
        return max((int(f.getPath().getName()) for f in fs.listStatus(target)), default=0) if fs.exists(target) else 0

    def _name(self, kind: str, generation: int) -> str:
        return f"heronry_{hashlib.md5(self.path.encode()).hexdigest()[:20]}_{generation}_{kind}"

    def table(self, kind: str, generation: int | None = None) -> str:
        """The name of a table, made known to the session if it is not."""
        generation = self.generation() if generation is None else generation
        name, (columns, order) = self._name(kind, generation), TABLES[kind]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY ({order}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/gen={generation}/{kind}'")
        else:
            self.spark.catalog.refreshTable(name)
        return name

    def _append(self, kind: str, rows: DataFrame, generation: int | None = None) -> None:
        """Append rows that are dealt out as the buckets are (see ``_dealt``), so each bucket gets one file."""
        columns, order = TABLES[kind]
        wanted = rows.select(*(c.split()[0] for c in columns.split(", ")))
        wanted.write.format("parquet").mode("append").bucketBy(self.buckets, "doc_id").sortBy(order).saveAsTable(self.table(kind, generation))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "doc_id")

    def outcomes(self) -> DataFrame:
        """(doc_id, batch, ...) of each file's last import, with its outcome."""
        rows = self.spark.table(self.table("documents"))
        fields = [c for c in rows.columns if c != "doc_id"]
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*fields), "batch").alias("last")).select("doc_id", "last.*")

    def live(self, kind: str) -> DataFrame:
        """Rows of the last import of each file. Batches are compared by order, so buckets of ``doc_id`` serve the join as they are."""
        last = self.spark.table(self.table("documents")).groupBy(F.col("doc_id").alias("live_id")).agg(F.max("batch").alias("live_batch"))
        rows = self.spark.table(self.table(kind))
        return rows.join(last, (F.col("doc_id") == F.col("live_id")) & (F.col("batch") >= F.col("live_batch")), "left_semi").drop("batch")

    def has(self, stream: str, epoch: int) -> bool:
        """Whether a batch of a stream was imported."""
        return not self.spark.table(self.table("documents")).where((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()

    def add(self, files: DataFrame, stream: str | None = None, epoch: int | None = None) -> dict:
        """Import files (file_id, name, mime_type, content); repeated files are read once.

        One pass parses the files and splits them into two sinks, those that were read and those
        that were not, each with its reason. Returns the numbers of files, failures and chunks.
        """
        batch = time.time_ns()
        staged = storage.shared_path(self.spark, "staged")
        parsers.parse_files(files.dropDuplicates(["file_id"])).write.partitionBy("status").parquet(staged)
        parsed = self.spark.read.schema("file_id string, title string, content string, message string, status string").parquet(staged)
        named = parsed.select(F.col("file_id").alias("doc_id"), F.concat(F.lit("file:///d/"), "file_id").alias("uri"), "title", "status", "message", F.col("content").alias("text"))
        # texts are dealt out once, before they are cut up: whatever is made of them stays in its bucket
        dealt = self._dealt(named).persist(StorageLevel.DISK_ONLY)
        good, bad = dealt.where("status = 'success'"), dealt.where("status = 'error'")
        self._append("chunks", chunking.chunk_text(good.select("doc_id", "uri", "title", "text")).withColumn("batch", F.lit(batch)))
        self._append("terms", term_rows(good.select("doc_id", "text")).withColumn("batch", F.lit(batch)))
        # last: from now on this import counts, and what was stored of these files before does not
        rows = with_norms(good).unionByName(bad.drop("text").withColumn("norm2", F.lit(None).cast("long")))
        rows = rows.withColumns({"stream": F.lit(stream).cast("string"), "epoch": F.lit(epoch).cast("long"), "batch": F.lit(batch)})
        self._append("documents", self._dealt(rows))
        dealt.unpersist()
        counted = self.spark.table(self.table("documents")).where(F.col("batch") == batch).groupBy("status").count().collect()
        by = {r["status"]: r["count"] for r in counted}
        n_chunks = self.spark.table(self.table("chunks")).where(F.col("batch") == batch).count()
        storage.remove(self.spark, staged)
        return {"n_files": sum(by.values()), "n_failed": by.get("error", 0), "n_chunks": n_chunks}

    def stream(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        """Import all new rows of a stream of files, then stop.

        A batch is imported whole or not at all, and once: one that is sent again after a failure
        finds its outcomes stored and is passed over.
        """

        def take(batch: DataFrame, epoch: int) -> None:
            if not self.has(checkpoint, epoch) and not batch.isEmpty():
                self.add(batch, checkpoint, epoch)

        return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _kept(self, kind: str, generation: int) -> DataFrame:
        """What compaction keeps of a table, a bucket in a partition: rows are read in buckets and stay there."""
        if kind == "documents":
            return self._dealt(self.outcomes())
        last = self.spark.table(self.table("documents", generation)).groupBy(F.col("doc_id").alias("live_id")).agg(F.max("batch").alias("live_batch"))
        rows = self.spark.table(self.table(kind, generation))
        # a bucket's last imports are few beside its rows; broadcast, they would not have the rows read in buckets
        return rows.join(last.hint("shuffle_hash"), (F.col("doc_id") == F.col("live_id")) & (F.col("batch") >= F.col("live_batch")), "left_semi")

    def compact(self) -> int:
        """Keep only live rows, as a new generation; its number."""
        old = self.generation()
        for kind in TABLES:
            self._append(kind, self._kept(kind, old), old + 1)
        target, fs = self._fs(f"{self.path}/finished/{old + 1}")
        fs.create(target).close()
        self._forget(old)
        storage.remove(self.spark, f"{self.path}/gen={old}")
        log.info("compacted %s to generation %d", self.path, old + 1)
        return old + 1

    def _forget(self, generation: int) -> None:
        for kind in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind, generation)}")

    def drop(self) -> None:
        self._forget(self.generation())
        storage.remove(self.spark, self.path)


def with_norms(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns and ``text``) with the squared norm of each text's counts in place of the text."""
    keys = [c for c in docs.columns if c != "text"]

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, _, tf = counts(*occurrences(batch.column(len(keys))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(squares(row, tf, batch.num_rows))], [*keys, "norm2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return docs.select(*keys, "text").mapInArrow(norm, f"{schema}, norm2 long")


def term_rows(docs: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """A row for each distinct token of a chunk of docs (doc_id, text).

    With its count, its count in the part that is not in the chunk before, and the chunk's norm.
    Tokens are counted a batch of texts at a time: only rows of the index are made, none is sent.
    """
    stride = size - overlap

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # long runs in the order in which files are sorted: of few runs a sort is a merge
        for batch in text_slices(batches, 1):
            row, token = occurrences(batch.column(1))
            if not len(row):
                continue
            named = token.dictionary_encode()
            code, n = named.indices.to_numpy(), np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            last = np.maximum(0, -(-(n - size) // stride))
            first = np.cumsum(last + 1) - (last + 1)  # chunks of the batch are numbered through
            found = []
            for back in range(-(-size // stride)):  # the chunks that a token is in
                chunk = place // stride - back
                held = (chunk >= 0) & (chunk <= last[row]) & (place < chunk * stride + size)
                found.append((first[row[held]] + chunk[held], code[held], (chunk[held] == 0) | (place[held] - chunk[held] * stride >= overlap)))
            number, code, own = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = pc.sort_indices(named.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            of = np.repeat(np.arange(batch.num_rows), last + 1)
            pair, at, tf = np.unique(rank[code] * len(of) + number, return_inverse=True, return_counts=True)
            number, code = pair % len(of), order[pair // len(of)]
            own_tf = np.bincount(at[own], minlength=len(pair))
            norm2 = squares(number, tf, len(of))
            made = [batch.column(0).take(pa.array(of[number])), pa.array(number - first[of[number]], pa.int64()), named.dictionary.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(own_tf, pa.int64()), pa.array(norm2[number])]
            yield from slices([pa.RecordBatch.from_arrays(made, ["doc_id", "chunk_idx", "token", "tf", "own_tf", "norm2"])], 50_000)

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id string, chunk_idx long, token string, tf long, own_tf long, norm2 long")
