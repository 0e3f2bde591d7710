"""Token ids in ORC: range-partitioned files in document order, read back stripe by stripe.

The writer sorts by document id inside range partitions, so each file and each stripe covers a
narrow id range: ORC's integer run-length encoding stores ids and positions, its row index
(``row_index_stride`` rows) and Bloom filter on ``doc_id`` let a reader skip whole stripes, and
files split at stripes for parallel reads.

Defined results: a null text is an empty text (the end id alone). Null ids come first; equal ids
are ordered by a hash of their texts. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.llm import tokens
from heronry.llm.runtime import id_text, shared_path

#: Input bytes of a file, where more files are wanted than shuffles have partitions, and the most files.
FILE_BYTES = 128 << 20
MOST_FILES = 1_000_000
STORED = "part int, seq long, doc_id long, n_tokens long, ids array<int>"


def input_bytes(docs: DataFrame) -> int:
    """Bytes of the tables that ``docs`` is read from, as far as the planner knows them."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # more stands for unknown


def encode_parts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows in document order inside each range partition, with ids and place in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, seq = tokens.load(tokenizer), struct.pack("<I", end_id), 0
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, batch.num_rows, 256):  # the ids of a batch are larger than its texts
                ids = [enc.encode(t) + end for t in texts.slice(at, 256).to_pylist()]
                counts = [len(i) // 4 for i in ids]
                offsets = np.r_[0, np.cumsum(counts)].astype("i4")
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 256),
                        pa.array(range(seq, seq + len(ids)), pa.int64()),
                        batch.column(1).slice(at, 256),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                    ],
                    ["part", "seq", "doc_id", "n_tokens", "ids"],
                )
                seq += len(ids)

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_FILES, -(-input_bytes(docs) // FILE_BYTES)))
    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, STORED)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_index_stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    (
        encode_parts(docs, tokenizer, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "snappy")  # run-length encoded ids gain little more from a slower codec
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a filter on ``doc_id`` is pushed to stripe statistics and Bloom filters."""
    return spark.read.schema(STORED).orc(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and the checksum of its stored ids.

    Starts are running sums in two levels: inside a part (a window over a narrow table), and over
    parts, whose totals alone, one row each, are summed in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            counts = pa.array(np.diff(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], counts, pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    stored = read_ids(spark, path).select("part", "seq", "doc_id", "ids")
    found = stored.mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    totals = read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    running = found.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return running.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = shared_path(docs.sparkSession, "ids-orc")
    write_ids(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
