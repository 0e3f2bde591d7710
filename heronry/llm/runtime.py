"""Shared plumbing: durable intermediate tables and defensive reading of ``documents``."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is joined without a shuffle.
HOT_SHARE = 1000
#: Bits of a sift for each key, in pages of so many; at most so many pages, 8 MB, however many keys.
SIFT_BITS, SIFT_PAGE, SIFT_PAGES = 16, 1 << 15, 1 << 11


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent on a single machine (tests) is a folder of our own made: on
    a cluster executors would each write to their own disk, so there the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="heronry-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/heronry-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation, and
    whatever is not deterministic upstream (group order, row numbers) is fixed from here on.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def free(*tables: DataFrame | None) -> None:
    """Remove materialized tables that no later plan reads; their disk is free at once."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hot(keys: DataFrame, held: str, total: int) -> DataFrame:
    """The keys that hold more than a thousandth of ``total`` rows, so fewer than a thousand."""
    return keys.where(F.col(held) * HOT_SHARE > F.lit(total))


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], frequent: DataFrame) -> DataFrame:
    """Inner join of ``many`` to ``one`` in which no frequent key is gathered in a task.

    Rows of ``many`` with a key of ``frequent`` (see ``hot``) stay where they are and meet a
    broadcast of at most a thousand keys' rows of ``one``; only the others are shuffled.
    """
    frequent = F.broadcast(frequent.select(*keys))
    here = many.join(F.broadcast(one.join(frequent, keys, "left_semi")), keys)
    return here.unionByName(many.join(frequent, keys, "left_anti").join(one.join(frequent, keys, "left_anti"), keys))


def sift(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be among ``keys``, and all others, whose key is not; no row is moved.

    Each key sets one bit of a bitmap, which is broadcast, so that rows with large columns are
    shuffled only where a join can find something. Beyond its greatest size more rows may be
    among the first; an exact join has to follow. Key columns have the same types in both.
    """
    columns = [f"`{c}`" for c in rows.columns]
    pages = min(SIFT_PAGES, 1 + keys.count() * SIFT_BITS // SIFT_PAGE)
    place = F.pmod(F.xxhash64(*on), F.lit(pages * SIFT_PAGE))
    page, bit = F.floor(place / SIFT_PAGE).cast("int"), place.bitwiseAND(F.lit(SIFT_PAGE - 1))
    bits = keys.select(page.alias("__page"), bit.alias("__bit")).repartition("__page").groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    told = rows.withColumn("__page", page).join(F.broadcast(bits), "__page", "left")
    return told.where(may).select(*columns), told.where(~may).select(*columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, where what is made of a row in Python is much larger than the row."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first column as tables that never part equal keys, with the starts of the keys.

    For ``repartition(key).sortWithinPartitions(key).mapInArrow``: groups arrive many to a batch,
    and no more than a batch and one group is held.
    """
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        keys = part.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if rest and rest[-1].column(0)[0].as_py() == keys[-1]:
            rest.append(part)
            continue
        if rest and rest[-1].column(0)[0].as_py() != keys[0] or cut:
            yield _with_starts(pa.concat_tables([*rest, part.slice(0, cut)]))
            rest = []
        rest.append(part.slice(cut))
    if rest:
        yield _with_starts(pa.concat_tables(rest))


def _with_starts(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    keys = table.column(0).to_numpy()
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text made empty; other columns cannot clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
