"""A stored index of vectors for exact nearest neighbours under a distance cap.

Every vector belongs to its nearest pivot. The vectors of a pivot are stored in the order of their
angle to it, in blocks: one row with ids, norms and one flat buffer of numbers, the pivot as
partition of the files and the least and greatest angle beside it. Angles between directions obey
the triangle inequality, so a block whose angles to its pivot all differ from a query's angle to
that pivot by more than the cap cannot hold a neighbour of the query: it is neither sent to a task
nor read into a product. What is left is compared in one matrix product for each pair of blocks.

A vector may be the part of a longer one that is stored elsewhere: then ``whole`` is the norm of all
of it, distances are those of the parts over whole norms, and a block whose vectors are mostly
elsewhere needs a smaller angle to matter. Vectors of different ``part`` never meet.

Pivots come from a sample of bounded size; that decides how much is skipped, never what is found.
Vectors without direction (null, all zeros, not finite) are not stored and have no neighbours;
repeated rows are vectors of their own. All vectors have the same number of dimensions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry import config
from heronry.operators.retrieval import top_k
from heronry.storage import materialize

#: At most so many pivots, chosen from a sample of so many vectors. Both bound what the driver sees.
PIVOTS = 64
SAMPLE = 4096
#: Vectors in a stored block and in a block of queries.
BLOCK = 2048
QUERY_BLOCK = 512
#: Angles are widened by this, more than the rounding of distances and products can move them.
SLACK = 1e-4

BLOCKS = "block string, lo double, hi double, share double, vec_ids array<long>, norms array<double>, data binary, part string, pivot int"
_ARROW = pa.schema([
    ("block", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()), ("share", pa.float64()), ("vec_ids", pa.list_(pa.int64())),
    ("norms", pa.list_(pa.float64())), ("data", pa.binary()), ("part", pa.string()), ("pivot", pa.int32()),
])


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Directions around which vectors gather: a few rounds of spherical k-means on a sample.

    The sample are the vectors with the least hashes, so the same vectors give the same pivots.
    """
    drawn = _directed(vectors, "vec_id").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    if not drawn:
        return np.zeros((0, 0))
    x = np.array([r["v"] for r in drawn], float)
    norms = np.sqrt((x * x).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    x = x[good] / norms[good, None]
    centres = x[:: max(1, len(x) // pivots)][:pivots].copy()
    for _ in range(8 if len(x) else 0):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.sqrt((sums * sums).sum(1))
        kept = norms > 1e-9
        centres[kept] = sums[kept] / norms[kept, None]
    return centres


def _directed(rows: DataFrame, name: str) -> DataFrame:
    """(id, v, part, whole) of rows that have an id and a vector."""
    part = F.coalesce("part", F.lit("")) if "part" in rows.columns else F.lit("")
    whole = F.col("whole").cast("double") if "whole" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), part.alias("part"), whole.alias("whole")).where(F.col("v").isNotNull() & F.col("id").isNotNull())


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((x / np.sqrt((x * x).sum(1))[:, None]) @ centres.T, -1, 1))


def _located(rows: DataFrame, name: str, centres: np.ndarray) -> DataFrame:
    """(part, pivot, angle, id, norm, share, data) of vectors with a direction; ``norm`` is of the whole."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            norms = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
            x, norms, kept = x[good], norms[good], batch.take(pa.array(good))
            angles = _angles(x, centres)
            pivot = angles.argmin(1)
            whole = kept.column(3).to_numpy(zero_copy_only=False).astype(float)
            whole = np.where(np.isnan(whole), norms, whole)
            yield pa.RecordBatch.from_pydict({
                "part": kept.column(2), "pivot": pa.array(pivot, pa.int32()), "angle": pa.array(angles[np.arange(len(x)), pivot], pa.float64()), "id": kept.column(0),
                "norm": pa.array(whole), "share": pa.array(norms / whole), "data": pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary()),
            })

    return _directed(rows, name).mapInArrow(locate, "part string, pivot int, angle double, id long, norm double, share double, data binary")


def _packed(located: DataFrame, block: int) -> DataFrame:
    """Located vectors as ``BLOCKS``. Ranges of part, pivot, angle and id are dealt out, so a pivot with very many vectors, or copies, is many tasks' work."""
    tag = uuid.uuid4().hex[:12]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, rest = TaskContext.get().partitionId(), 0, None

        def row(rows: pa.Table) -> pa.RecordBatch:
            angles = rows.column("angle").to_numpy()
            values = {
                "block": f"{tag}-{task}-{made}", "lo": float(angles[0]), "hi": float(angles[-1]), "share": float(rows.column("share").to_numpy().max()), "vec_ids": rows.column("id").to_numpy(),
                "norms": rows.column("norm").to_numpy(), "data": b"".join(rows.column("data").to_pylist()), "part": rows.column("part")[0].as_py(), "pivot": rows.column("pivot")[0].as_py(),
            }
            return pa.RecordBatch.from_pydict({c: pa.array([v], _ARROW.field(c).type) for c, v in values.items()})

        def cut(table: pa.Table, last: bool) -> Iterator[pa.Table]:
            """Runs of one part and pivot, of at most ``block`` rows; keeps the last unless there is no more."""
            nonlocal rest
            part, pivot = table.column("part").to_numpy(), table.column("pivot").to_numpy()
            starts = [*np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (pivot[1:] != pivot[:-1])]).tolist(), len(pivot)]
            for a, b in zip(starts, starts[1:]):
                for c in range(a, b, block):
                    if min(c + block, b) == len(pivot) and not last:
                        rest = table.slice(c)
                    else:
                        yield table.slice(c, min(block, b - c))

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                for rows in cut(pa.concat_tables([rest, table]) if rest is not None else table, False):
                    yield row(rows)
                    made += 1
        if rest is not None:
            yield row(rest)

    order = ["part", "pivot", "angle", "id"]
    return located.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS)


class VectorStore:
    """The index under ``path``: ``pivots`` and, partitioned by part and pivot, ``blocks``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> VectorStore:
        """Store vectors (vec_id, embedding, and part or whole if they have such)."""
        store = cls(vectors.sparkSession, path)
        rows = [(i, c.tolist()) for i, c in enumerate(choose_pivots(vectors, pivots, sample))]
        store.spark.createDataFrame(rows, "pivot int, centre array<double>").coalesce(1).write.parquet(f"{store.path}/pivots")
        store.add(vectors, block)
        return store

    def add(self, vectors: DataFrame, block: int = BLOCK) -> None:
        """Store more vectors around the same pivots; a store made of no vectors has none and stays empty."""
        centres = self.centres()
        located = _located(vectors if len(centres) else vectors.limit(0), "vec_id", centres)
        _packed(located, block).write.mode("append").partitionBy("part", "pivot").parquet(f"{self.path}/blocks")

    def centres(self) -> np.ndarray:
        rows = self.spark.read.schema("pivot int, centre array<double>").parquet(f"{self.path}/pivots").orderBy("pivot").collect()
        return np.array([r["centre"] for r in rows], float)

    def blocks(self) -> DataFrame:
        rows = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")
        return rows.withColumn("part", F.coalesce("part", F.lit("")))  # an empty name of a folder is read as null

    def _asked(self, queries: DataFrame, block: int) -> DataFrame:
        centres = self.centres()
        packed = _packed(_located(queries if len(centres) else queries.limit(0), "query_id", centres), block)
        # names of blocks must be the same wherever they are read
        return materialize(packed.select("part", F.col("block").alias("asked"), F.col("share").alias("asked_share"), F.col("vec_ids").alias("query_ids"), F.col("norms").alias("query_norms"), F.col("data").alias("query_data")), "asked")

    def _reached(self, asked: DataFrame, threshold: float) -> DataFrame:
        """(part, pivot, block, asked) of the stored blocks that may hold a neighbour of a query of a block."""
        centres = self.centres()

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, name, share, ids, data in zip(*batch.columns):
                    angles = _angles(np.frombuffer(data.as_py(), "<f8").reshape(len(ids), -1), centres)
                    n = len(centres)
                    yield pa.RecordBatch.from_pydict({"part": [part.as_py()] * n, "asked": [name.as_py()] * n, "asked_share": [share.as_py()] * n, "pivot": pa.array(range(n), pa.int32()), "near": angles.min(0), "far": angles.max(0)})

        spans = asked.select("part", "asked", "asked_share", "query_ids", "query_data").mapInArrow(reach, "part string, asked string, asked_share double, pivot int, near double, far double")
        return spans.join(self.blocks().select("part", "pivot", "block", "lo", "hi", "share"), ["part", "pivot"]).where(_may_meet(threshold)).select("part", "pivot", "block", "asked")

    def search(self, queries: DataFrame, k: int = config.TOP_K, threshold: float = config.DISTANCE_THRESHOLD, block: int = QUERY_BLOCK) -> DataFrame:
        """The ``k`` nearest vectors (query_id, vec_id, dist, rn) of queries (query_id, embedding) nearer than ``threshold``, exactly."""
        return top_k(self.near(queries, k, threshold, block), ["vec_id"], k, threshold)

    def near(self, queries: DataFrame, k: int, threshold: float, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, vec_id, dist): of each pair of blocks the ``k`` nearest of each query under ``threshold``."""
        asked = self._asked(queries, block)
        sent = self._reached(asked, threshold).join(asked.drop("part", "asked_share"), "asked").drop("asked")
        place = ["part", "pivot", "block"]
        # a stored block, then the queries that reach it: only queries are sent more than once
        stored = self.blocks().select(*place, "vec_ids", "norms", "data")
        met = stored.join(sent.select(*place).distinct(), place, "left_semi").unionByName(sent, allowMissingColumns=True)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = norms = x = None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                    if row["data"].is_valid:
                        ids, norms = row["vec_ids"].values.to_numpy(), row["norms"].values.to_numpy()
                        x = np.frombuffer(row["data"].as_py(), "<f8").reshape(len(ids), -1)
                        continue
                    query_ids, query_norms = row["query_ids"].values.to_numpy(), row["query_norms"].values.to_numpy()
                    q = np.frombuffer(row["query_data"].as_py(), "<f8").reshape(len(query_ids), -1)
                    yield _nearest(query_ids, ids, np.round(1 - q @ x.T / np.outer(query_norms, norms), 6), k, threshold)

        ordered = met.repartition(*place).sortWithinPartitions(*place, F.col("data").isNull())
        return ordered.select("vec_ids", "norms", "data", "query_ids", "query_norms", "query_data").mapInArrow(multiply, "query_id long, vec_id long, dist double")

    def skipped(self, queries: DataFrame, threshold: float = config.DISTANCE_THRESHOLD, block: int = QUERY_BLOCK) -> DataFrame:
        """(part, pairs, met): pairs of query blocks and stored blocks, and those that a search compares."""
        asked = self._asked(queries, block)
        met = self._reached(asked, threshold).groupBy("part").agg(F.count("*").alias("met"))
        sides = asked.groupBy("part").agg(F.count("*").alias("a")).join(self.blocks().groupBy("part").agg(F.count("*").alias("b")), "part")
        return sides.join(met, "part", "left").select("part", (F.col("a") * F.col("b")).alias("pairs"), F.coalesce("met", F.lit(0)).alias("met"))


def _may_meet(threshold: float) -> Column:
    """Whether angles of queries to a pivot (near to far) and of a block's vectors (lo to hi) leave room for a neighbour."""
    least = F.lit(1 - threshold - 1e-6)
    # of whole vectors the parts' cosine counts only as much as both shares allow
    cosine = F.when(least > 0, least / (F.col("share") * F.col("asked_share") * (1 + 1e-9))).otherwise(F.greatest(least, F.lit(-1.0)))
    cap = F.acos(F.least(cosine, F.lit(1.0))) + SLACK
    return (cosine <= 1 + 1e-9) & (F.col("lo") <= F.col("far") + cap) & (F.col("hi") >= F.col("near") - cap)


def _nearest(query_ids: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int, threshold: float) -> pa.RecordBatch:
    """Of a matrix of distances each row's best k below the cap, ties by id."""
    dist[np.abs(dist) < 1e-6] = 0.0
    rows, columns = np.nonzero(dist < threshold)
    order = np.lexsort((ids[columns], dist[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    rows, columns = rows[place < k], columns[place < k]
    return pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[rows], pa.int64()), "vec_id": pa.array(ids[columns], pa.int64()), "dist": pa.array(dist[rows, columns], pa.float64())})


