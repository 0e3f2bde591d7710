"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance ``radius`` or less have a common variant within half the radius of
each (of an odd radius: within the smaller half of one and the larger half of the other). Every distinct fingerprint goes to each prefix that such a variant of it can have; that is
the shuffle on variants, one row for all variants of a prefix. There all its variants with the
prefix are made and sorted, equal ones collide, the pairs are deduplicated and verified, and a
spanning forest of the verified links is kept. Stars of links are then contracted to components.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Repeated
rows and equal fingerprints are one component. A component of null ids alone has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.runtime import free, hot, id_text, join_hot, materialize

BITS = 64
SEED = 42
#: Distinct fingerprints whose own prefix it is, on average, and the fewest bits of a prefix. The rows sent
#: grow with the bits; the work for a prefix does not depend on them, it is parted as far as memory asks.
TO_A_PREFIX, LEAST_BITS = 1 << 15, 7
#: Variants a worker holds at once; a fuller prefix is worked through in longer prefixes.
AT_ONCE = 1 << 21


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 of word shingles of the text with A-Z lower-cased."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    rows = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    over = 2 * np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, flips: int) -> np.ndarray:
    """All ways to flip at most ``flips`` of the lowest ``bits`` bits."""
    found, last = [np.zeros(1, np.uint64)], {(-1, 0)}
    for _ in range(flips):
        last = {(k, m | 1 << k) for low, m in last for k in range(low + 1, bits)}
        found.append(np.array([m for _, m in last], np.uint64))
    return np.concatenate(found)


def collisions(fps: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) between fingerprints with a common variant of this prefix.

    Those within the smaller half of the radius of a variant are its core: they are within the
    radius of each other and of all who share the variant. Linking each to the least of the core
    loses no component; for an even radius all belong to the core.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    flips, low = (radius + 1) // 2, BITS - bits
    off = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)) if bits else np.zeros(len(fps), np.uint8)
    fps, left = fps[off <= flips], flips - off[off <= flips].astype(int)
    if len(fps) < 2:
        return none
    size = sum(int((left == r).sum()) * sum(math.comb(low, k) for k in range(r + 1)) for r in range(flips + 1))
    if size > AT_ONCE and low > flips:
        both = [collisions(fps, 2 * prefix + b, bits + 1, radius) for b in (0, 1)]
        return np.concatenate([both[0][0], both[1][0]]), np.concatenate([both[0][1], both[1][1]])
    variants, owners = [], []
    keep = np.uint64((1 << low) - 1) if low < 64 else np.uint64(2**64 - 1)
    base = (fps & keep) | np.uint64(prefix << low if low < 64 else 0)
    for r in range(flips + 1):
        own = np.flatnonzero(left == r)
        if len(own):
            m = masks(low, r)
            variants.append((base[own][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(own, len(m)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    ranked = np.sort(variants)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return none
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    inside = twice[np.minimum(np.searchsorted(twice, variants), len(twice) - 1)] == variants
    variants, owners = variants[inside], fps[owners[inside]]
    rim = np.bitwise_count(variants ^ owners) > radius // 2
    order = np.lexsort((owners, rim, variants))
    variants, owners, rim = variants[order], owners[order], rim[order]
    head = np.r_[True, variants[1:] != variants[:-1]]
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    linked = ~head & ~rim[first]
    pairs = np.stack([owners[linked], owners[first][linked]], 1)
    pairs = np.unique(np.stack([pairs.max(1, initial=0), pairs.min(1, initial=np.uint64(2**64 - 1))], 1), axis=0)
    near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius
    return pairs[near, 0], pairs[near, 1]


def forest(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As links to the least member of each component of some links."""
    nodes, index = np.unique(np.concatenate([high, low]), return_inverse=True)
    a, b = index[: len(high)], index[len(high) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(distinct: DataFrame, count: int, radius: int) -> DataFrame:
    """Links (high, low) that connect all of ``distinct`` (column fp) within ``radius`` bits."""
    flips = (radius + 1) // 2
    bits = max(LEAST_BITS, min(24, math.ceil(math.log2(max(2, count) / TO_A_PREFIX))))
    prefix = F.shiftrightunsigned("fp", BITS - bits).cast("int")
    ways = F.array(*[F.lit(int(m)) for m in masks(bits, flips)])
    sent = distinct.select("fp", F.explode(F.transform(ways, lambda m: m.bitwiseXOR(prefix))).alias("prefix"))

    def collide(frame: pd.DataFrame) -> pd.DataFrame:
        high, low = collisions(frame["fp"].to_numpy(np.int64).view(np.uint64), int(frame["prefix"].iloc[0]), bits, radius)
        if len(high):
            high, low = forest(high, low)
        return pd.DataFrame({"high": high.view(np.int64), "low": low.view(np.int64)})

    return sent.groupBy("prefix").applyInPandas(collide, "high long, low long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Every node of some edges (high, low) with the least node it can reach, itself excepted.

    Alternating large and small stars: each round links neighbours to the least one among them,
    until every component is one star. A node with very many neighbours is joined without a shuffle.
    """
    edges = edges.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).where("high <> low").distinct()
    edges, before, old = materialize(edges, "cc"), None, []
    while True:
        free(*old)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return edges
        before = state
        around = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = around.groupBy("high").agg(F.least("high", F.min("low")).alias("least"), F.count("*").alias("held"))
        least = materialize(least, "cc-least")
        large = join_hot(around.where("low > high"), least, ["high"], hot(least, "held", 2 * state["n"]))
        large = large.select(F.col("low").alias("high"), F.col("least").alias("low")).where("high <> low").distinct()
        large = materialize(large, "cc-large")
        lowest = materialize(large.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("held")), "cc-lowest")
        others = join_hot(large, lowest, ["high"], hot(lowest, "held", state["n"])).where("low <> least")
        others = others.select(F.col("low").alias("high"), F.col("least").alias("low"))
        old = [edges, large, least, lowest]
        edges = materialize(others.unionByName(lowest.select("high", F.col("least").alias("low"))).distinct(), "cc")


def clusters(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    names = named(marked, radius)
    found = join_hot(marked, names, ["fp"], hot(names, "held", marked.count()))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named(marked: DataFrame, radius: int, name: str = "doc_id") -> DataFrame:
    """fp, component_id (the least ``name`` of all documents whose fingerprint is reachable) and held (rows of this fp)."""
    distinct = materialize(marked.groupBy("fp").agg(F.min(name).alias("least"), F.count("*").alias("held")), "simhash-distinct")
    count = distinct.count()
    roots = components(links(distinct.select("fp"), count, radius))
    member = distinct.join(roots, distinct.fp == roots.high, "left").select("fp", "least", "held", F.coalesce("low", "fp").alias("root"))
    member = materialize(member, "simhash-roots")
    best = materialize(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("kinds")), "simhash-best")
    found = join_hot(member, best, ["root"], hot(best, "kinds", count)).select("fp", "component_id", "held")
    return materialize(found, "simhash-named")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, that of the least id; all columns as they are."""
    columns = docs.columns
    fields = [f"`{c}`" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            found = np.array([fingerprint(t or "", shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield batch.append_column("__fp", pa.array(found))

    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("__fp", T.LongType())])
    stored = materialize(rows.mapInArrow(run, schema), "simhash-rows")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("__row").alias("row"))
    marked = stored.select(F.col("__fp").alias("fp"), ident.alias("ident"))
    kept = named(marked, radius, "ident").select("component_id.row").distinct()
    return stored.join(kept, stored["__row"] == kept["row"], "left_semi").select(*fields)
