"""Best-fit packing of token sequences by a grouping genetic algorithm on distributed islands.

Pieces are dealt by a hash into blocks of bounded size. In each block several islands keep a
population of packings, first made by best fit in orders that are decreasing, blurred or random.
Crossover injects whole well-filled bins of one parent, keeps such bins of the other that hold no
piece already placed, and best-fits the displaced pieces; a better child takes the worst place.
An island stops when some generations gain nothing; between epochs it sends its best packing to
the next one. Bins that stay badly filled give their pieces back; these few are pooled over all
blocks and packed again, until one block is left, the lower bound is met or a round gains
nothing. Nothing but counts reaches the driver.

Defined results: a null text is an empty text, and every text ends with the end id, so the
shortest piece has one token. Repeated rows and repeated or null ids are separate documents.
An empty table gives an empty result. Input columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import tokens
from heronry.llm.runtime import id_text, materialize

#: Pieces a block holds on average; bounds the memory of one island and the time of one task.
BLOCK = 6000
ISLANDS = 3
EPOCHS = 2
#: Islands that one task evolves, one after the other.
TO_A_TASK = 12
#: Of an epoch: the most generations, and those without gain that end it.
GENERATIONS = 12
PATIENCE = 5
POPULATION = 10
#: A bin with a larger share of unused places gives its pieces to the next round.
SLACK = 0.01
#: A round that saves a smaller share of the bins of its pool is the last.
LEAST_GAIN = 0.001
#: How much an order by decreasing size is blurred (1: all but random), and the unused share up to which
#: a bin counts as well filled; crossover draws from both.
BLURS = (0.0, 0.1, 0.3, 1.0)
SLACKS = (0.0, 0.002, 0.005, SLACK)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenise whole texts and cut only those longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, wide = tokens.load(tokenizer), struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), uid))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = id_text(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return rows.mapInArrow(run, PIECES)


class Packing:
    """Bins with a best-fit index: the open bins of each remaining space, and a bit set of spaces in use."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.space: list[int] = []
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def _file(self, b: int) -> None:
        s = self.space[b]
        self.open[s].append(b)
        self.mask |= 1 << s

    def inject(self, items: list[int]) -> None:
        self.bins.append(list(items))
        self.space.append(self.capacity - sum(self.sizes[i] for i in items))
        self._file(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Each item, in this order, goes where it leaves the least space."""
        sizes, space, opened = self.sizes, self.space, self.open
        for i in items:
            above = self.mask >> sizes[i]
            if above:
                s = sizes[i] + (above & -above).bit_length() - 1
                b = opened[s].pop()
                if not opened[s]:
                    self.mask ^= 1 << s
                self.bins[b].append(i)
                space[b] -= sizes[i]
                self._file(b)
            else:
                self.inject([i])

    def labels(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), "<i4")
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def fitness(sizes: np.ndarray, labels: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins, which rewards few and full bins over many even ones."""
    fill = np.bincount(labels, sizes) / capacity
    return float((fill**2).sum() / len(fill))


def groups(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    edges = np.flatnonzero(np.diff(labels[order])) + 1
    return [g.tolist() for g in np.split(order, edges)] if len(labels) else []


def blurred(sizes: list[int], items: list[int], blur: float, rng: random.Random) -> list[int]:
    """The items by decreasing size, each size taken for up to ``blur`` more or less than it is."""
    key = {i: sizes[i] * (1 + blur * (2 * rng.random() - 1)) for i in items}
    return sorted(items, key=key.get, reverse=True)


def crossover(sizes: list[int], capacity: int, a: np.ndarray, b: np.ndarray, rng: random.Random) -> np.ndarray:
    """A child with well-filled bins of ``a``, those of ``b`` free of duplicates, and the rest best-fitted."""
    child, placed = Packing(sizes, capacity), set()
    least = capacity * (1 - rng.choice(SLACKS))
    for g in groups(a):
        if sum(sizes[i] for i in g) >= least and rng.random() < 0.8:
            child.inject(g)
            placed.update(g)
    displaced = []
    for g in groups(b):
        if placed.isdisjoint(g) and sum(sizes[i] for i in g) >= least:
            child.inject(g)
        else:  # a duplicate or a poor bin: what is not placed yet is displaced
            displaced += [i for i in g if i not in placed]
    child.best_fit(blurred(sizes, displaced, rng.choice(BLURS), rng))
    return child.labels()


def lower_bound(sizes: list[int], capacity: int) -> int:
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: list[int], capacity: int, population: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """Some generations of one island, best packing first.

    Ends early when nothing can be gained: as few bins as the lower bound, all but one well filled.
    """
    rng, known = random.Random(seed), np.array(sizes, float)
    score = lambda p: (-int(p.max(initial=-1)), fitness(known, p, capacity))
    if not population:
        for k in range(POPULATION):
            first = Packing(sizes, capacity)
            first.best_fit(blurred(sizes, list(range(len(sizes))), BLURS[(k + seed) % len(BLURS)], rng))
            population.append(first.labels())
    least = lower_bound(sizes, capacity)
    ranked = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    idle = 0
    for generation in range(GENERATIONS if sizes else 0):
        best = ranked[0][2]
        poor = int((np.bincount(best, known) < capacity * (1 - SLACK)).sum())
        if idle == PATIENCE or best.max() + 1 <= least and poor <= 1:
            break
        a = ranked[min(rng.randrange(len(ranked)), rng.randrange(len(ranked)))][2]
        child = crossover(sizes, capacity, a, ranked[rng.randrange(len(ranked))][2], rng)
        value = score(child)
        idle = 0 if value > ranked[0][0] else idle + 1
        if all(value != r[0] for r in ranked):
            ranked = sorted([*ranked, (value, POPULATION + ISLANDS + generation, child)], key=lambda x: x[:2], reverse=True)
    return [p for _, _, p in ranked[:POPULATION]]


ISLAND = "block long, island int, sizes binary, population array<binary>"


def epoch(islands: DataFrame, capacity: int, number: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, island, raw, population in frame.itertuples(index=False):
                sizes = np.frombuffer(raw, "<i4").tolist()
                seed = (int(block) * 1009 + int(island)) * 31 + number
                found = evolve(sizes, capacity, [np.frombuffer(p, "<i4") for p in population], seed)
                yield pd.DataFrame({"block": [block], "island": [island], "sizes": [raw], "population": [[p.astype("<i4").tobytes() for p in found]]})

    return islands.mapInPandas(run, ISLAND)


def migrate(islands: DataFrame) -> DataFrame:
    """Each island receives the best packing of the island before it."""
    elite = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("population", 1, 1).alias("guest"))
    return islands.join(elite, ["block", "island"]).select("block", "island", "sizes", F.concat("population", "guest").alias("population"))


def _round(pool: DataFrame, capacity: int, number: int, blocks: int) -> DataFrame:
    """Pack one pool: every piece with ``sequence_id``, ``offset`` and whether its bin is well filled."""
    where = F.pmod(F.xxhash64("uid", "piece", F.lit(number)), F.lit(blocks)).alias("block")
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", "uid")
    rows = pool.groupBy(where).agg(F.collect_list(item).alias("items"))
    grouped = materialize(rows, f"pack-blocks-{number}")

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, lengths in frame.itertuples(index=False):
                raw = np.asarray(lengths, "<i4").tobytes()
                for island in range(ISLANDS):
                    yield pd.DataFrame({"block": [block], "island": [island], "sizes": [raw], "population": [[]]})

    state = grouped.select("block", F.col("items.length").alias("lengths")).mapInPandas(seed, ISLAND)
    tasks = max(1, -(-blocks * ISLANDS // TO_A_TASK))  # a number that stays: islands are small in bytes but not in work
    for e in range(EPOCHS):
        state = (state if e == 0 else migrate(state)).repartition(tasks, "block", "island")
        state = materialize(epoch(state, capacity, 100 * number + e), f"pack-islands-{number}-{e}")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, _, raw, population in frame.itertuples(index=False):
                sizes, labels = np.frombuffer(raw, "<i4").astype("i8"), np.frombuffer(population[0], "<i4")
                order = np.argsort(labels, kind="stable")
                ends = np.cumsum(sizes[order])
                begins = ends - sizes[order]
                first = np.r_[True, np.diff(labels[order]) > 0]
                offset = np.empty(len(sizes), "i8")
                offset[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
                fill = np.bincount(labels, sizes)
                done = (fill >= capacity * (1 - SLACK))[labels]
                yield pd.DataFrame({"block": [block], "bin": [labels.astype("i8")], "offset": [offset], "done": [done]})

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [(np.frombuffer(r, "<i4").astype(float), np.frombuffer(p[0], "<i4")) for r, p in zip(frame.sizes, frame.population)]
            yield frame.assign(score=[(int(l.max(initial=-1)) + 1) - fitness(s, l, capacity) for s, l in best])

    scored = state.mapInPandas(rate, ISLAND + ", score double")
    chosen = scored.groupBy("block").agg(F.min_by(F.struct("block", "island", "sizes", "population"), F.struct("score", "island")).alias("b")).select("b.*")
    placed = chosen.mapInPandas(place, "block long, bin array<long>, offset array<long>, done array<boolean>")
    flat = grouped.join(placed, "block").select("block", F.explode(F.arrays_zip("items", "bin", "offset", "done")).alias("p"))
    name = F.col("block") * F.lit(1 << 20) + F.col("p.bin") + F.lit(number << 52)
    out = flat.select("p.items.*", name.alias("sequence_id"), "p.offset", "p.done")
    return materialize(out, f"pack-placed-{number}")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents as pieces with their sequence and place in it.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A piece that fills a
    sequence needs no partner and gets one of its own at once.
    """
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    full = F.col("length") == capacity
    own = -F.monotonically_increasing_id() - 1  # of the table as written: one for each of its rows
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    parts = [pieces.where(full).select(*columns[:5], own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, before = pieces.where(~full), None
    for number in range(1, 40):
        blocks = max(1, round(pool.count() / BLOCK))
        placed = _round(pool, capacity, number, blocks)
        # each bin has one piece at offset 0
        opens, poor = F.col("offset") == 0, ~F.col("done")
        counted = placed.agg(F.count_if(opens), F.count_if(opens & poor), F.sum(F.when(poor, F.col("length"))), F.count_if(poor & (2 * F.col("length") > capacity)))
        bins, left, used, large = counted.first()
        gained = before is None or bins < before * (1 - LEAST_GAIN)
        if blocks == 1 or left <= max(-(-(used or 0) // capacity), large) or not gained:
            parts.append(placed.select(*columns))
            break
        parts.append(placed.where("done").select(*columns))
        pool, before = placed.where("not done").select("doc_id", "piece", "start", "length", "ids_crc32", "uid"), left
    else:
        raise RuntimeError("pieces are left after the last round of packing")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
