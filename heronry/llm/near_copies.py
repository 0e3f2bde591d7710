"""Near copies: SimHash links, and all pairs whose word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints collide by ball hashing, as in ``simhash``. Similar pairs beyond its radius
are reached by prefix filtering, which loses nothing: of two sets of which each holds 4/5 of the
other, the first fifth and one more of their shingles, in one order for the whole corpus, have one
in common. The order puts shingles that many texts of a sample hold last; any order gives the same
result. Texts that meet at a shingle form a list, which is cut where sizes are too far apart; equal
lists are worked through once. Parity sketches, a bit for each shingle or more, part a list without
loss, and every pair of what still hangs together is compared exactly unless already connected. Of
a small family, connected by lists, each set is sent to the comparison once and not with every list.

Defined results: a null or empty text has no shingles; all such are copies of each other. A text
of fewer words than a shingle is one shingle. Repeated rows and equal sets are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.runtime import free, hot, join_hot, key_runs, materialize, sift, slices
from heronry.llm.simhash import SEED, components, fingerprint, forest, links

#: Texts, about, whose shingles tell which are frequent, and the most of them that are kept.
SAMPLE = 10_000
MOST_FREQUENT = 100_000
#: Texts of a list compared at once; a longer list is compared block by block, every pair of blocks.
BLOCK = 2048
#: Sets of a family, all that lists connect, up to which it is compared as one list.
FAMILY = 64


MARKS = {"__sid": T.LongType(), "__check": T.LongType(), "__size": T.LongType(), "__sketch": T.BinaryType(), "__fp": T.LongType()}


def shingles(text: str, shingle: int) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, A-Z lower-cased, in ascending order."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends[shingle - 1 :].tolist())]
    return np.unique(np.array(hashes, np.uint64))


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a set has one in common with every set of similarity 0.8 or more."""
    n = len(found)
    if not n:
        return found
    seen = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        seen = np.where(frequent[at] == found, counts[at], 0)
    return found[np.lexsort((found, seen))][: n - (4 * n + 4) // 5 + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 5 * common >= 4 * (len(both) - common)


def names_of(found: np.ndarray, salt: int) -> tuple[int, int]:
    """A set's name, a hash whose first bits grow with the size, one step for a tenth more; and 64 bits to check names by."""
    import xxhash

    step = min(127, int(math.log(max(1, len(found))) / math.log(1.1)))
    digest = xxhash.xxh3_128_intdigest(found.tobytes(), salt)
    return step << 56 | digest >> 72, (digest & (1 << 64) - 1) - (1 << 63)


def sketch(found: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each of so many bits: a power of two, no less than their number.

    Two sets differ in at least as many shingles as their sketches in bits, the longer one folded.
    """
    bits = max(256, 1 << (len(found) - 1).bit_length()) if len(found) else 256
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def hanging(sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """A label for each set: those connected by pairs that may be similar, by size and sketch, share one."""
    n, label, folded = len(sizes), np.arange(len(sizes)), {}
    words = np.array([len(x) // 8 for x in sketches])

    def rows(width: int) -> np.ndarray:
        """All sketches of this width or more, folded to it."""
        if width not in folded:
            folded[width] = np.zeros((n, width), np.uint64)
            for k, x in enumerate(sketches):
                if width <= words[k]:
                    folded[width][k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0)
        return folded[width]

    for k in range(1, n):
        fits = (label[:k] != label[k]) & (5 * np.minimum(sizes[:k], sizes[k]) >= 4 * np.maximum(sizes[:k], sizes[k]))
        at = np.flatnonzero(fits)
        for width in np.unique(np.minimum(words[at], words[k])):
            some = at[np.minimum(words[at], words[k]) == width]
            table = rows(int(width))
            differ = np.bitwise_count(table[some] ^ table[k]).sum(axis=1, dtype=np.int64)
            for other in np.unique(label[some[9 * differ <= sizes[some] + sizes[k]]]):
                label[label == other] = label[k]
    return label


def linked(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (high, low) that connect all pairs of a list that are similar."""
    n, sizes = len(ids), np.array([len(s) for s in sets])
    label, high, low = np.arange(n), [], []
    for k in range(1, n):
        at = np.flatnonzero(5 * np.minimum(sizes[:k], sizes[k]) >= 4 * np.maximum(sizes[:k], sizes[k]))
        while len(at):
            if similar(sets[at[0]], sets[k]):
                high.append(k)
                low.append(at[0])
                label[label == label[k]] = label[at[0]]
                at = at[label[at] != label[k]]
            else:
                at = at[1:]
    return ids[high], ids[low]


def frequencies(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more texts of a sample hold, and how many hold them."""
    total = max(1, rows.count())
    share = min(1 << 30, (1 << 30) * SAMPLE // total)
    chosen = rows.where(F.pmod(F.xxhash64("sid", F.lit(6)), F.lit(1 << 30)) <= share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t or "", shingle) for t in batch.column(1).to_pylist()]
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    counted = chosen.select("sid", "text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = counted.where("n > 2").orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    token, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def lists(rows: DataFrame, shingle: int) -> DataFrame:
    """unit, sid: the distinct lists of sets that meet at a shingle of their prefixes."""
    frequent, counts = frequencies(rows, shingle)
    known = rows.sparkSession.sparkContext.broadcast((frequent, counts))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # copies are sent once
            found = [prefix(shingles(t or "", shingle), *known.value) for t in batch.column(1).take(pa.array(first)).to_pylist()]
            token = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            sid = np.repeat(own, [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(sid)], ["token", "sid"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for _, table in key_runs(batches):
            token, sid = table.column(0).to_numpy(), table.column(1).to_numpy()
            new = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]
            token, sid = token[new], sid[new]
            far = (sid[1:] >> 56) - (sid[:-1] >> 56) > 3  # more than a quarter larger
            starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | far])
            ends = np.r_[starts[1:], len(token)]
            many = ends - starts > 1
            found = {sid[a:b].tobytes() for a, b in zip(starts[many].tolist(), ends[many].tolist())}
            unit = [xxhash.xxh64_intdigest(f) - (1 << 63) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(list(found), pa.binary())], ["unit", "members"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            units, sids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for unit, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sid = np.frombuffer(raw, np.int64)
                blocks = [sid[at : at + BLOCK] for at in range(0, len(sid), BLOCK)]
                pairs = [[sid]] if len(blocks) < 3 else [[x, y] for k, x in enumerate(blocks) for y in blocks[k + 1 :]]
                for k, pair in enumerate(pairs):
                    sids += pair
                    name = unit if len(pairs) == 1 else xxhash.xxh64_intdigest(b"%d %d" % (unit, k)) - (1 << 63)
                    units.append(np.full(sum(map(len, pair)), name, np.int64))
                if sum(map(len, units)) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(units)), pa.array(np.concatenate(sids))], ["unit", "sid"])
                    units, sids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(units)), pa.array(np.concatenate(sids))], ["unit", "sid"])

    sent = rows.select("sid", "text").mapInArrow(send, "token long, sid long")
    met = sent.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(meet, "unit long, members binary")
    return met.groupBy("unit").agg(F.first("members").alias("members")).mapInArrow(deal, "unit long, sid long")


def collided(sets: DataFrame, radius: int) -> DataFrame:
    """Links (high, low) between sets whose SimHash fingerprints are equal or collide."""
    distinct = materialize(sets.groupBy("fp").agg(F.min("sid").alias("first"), F.count("*").alias("held")), "near-fingerprints")
    met = links(distinct.select("fp"), distinct.count(), radius)
    a, b = (distinct.select(F.col("fp").alias(c), F.col("first").alias(s)) for c, s in (("high", "a"), ("low", "b")))
    same = join_hot(sets.select("fp", "sid"), distinct, ["fp"], hot(distinct, "held", sets.count())).where("sid <> first").select(F.col("sid").alias("high"), F.col("first").alias("low"))
    return met.join(a, "high").join(b, "low").select(F.col("a").alias("high"), F.col("b").alias("low")).unionByName(same)


def parted(members: DataFrame, sets: DataFrame) -> DataFrame:
    """unit, sid: the distinct parts of the lists that hang together by sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for starts, table in key_runs(batches):
            sid, size, marks = table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3)
            found = set()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sid)]):
                label = hanging(size[a:b], marks.slice(a, b - a).to_pylist())
                order = np.argsort(label, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                    if len(part) > 1:
                        found.add(np.sort(sid[a:b][part]).tobytes())
            unit = [xxhash.xxh64_intdigest(f) - (1 << 63) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(list(found), pa.binary())], ["unit", "members"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
            unit = np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))], ["unit", "sid"])

    marked = members.join(sets.select("sid", "size", "sketch").dropDuplicates(["sid"]), "sid").select("unit", "sid", "size", "sketch")
    met = marked.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "unit long, members binary")
    return met.groupBy("unit").agg(F.first("members").alias("members")).mapInArrow(flat, "unit long, sid long")


def gathered(members: DataFrame) -> DataFrame:
    """unit, sid: the lists of each small family as one, so that each of its sets is sent once; larger families keep their lists."""
    least = members.groupBy("unit").agg(F.min("sid").alias("low"))
    roots = components(members.join(least, "unit").select(F.col("sid").alias("high"), "low"))
    sizes = materialize(roots.groupBy("low").agg((F.count("*") + 1).alias("held")), "near-families")
    named = roots.select("high", "low").unionByName(sizes.select(F.col("low").alias("high"), "low"))
    known = join_hot(named, sizes, ["low"], hot(sizes, "held", named.count())).select(F.col("high").alias("sid"), "low", "held")
    unit = F.when(F.col("held") <= FAMILY, F.col("low")).otherwise(F.col("unit")).alias("unit")
    return members.join(known, "sid").select(unit, "sid").distinct()


def verified(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Links (high, low) between the sets of every unit that are similar."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t or "", shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["sid", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, table in key_runs(batches):
            sid, raw = table.column(1).to_numpy(), table.column(2)
            high, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sid)]):
                if b - a > 1:
                    found = linked(sid[a:b], [np.frombuffer(r, np.uint64) for r in raw.slice(a, b - a).to_pylist()])
                    high.append(found[0])
                    low.append(found[1])
            one, two = np.concatenate(high), np.concatenate(low)
            if len(one):
                one, two = forest(one, two)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["high", "low"])

    sets = materialize(texts.select("sid", "text").mapInArrow(read, "sid long, hashes binary"), "near-sets")
    held = members.join(sets, "sid").select("unit", "sid", "hashes")
    found = held.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "high long, low long").distinct()
    found = materialize(found, "near-links")
    free(sets)
    return found


def keep_one(docs: DataFrame, shingle: int = 5, digest: int = 4, radius: int = 4, salt: int = 0) -> DataFrame:
    """One row of each component, that of the least id; all columns as they are.

    ``shingle`` words are compared exactly, ``digest`` words make the fingerprints. Sets are told
    apart by 128 bits: if a name of 63 bits is held by sets that differ in the others, all sets
    are named anew with another ``salt``.
    """
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [shingles(t, shingle) for t in texts]
            fp = np.array([fingerprint(t, digest) for t in texts], np.uint64).view(np.int64)
            names = [names_of(f, salt) for f in found]
            batch = batch.append_column("__sid", pa.array([a for a, _ in names], pa.int64())).append_column("__check", pa.array([b for _, b in names], pa.int64()))
            batch = batch.append_column("__size", pa.array([len(f) for f in found], pa.int64()))
            yield batch.append_column("__sketch", pa.array([sketch(f) for f in found], pa.binary())).append_column("__fp", pa.array(fp))

    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in MARKS.items()]])
    stored = materialize(rows.mapInArrow(run, schema), "near-rows")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("__row").alias("row"))
    first = [F.min(ident).alias("least"), F.min("__row").alias("row"), F.first("__size").alias("size"), F.first("__sketch").alias("sketch"), F.min("__check").alias("check"), F.max("__check").alias("last_check")]
    sets = materialize(stored.groupBy(F.col("__sid").alias("sid"), F.col("__fp").alias("fp")).agg(*first), "near-distinct")
    if not sets.groupBy("sid").agg(F.min("check").alias("a"), F.max("last_check").alias("b")).where("a < b").isEmpty():
        free(stored, sets)
        return keep_one(docs, shingle, digest, radius, salt + 1)
    whole = stored.select(F.col("__sid").alias("sid"), "__row", "text")
    members = materialize(parted(lists(whole, shingle), sets), "near-members")
    parts, members = members, materialize(gathered(members), "near-gathered")
    free(parts)
    wanted = sets.join(members.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("row").alias("__row"))
    wanted = materialize(wanted.select("__row"), "near-wanted")
    similar = verified(members, sift(whole, wanted, ["__row"])[0].join(wanted, "__row", "left_semi"), shingle)
    roots = components(similar.unionByName(collided(sets, radius)))
    named = sets.join(roots, sets.sid == roots.high, "left").select("least", F.coalesce("low", "sid").alias("root"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row"))
    dropped = materialize(stored.select("__row").join(kept, "__row", "left_anti"), "near-dropped")
    free(sets, members, wanted, similar)
    # only texts that may be dropped are shuffled
    doubtful, clear = sift(stored, dropped, ["__row"])
    return clear.unionByName(doubtful.join(dropped, "__row", "left_anti")).select(*[f"`{c}`" for c in columns])
