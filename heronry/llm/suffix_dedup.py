"""Repeated passages by suffix arrays: find every string of ``length`` bytes that also starts elsewhere.

Several lengths are searched at once; the shortest is the *window*.

1. Anchors. Every window owns the least hash of the ``gram``-byte grams in it; windows of equal
   content own equal grams at equal places. The windows of a text that own the same gram are one
   *context*, whose bytes reach as far as the longest string that starts in it, or to the text's
   end. Grams seen once in the corpus rule out their contexts.
2. Equal contexts are counted together (so thousands of copies are one row with a weight) and
   the distinct ones are dealt into shards by gram, so equal windows meet in one shard. A gram
   with more contexts than a shard holds is dealt over several.
3. In each shard a suffix array is made by Larsson-Sadakane refinement: groups of suffixes equal
   to some depth are sorted by the rank of the suffix that deep, which doubles the depth; only
   groups of two or more stay active. Kasai's scan in text order, all contexts in lockstep, gives
   the common prefixes. A window whose neighbour window in the array shares ``length`` bytes is
   the start of a repeated string of that length.
4. Shards of one gram are merged: each sends its distinct windows as 64-bit hashes, cut into
   slices, a row for each; they are searched in the merged slice by binary search.
5. Repeated windows go back to all places with that context, and from each text the union of
   its repeated strings is cut.

Passages are told by words: ``remove_passages`` searches the same way where each word stands as a
hash of ``WORD`` bytes, so a string of so many words has one length whatever its letters.

Nothing is dropped or sampled, and only counts reach the driver. Defined results: a null text is
an empty text; texts shorter than ``length`` are never touched; repeated rows repeat their bytes,
so both lose them; columns other than ``doc_id`` and ``text`` are not read by ``digests``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.runtime import free, hot, id_text, join_hot, key_runs, materialize, sift

LENGTH = 400
#: Reported beside the strings that are removed.
PASSAGE = 280
#: A passage has so many words or more; a word is so many bytes of its hash.
PASSAGE_WORDS = 51
WORD = 6
GRAM = 60
#: Contexts, about 500 bytes each, that a shard holds on average (its arrays fit a core's cache), and
#: those of one gram beyond which it is divided over several shards.
SHARD = 700
DIVIDED = 2000
#: Bytes hashed together; positions in a block take 21 bits of a window's key.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Polynomial hashes of any substring of a block of bytes."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]

    def all(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - span : width - span + len(values) - width + 1])


def contexts(data: np.ndarray, starts: np.ndarray, owned: np.ndarray, ends: np.ndarray, length: int, longest: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of the texts at [starts, ends) of one block, of which the first ``owned`` windows count.

    Gives text, first window, windows, gram hash and context hash of each.
    """
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return none
    hashes = Hashes(data)
    grams = _mix(hashes.all(gram))
    low = np.uint64((1 << 21) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_minimum(key, length - gram + 1) & low).astype(np.int64)  # of windows 0 .. n - length
    # window j is valid if it lies in one text: mark the texts' ranges of windows
    text = np.full(len(owner) + 1, -1, np.int32)
    for k, (a, windows) in enumerate(zip(starts.tolist(), owned.tolist())):
        text[a : a + windows] = k
    text = text[:-1]
    change = np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(change)
    count = np.diff(np.r_[first, len(owner)])
    inside = text[first] >= 0
    first, count = first[inside], count[inside]
    if not len(first):
        return none
    which = text[first].astype(np.int64)
    at, end = owner[first], np.minimum(first + count + (longest - 1), ends[which])
    shape = (count.astype(np.uint64) << np.uint64(42)) | ((at - first).astype(np.uint64) << np.uint64(21)) | (end - first).astype(np.uint64)
    context = _mix(hashes.of(first, end) ^ _mix(shape))
    return which, first - starts[which], count, grams[at].view(np.int64), context.view(np.int64)


def text_blocks(sizes: list[int], length: int, longest: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Deal texts into blocks of (text, from, to, windows); of a long text each window counts in one block."""
    block, used = [], 0
    for k, n in enumerate(sizes):
        at = 0
        while n - at >= length:
            take = min(n - at, BLOCK - used)
            if take < min(n - at, longest):
                yield block
                block, used = [], 0
                continue
            windows = take - (length if at + take == n else longest) + 1
            block.append((k, at, at + take, windows))
            used += take
            if at + take == n:
                break
            at += windows
    if block:
        yield block


ANCHORS = "doc_key long, text_hash long, lo int, n int, gram long, context long"


#: What is searched of a text: its bytes, or a sequence of bytes made of it.
Spell = Callable[[str], bytes]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def anchors(docs: DataFrame, length: int, longest: int, gram: int = GRAM, spell: Spell = utf8) -> DataFrame:
    """Every context of every text: where its windows begin, how many they are, and its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            raw = [spell(t.as_py()) for t in batch.column(2)]
            for block in text_blocks(list(map(len, raw)), length, longest):
                data = np.frombuffer(b"".join([raw[k][a:b] for k, a, b, _ in block]), np.uint8)
                ends = np.cumsum([b - a for _, a, b, _ in block])
                starts = ends - np.array([b - a for _, a, b, _ in block])
                windows = np.array([w for *_, w in block])
                which, lo, n, g, c = contexts(data, starts, windows, ends, length, longest, gram)
                owner, base = np.array([k for k, *_ in block])[which], np.array([a for _, a, _, _ in block])[which]
                columns = [pa.array(docs_[owner], pa.int64()), pa.array(hashes[owner], pa.int64()), pa.array((lo + base).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(g), pa.array(c)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_key", "text_hash", "lo", "n", "gram", "context"])

    return _long(_keyed(docs), length, spell).select("doc_key", "text_hash", "text").mapInArrow(run, ANCHORS)


WIDTH = 5  # bytes of the first key
#: Bits of a position that is sorted with its key; a larger shard is sorted by key alone, which is slower.
PLACE_BITS = 21


def _sorted(key: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (43 bits, overwritten) in ascending order with their places; equal keys keep ascending places."""
    if size < 1 << PLACE_BITS:
        key <<= np.uint64(PLACE_BITS)
        key |= place.astype(np.uint64)
        key.sort()
        place = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        key >>= np.uint64(PLACE_BITS)
        return key, place
    turn = np.argsort(key, kind="stable")
    return key[turn], place[turn]


def _heads(key: np.ndarray) -> np.ndarray:
    return np.r_[True, key[1:] != key[:-1]]


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and rank of texts, each followed by one end byte, sorted to ``depth`` bytes.

    ``ends`` has the place of each position's end byte. End bytes come before all others and are
    ranked in text order, so all suffixes differ at a depth beyond the longest text, and the
    order is total, as Kasai's scan needs.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(WIDTH, np.uint8)].astype(np.uint64)
    slots = np.arange(n)
    left = np.minimum(ends - slots, WIDTH).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        key = key << np.uint64(8) | np.where(left > k, padded[k : k + n], np.uint64(0))
    key, suffixes = _sorted(key << np.uint64(3) | left, slots, n)
    head = _heads(key)
    head |= key & np.uint64(7) < WIDTH  # with an end byte among the first ones nothing is equal
    order, rank, bits = suffixes.copy(), np.empty(n, np.uint32), np.uint64(max(22, n.bit_length()))
    h = WIDTH
    while True:
        group = np.maximum.accumulate(np.where(head, slots, 0))
        rank[suffixes] = group
        order[slots] = suffixes
        active = ~(head & np.r_[head[1:], True])  # in groups of two or more
        if h >= depth or not active.any():
            break
        slots, suffixes = slots[active], suffixes[active]
        key = group[active].astype(np.uint64) << bits | rank[suffixes + h]
        key, suffixes = _sorted(key, suffixes, n)
        head = _heads(key)
        h *= 2
    rank[order] = np.arange(n)  # ties beyond the depth in any fixed order
    return order, rank.astype(np.int64)


def kasai(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each array entry with the one before it.

    The array (``order``, and ``rank`` at each position) holds the first ``counts`` suffixes of each
    text. The prefix shrinks by at most one from a suffix to the next in the text where the
    neighbour's next suffix is in the array too, so the scan goes in text order; every text has a
    lane of its own and eight bytes are compared at a time.
    """
    lcp = np.zeros(len(order), np.int32)
    words = np.zeros(len(data) + 8, np.uint64)
    padded = np.r_[data, np.zeros(16, np.uint8)].astype(np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data) + 8] << np.uint64(8 * k)
    followed = np.zeros(len(data), bool)
    followed[order] = True
    followed[(starts + counts - 1)[counts > 0]] = False
    by_size = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_size], counts[by_size]
    common = np.zeros(len(starts), np.int64)
    for t in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -t, "left"))  # lanes longer than t
        at = starts[:live] + t
        r = rank[at]
        other = order[np.maximum(r - 1, 0)]
        room = np.minimum(np.minimum(ends[at] - at, ends[other] - other), most)
        room[r == 0] = 0
        have = np.minimum(common[:live], room)
        todo = np.flatnonzero(have < room)
        while len(todo):
            differ = words[at[todo] + have[todo]] ^ words[other[todo] + have[todo]]
            same = np.full(len(todo), 8)
            odd = differ != 0
            bit = differ[odd] & (~differ[odd] + np.uint64(1))
            same[odd] = np.log2(bit.astype(np.float64)).astype(np.int64) >> 3
            have[todo] = np.minimum(have[todo] + same, room[todo])
            todo = todo[~odd & (have[todo] < room[todo])]
        lcp[r] = have
        common[:live] = np.where(followed[other], np.maximum(have - 1, 0), 0)
    return lcp


def joined(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts, each followed by a zero byte, and their sizes."""
    if not pa.types.is_large_binary(parts.type):
        parts = parts.cast(pa.large_binary())
    at = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    sizes = np.diff(at)
    data = np.zeros(int(at[-1] - at[0]) + len(parts), np.uint8)
    inside = np.ones(len(data), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    data[inside] = np.frombuffer(parts.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, sizes


def repeated_windows(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of a shard: place and context of every window, and for each length whether it repeats and is the first of its kind.

    What follows a context's windows is only there to be compared with, so the array is narrowed
    to windows before the scan for common prefixes.
    """
    stops = np.cumsum(sizes + 1) - 1
    starts, ends = stops - sizes, np.repeat(stops, sizes + 1)
    order, rank = suffix_array(data, ends, int(sizes.max(initial=0)) + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    window = np.zeros(len(data), bool)
    window[at] = True
    kept = window[order]
    order, rank = order[kept], (np.cumsum(kept) - 1)[rank]
    common = kasai(data, starts, counts, ends, order, rank, max(lengths))
    found = {}
    for length in lengths:
        up = common >= length
        found[length] = (up | np.r_[up[1:], False])[rank[at]], ~up[rank[at]]
    return at, text, found


#: Rows of a shard's result: a run of repeated windows; of a divided gram also a slice (in ``first``) of
#: its windows, packed: all that are not repeated so far, and one of each kind that is.
RUN, SLICE = range(2)
FOUND = "gram long, context long, shard long, length int, kind int, first int, last int, windows binary"
FOUND_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def search_shard(table: pa.Table, lengths: list[int]) -> pa.RecordBatch:
    """One shard: its contexts' runs of repeated windows; for a divided gram also its windows, in slices by hash."""
    column = {c: table.column(c).to_numpy() for c in ("gram", "context", "weight", "slices", "n")}
    counts, many, divided = column["n"].astype(np.int64), column["weight"] > 1, column["slices"] > 0
    data, sizes = joined(table.column("bytes").combine_chunks())
    at, text, found = repeated_windows(data, sizes, counts, lengths)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    opens, closes = (np.r_[x, text[1:] != text[:-1], y].astype(bool)[k : len(text) + k] for x, y, k in ((1, 1, 0), (1, 1, 1)))
    hashes = Hashes(data) if divided.any() else None
    rows = []  # gram, context, length, kind, first, last, windows
    for length in lengths:
        again, first_of_kind = found[length]
        fits = place + length <= sizes[text]
        flags = (again | many[text]) & fits
        begins = np.flatnonzero(flags & (opens | ~np.r_[False, flags[:-1]]))
        stops = np.flatnonzero(flags & (closes | ~np.r_[flags[1:], False]))
        rows.append((column["gram"][text[begins]], column["context"][text[begins]], length, RUN, place[begins], place[stops], [None] * len(begins)))
        if hashes:
            w = np.flatnonzero(divided[text] & fits & (~flags | first_of_kind))
            rows.append(packed_slices(column, text[w], np.where(flags[w], -1, place[w]), _mix(hashes.of(at[w], at[w] + length)), length))
    whole = lambda k: np.concatenate([np.full(len(r[0]), r[k]) for r in rows])
    joint = lambda k: np.concatenate([r[k] for r in rows])
    shard = np.full(sum(len(r[0]) for r in rows), table.column("shard")[0].as_py())
    columns = [joint(0), joint(1), shard, whole(2), whole(3), joint(4), joint(5), [x for r in rows for x in r[6]]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, FOUND_TYPES)], [f.split()[0] for f in FOUND.split(", ")])


def packed_slices(column: dict[str, np.ndarray], text: np.ndarray, place: np.ndarray, hashes: np.ndarray, length: int) -> tuple:
    """Rows with the windows of divided grams, one for each gram and slice: hashes, contexts and places (-1: known to repeat)."""
    gram, part = column["gram"][text], ((hashes >> np.uint64(20)) % column["slices"][text].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((part, gram))
    gram, part, packed = gram[order], part[order], np.stack([hashes.view(np.int64), column["context"][text], place])[:, order]
    starts = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])][: len(gram)])
    windows = [np.ascontiguousarray(p).tobytes() for p in np.split(packed, starts[1:], axis=1)] if len(starts) else []
    none = np.zeros(len(starts), np.int64)
    return gram[starts], none, length, SLICE, part[starts], none, windows


def search_shards(dealt: DataFrame, lengths: list[int]) -> DataFrame:
    """``search_shard`` of every shard of contexts (shard first, gram, context, weight, slices, n, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, table in key_runs(batches):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
                yield search_shard(table.slice(a, b - a), lengths)

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FOUND)


def merge_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """The windows of one slice, not repeated in their own shard, that another shard has too, by binary search in all of them."""
    sent = [np.frombuffer(w, np.int64).reshape(3, -1) for w in frame["windows"]]
    merged = np.sort(np.concatenate([s[0] for s in sent]))
    opened = np.concatenate([s[:, s[2] >= 0] for s in sent], axis=1)
    hashes, context, place = opened[:, np.searchsorted(merged, opened[0], "right") - np.searchsorted(merged, opened[0], "left") > 1]
    gram, length = (np.full(len(hashes), frame[c].iloc[0], k) for c, k in (("gram", np.int64), ("length", np.int32)))
    return pd.DataFrame({"gram": gram, "context": context, "length": length, "first": place.astype(np.int32), "last": place.astype(np.int32)})


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a key: rows of equal key hold the same bytes, so a null id may share the key of id 0."""
    return id_text(docs).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc_key"), F.xxhash64("text").alias("text_hash"), "text")


def _long(keyed: DataFrame, length: int, spell: Spell) -> DataFrame:
    """Without the texts that are too short, where that shows before they are spelled."""
    return keyed.where(F.octet_length("text") >= length) if spell is utf8 else keyed


def _spelled(texts: DataFrame, spell: Spell) -> DataFrame:
    """``wanted`` with the bytes that are searched in place of the text."""
    if spell is utf8:
        return texts.select("wanted", F.encode("text", "UTF-8").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spell(t.as_py()) for t in batch.column(1)], pa.binary())], ["wanted", "bytes"])

    rows = texts.select("wanted", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["wanted"], T.StructField("bytes", T.BinaryType())]))


def _across_shards(found: DataFrame) -> DataFrame:
    """Windows of divided grams that other shards of the gram hold too, as runs of one window."""
    sent = found.where(F.col("kind") == SLICE).select("gram", "length", F.col("first").alias("slice"), "windows")
    return sent.groupBy("gram", "length", "slice").applyInPandas(merge_windows, "gram long, context long, length int, first int, last int")


def spanned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the ``__spans`` of their key, or null; only texts that may have some are shuffled."""
    on = ["__key", "__hash"]
    may, clear = sift(rows, found, on)
    return may.join(found, on, "left").unionByName(clear.withColumn("__spans", F.lit(None).cast(found.schema["__spans"].dataType)))


def likely(places: DataFrame) -> DataFrame:
    """All ``places`` whose gram is seen again, and a few others; only grams are shuffled, and ``places`` are freed."""
    again = materialize(places.groupBy("gram").agg(F.count("*").alias("seen")).where("seen > 1").select("gram"), "sa-grams")
    found = materialize(sift(places, again, ["gram"])[0], "sa-places")
    free(places, again)
    return found


def repeats(docs: DataFrame, lengths: list[int], gram: int = GRAM, shard: int = SHARD, most: int = DIVIDED, spell: Spell = utf8) -> DataFrame:
    """doc_key, text_hash and ``spans`` (length; begin, end in bytes, in any order) of all texts with repeated strings.

    With another ``spell`` strings and places are of the bytes that it gives; equal texts must give equal bytes.
    """
    window, longest = min(lengths), max(lengths)
    places = likely(materialize(anchors(docs, window, longest, gram, spell), "sa-anchors"))
    # of repeated contexts any one place is read: the others hold the same bytes
    one = [F.first(c).alias(c) for c in ("doc_key", "text_hash", "lo", "n")]
    kinds = materialize(places.groupBy("gram", "context").agg(F.count("*").alias("weight"), *one), "sa-contexts")
    twice = kinds.groupBy("gram").agg(F.sum("weight").alias("seen"), F.count("*").alias("kinds")).where("seen > 1").select("gram", "kinds")
    twice = materialize(twice, "sa-twice")
    contexts = twice.agg(F.sum("kinds")).first()[0] or 0
    shards = max(1, round(contexts / shard))
    salts = F.ceil(F.col("kinds") / F.lit(most))
    divided = F.col("kinds") > most
    name = F.when(divided, F.xxhash64("gram", F.pmod(F.xxhash64("context"), salts))).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards)))
    dealt = join_hot(kinds, twice, ["gram"], hot(twice, "kinds", contexts)).select("gram", "context", "weight", "doc_key", "text_hash", "lo", "n", F.when(divided, salts).otherwise(0).alias("slices"), name.alias("shard"))
    item = F.struct("gram", "context", "weight", "slices", "shard", "lo", "n")
    wanted = materialize(dealt.groupBy("doc_key", "text_hash").agg(F.collect_list(item).alias("wanted")), "sa-wanted")
    # of repeated rows one is read: the others hold the same bytes; only texts that may be wanted are shuffled
    once = sift(_long(_keyed(docs), window, spell), wanted, ["doc_key", "text_hash"])[0].dropDuplicates(["doc_key", "text_hash"])
    picked = _spelled(wanted.join(once, ["doc_key", "text_hash"]), spell)
    cut = picked.select("bytes", F.explode("wanted").alias("w"))
    cut = cut.select("w.shard", "w.gram", "w.context", "w.weight", "w.slices", "w.n", F.substring("bytes", F.col("w.lo") + 1, F.col("w.n") + F.lit(longest - 1)).alias("bytes"))
    found = materialize(search_shards(cut, sorted(set(lengths))), "sa-found")
    ranges = found.where(F.col("kind") == RUN).select("gram", "context", "length", "first", "last")
    across = None
    if not twice.where(divided).isEmpty():
        across = materialize(_across_shards(found), "sa-across")
        ranges = ranges.unionByName(across)
    # a context has at most ``window`` runs of each length, so those of frequent contexts are a small broadcast
    back = join_hot(places, ranges, ["gram", "context"], hot(kinds, "weight", places.count()))
    span = F.struct("length", (F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + F.col("length")).alias("end"))
    spans = materialize(back.groupBy("doc_key", "text_hash").agg(F.collect_set(span).alias("spans")), "sa-spans")
    free(places, kinds, twice, wanted, found, across)
    return spans


def spans_of(column: pa.ListArray, length: int) -> Iterator[list[tuple[int, int]]]:
    """Of each row the maximal runs of the bytes in any span of this length."""
    fields = [column.values.field(f).to_numpy(zero_copy_only=False) for f in ("length", "begin", "end")]
    offsets = column.offsets.to_numpy().tolist()
    for a, b in zip(offsets, offsets[1:]):
        if a == b:
            yield []
            continue
        own = fields[0][a:b] == length
        begin, end = fields[1][a:b][own], fields[2][a:b][own]
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate(end[order])
        first = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]][: len(begin)])
        yield list(zip(begin[first].tolist(), end[np.r_[first[1:] - 1, -1]].tolist() if len(first) else []))


def cut_out(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for begin, end in removed:
        parts.append(data[at:begin])
        at = end
    return b"".join([*parts, data[at:]])


DIGESTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage_bytes": pa.int64(), "n_passages": pa.int64()}


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, most: int = DIVIDED, passage: int = PASSAGE) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of what is kept.

    n_passage_bytes and n_passages are the bytes, and the maximal runs of them, inside repeated
    strings of ``passage`` bytes; they report shorter repeats and remove nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column(2)
            for doc, text, removed, shorter in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), spans_of(spans, length), spans_of(spans, passage)):
                data = text.encode("utf-8", "replace")
                kept = cut_out(data, removed)
                rows.append((doc, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in shorter), len(shorter)))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(DIGESTS), DIGESTS.values())]
            yield pa.RecordBatch.from_arrays(columns, list(DIGESTS))

    found = repeats(docs, [length, passage], gram, shard, most).toDF("__key", "__hash", "__spans")
    rows = _keyed(docs).withColumnsRenamed({"doc_key": "__key", "text_hash": "__hash"})
    return spanned(rows, found).select("doc_id", "text", "__spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, most: int = DIVIDED) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` (and ``n_chars``, if there, counted anew).

    A cut may part a character; the bytes left of it are dropped. Every row stays, if need be with
    an empty text; a null text stays null.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = spans_of(batch.column(batch.num_columns - 1), length)
            kept = [cut_out(t.encode("utf-8", "replace"), s).decode("utf-8", "ignore") if s else t for t, s in zip(texts, spans)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)]))

    found = repeats(docs, [length], gram, shard, most).toDF("__key", "__hash", "__spans")
    rows = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    cut = spanned(rows, found).select(*[f"`{c}`" for c in docs.columns], "__spans").mapInArrow(run, T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def word_sequence(text: str) -> bytes:
    """The words of a text, each as ``WORD`` bytes of its hash."""
    import xxhash

    words = text.encode("utf-8", "replace").split()
    known = {w: xxhash.xxh64_digest(w)[:WORD] for w in set(words)}
    return b"".join(map(known.__getitem__, words))


def covered_words(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Runs of words (first, behind the last) inside any string of ``n`` words that begins with a word in a span of bytes."""
    runs = []
    for begin, end in sorted(spans):
        first, last = -(-begin // WORD), (end - n * WORD) // WORD
        if first > last:
            continue
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + n)
        else:
            runs.append([first, last + n])
    return [(a, b) for a, b in runs]


def word_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as bytes, from the first word's begin to the last one's end; words are met one by one."""
    out, at, words = [], 0, _WORDS.finditer(data)
    for first, stop in runs:
        begin = end = 0
        while at < stop:
            word = next(words)
            begin = word.start() if at == first else begin
            end, at = word.end(), at + 1
        out.append((begin, end))
    return out


def remove_passages(docs: DataFrame, n: int = PASSAGE_WORDS, gram: int = GRAM, shard: int = SHARD, most: int = DIVIDED) -> DataFrame:
    """``docs`` without the words of any string of ``n`` words that also starts elsewhere, in the same text or another.

    Strings are equal if their words are, white space between them may differ, and go from their
    first word to their last; overlaps count, and strings are judged on the input. Every row stays,
    if need be with an empty text; a null text stays null. ``n_chars``, if there, is counted anew.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text = text.as_py()
                runs = covered_words([(s["begin"], s["end"]) for s in spans.as_py()], n) if spans.is_valid else []
                data = text.encode("utf-8", "replace") if runs else b""
                kept.append(cut_out(data, word_spans(data, runs)).decode("utf-8", "replace") if runs else text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(batch.schema, columns)]))

    found = repeats(docs, [n * WORD], gram, shard, most, word_sequence).toDF("__key", "__hash", "__spans")
    rows = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    cut = spanned(rows, found).select(*[f"`{c}`" for c in docs.columns], "__spans").mapInArrow(run, T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut
