"""Language-model scores from bigrams of the whole corpus, held in Elias-Fano tries.

Texts are packed into batches of about a million tokens, each with a list of its different words;
only such lists, and each batch's different bigrams, are ever dealt out. Words are dealt by hash,
counted over all training texts, numbered, and told back to the batches. Bigrams are dealt to shards by their context; a context with very
many tokens is dealt out further by its successors, so no word is too frequent for a task. A shard
adds its counts up and becomes a trie: contexts, monotone pointers and successors as Elias-Fano
sequences, and discounted probabilities as 16-bit codes. To score, every batch asks each shard for
its different bigrams; a task maps the shard's trie into memory and answers by searching
successors relative to their context.

The model is an interpolated absolute discounting: with c counts, D the discount, t(v) the number of
different successors of v and p the add-a-half unigram probability,

    P(w | v) = (c(v w) - D) / c(v) + D t(v) / c(v) p(w),   or p(w) where v was never seen.

The first term is stored as a code of its logarithm (steps of 1/4096), the second is exact. A text
begins after a start that is no token and ends with an end that is one.

Defined results: a null text is empty and has one token, its end; a null id trains. Repeated rows
are texts of their own. An empty table gives no rows, and a text scored by a model that has learnt
nothing has the base score. Other columns are not read. Words are numbered exactly, not hashed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.elias_fano import Trie
from heronry.llm.runtime import free, materialize

#: Tokens of a batch, of a shard, and of the part of a context that stays together.
BATCH_TOKENS = 1_000_000
SHARD_TOKENS = 2_000_000
PART_TOKENS = 500_000
#: Words of batches' lists that are counted in one task.
LIST_WORDS = 500_000
DISCOUNT = 0.75
#: Steps of a code for one power of ten; codes reach 10^-16.
CODE_STEPS = 4096

_END = b""  # no word is empty
_START = 0  # words are numbered from 1, and 0 as a successor is a word that was never seen
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Vocabulary(NamedTuple):
    """``words`` (word, id, c) of the training texts; how many tokens, words and texts there are, and a bound of the ids."""

    words: DataFrame
    tokens: int
    distinct: int
    texts: int
    width: int


class Model(NamedTuple):
    """``tries`` has a row for each shard, ``split`` (v, t) the contexts that are dealt out over shards."""

    tries: DataFrame
    split: DataFrame
    vocabulary: Vocabulary
    shards: int


def pack(docs: DataFrame, held_out: Column, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Batches of texts: ids, flags and lengths, tokens as places in the batch's list of words, and how often each was trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, held, lengths, parts, total = [], [], [], [], 0
        seen: defaultdict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__

        def row() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            trained = np.bincount(tokens[np.repeat(~np.array(held, bool), lengths)], minlength=len(seen))
            columns = {
                "batch": pa.array([number], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())), "tokens": pa.array([_cell(tokens)], pa.binary()),
                "words": pa.array([list(seen)], pa.list_(pa.binary())), "trained": pa.array([trained], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, text, out in zip(*(batch.column(i) for i in range(3))):
                words = text.as_py().encode("utf-8", "replace").lower().split()  # of bytes: A-Z alone, the six ASCII spaces
                words.append(_END)
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                lengths.append(len(words))
                parts.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                total += len(words)
                if total >= batch_tokens:
                    yield row()
                    number += 1
                    ids, held, lengths, parts, total = [], [], [], [], 0
                    seen.clear()
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    schema = "batch long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words array<binary>, trained array<long>"
    return materialize(rows.mapInArrow(run, schema), "lm-packed")


def _cells(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Numbers in runs that begin at ``starts``, a binary cell for each run: the bytes that a number takes, then the numbers byte by byte.

    First come all lowest bytes: the upper ones are mostly equal, and compress to little.
    """
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    sizes = np.diff(np.r_[starts, len(values)])
    offsets = np.r_[0, np.cumsum(1 + width * sizes)].astype(np.int32)
    out = np.empty(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    at = np.arange(len(values)) + np.repeat(offsets[:-1] + 1 - starts, sizes)
    step = np.repeat(sizes, sizes)
    for k in range(width):
        out[at + k * step] = values >> 8 * k & 255
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _cell(values: np.ndarray) -> bytes:
    return _cells(values, np.zeros(1, np.int64))[0].as_py()


def _numbers(data: bytes) -> np.ndarray:
    """The numbers of a cell."""
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, data[0]):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


#: Told of words: each batch its places, numbers and counts, and without a batch the words themselves.
_TOLD = {"part": pa.int64(), "batch": pa.int64(), "at": pa.binary(), "ids": pa.binary(), "counts": pa.binary(), "words": pa.list_(pa.binary()), "all_ids": pa.list_(pa.int64()), "all_counts": pa.list_(pa.int64())}
_TOLD_SCHEMA = "part long, batch long, at binary, ids binary, counts binary, words array<binary>, all_ids array<long>, all_counts array<long>"


def learn_words(packed: DataFrame, list_words: int = LIST_WORDS) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training texts, and ``packed`` numbered by it.

    A task gets all batches' words of one part of the hashes. It counts them, numbers them (of p
    parts the k-th has the numbers k + 1, k + 1 + p, ...) and answers each batch.
    """
    import xxhash

    parts = max(1, -(-(packed.agg(F.sum(F.size("words"))).first()[0] or 0) // list_words))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, trained in zip(*batch.columns):
                names = words.as_py()
                part = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in names), np.int64, len(names))
                order = np.argsort(part, kind="stable")
                part = part[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                spelled = [names[i] + b"\n" for i in order.tolist()]  # words hold no white space
                ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
                offsets = np.r_[0, ends[np.r_[starts[1:] - 1, len(part) - 1]]].astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(spelled))])
                columns = [pa.array(part[starts]), pa.array([number.as_py()] * len(starts), pa.int64()), _cells(order, starts), _cells(trained.values.to_numpy()[order], starts), lists]
                yield pa.RecordBatch.from_arrays(columns, ["part", "batch", "at", "trained", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_shard(batches, "part"):
            asked, place = [], {}
            for row in rows:
                words = row["words"].as_py().split(b"\n")[:-1]
                own = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
                asked.append((row["batch"].as_py(), row["at"].as_py(), own, _numbers(row["trained"].as_py())))
            sums = np.zeros(len(place), np.int64)
            for _, _, own, trained in asked:
                sums[own] += trained  # a batch names a word once
            learnt = sums > 0
            ids = np.where(learnt, (np.cumsum(learnt) - 1) * parts + part + 1, 0)
            names = [w for w, known in zip(place, learnt.tolist()) if known]
            yield _told(part=part, words=names, all_ids=ids[learnt], all_counts=sums[learnt])
            for number, at, own, _ in asked:
                known = learnt[own]
                yield _told(part=part, batch=number, at=_cell(_numbers(at)[known]), ids=_cell(ids[own[known]]), counts=_cell(sums[own[known]]))

    dealt = packed.select("batch", "words", "trained").mapInArrow(send, "part long, batch long, at binary, trained binary, words binary")
    told = materialize(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, _TOLD_SCHEMA), "lm-words")
    words = told.where("batch IS NULL").select(F.explode(F.arrays_zip("words", "all_ids", "all_counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.all_ids").alias("id"), F.col("w.all_counts").alias("c"))
    size = words.agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.max("id").alias("last"), F.max(F.when(F.col("word") == F.lit(_END), F.col("c"))).alias("texts")).first()
    vocab = Vocabulary(words, size["c"] or 0, size["n"], size["texts"] or 0, (size["last"] or 0) + 1)
    known = told.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("at", "ids", "counts")).alias("known"))
    return vocab, _numbered(packed, known)


def _told(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([values.get(c)], k) for c, k in _TOLD.items()})


def number(packed: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Other batches than those that a vocabulary was learnt from, numbered by it; replaces ``packed``."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, known in zip(*batch.columns):
                cells = [_cell(known.values.field(i).to_numpy().astype(np.int64)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], ["batch", "at", "ids", "counts"])

    asked = packed.select("batch", F.posexplode("words").alias("at", "word")).join(vocab.words, "word")
    lists = asked.groupBy("batch").agg(F.collect_list(F.struct("at", "id", "c")).alias("k")).mapInArrow(tell, "batch long, at binary, ids binary, counts binary")
    return _numbered(packed, lists.select("batch", F.array(F.struct("at", "ids", "counts")).alias("known")))


def _numbered(packed: DataFrame, known: DataFrame) -> DataFrame:
    """Batches with the numbers and counts of their words in place of the words; replaces ``packed``."""
    rows = packed.select("batch", "doc_ids", "held", "lengths", "tokens", F.size("words").alias("n_words"))
    made = materialize(rows.join(known, "batch", "left"), "lm-numbered")
    free(packed)
    return made


class _Batch:
    """A numbered batch: of each token its word's number and count, and the same of the token before it."""

    def __init__(self, row: dict, texts: int):
        n = row["n_words"]
        self.ids, self.counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if row["known"] is not None:
            for cells in row["known"].to_pylist():
                at = _numbers(cells["at"])
                self.ids[at], self.counts[at] = _numbers(cells["ids"]), _numbers(cells["counts"])
        self.tokens = _numbers(row["tokens"])
        self.lengths = row["lengths"]
        self.first = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        self.held = row["held"]
        # the start stands after the batch's own words
        self.ids, self.counts = np.r_[self.ids, _START], np.r_[self.counts, texts]
        self.before = np.r_[n, self.tokens[:-1]]
        self.before[self.first] = n

    def pairs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different (context, word) pairs as places in the batch's words, in ascending order, and of each chosen token its pair."""
        n = len(self.ids)
        keys, which = np.unique(self.before[chosen] * n + self.tokens[chosen], return_inverse=True)
        return keys // n, keys % n, which


def _batches(batches: Iterator[pa.RecordBatch], texts: int, extra: tuple[str, ...] = ()) -> Iterator[tuple[dict, _Batch]]:
    for batch in batches:
        at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            row = {c: at[c][i].as_py() for c in ("batch", "n_words", "tokens")}
            row |= {c: at[c][i].values.to_numpy(zero_copy_only=False) for c in ("held", "lengths")}
            row |= {c: at[c][i].values for c in ("doc_ids", "known", *extra)}
            yield row, _Batch(row, texts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _dealt(v: np.ndarray, c: np.ndarray, w: np.ndarray, shards: int, part_tokens: int) -> np.ndarray:
    """The shard of each bigram: of its context, or for a frequent context also of its successor."""
    parts = (-(-c // part_tokens)).astype(np.uint64)
    return ((_mixed(v) + _mixed(_mixed(w) % np.maximum(parts, np.uint64(1)))) % np.uint64(shards)).astype(np.int64)


class _Sent(NamedTuple):
    """Bigrams by shard and context: the order they were put in, and starts of shards and contexts."""

    order: np.ndarray
    shards: np.ndarray
    shard_starts: np.ndarray
    context_starts: np.ndarray


def _arranged(shard: np.ndarray, context: np.ndarray) -> _Sent:
    """Of bigrams whose equal contexts are neighbours."""
    # numbers of 16 bits are sorted by counting
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    shard, context = shard[order], context[order]
    new_shard = np.r_[True, shard[1:] != shard[:-1]][: len(order)]
    new_context = new_shard | np.r_[True, context[1:] != context[:-1]][: len(order)]
    starts = np.flatnonzero(new_shard)
    return _Sent(order, shard[starts], starts, np.flatnonzero(new_context))


def _sent_cells(sent: _Sent, v: np.ndarray, w: np.ndarray, **more: np.ndarray) -> dict[str, pa.Array]:
    """Each shard's contexts, their numbers of words, and the words; ``more`` columns by context (in capitals) or by word."""
    first = np.searchsorted(sent.context_starts, sent.shard_starts)
    v, w = v[sent.order], w[sent.order]
    cells = {"shard": pa.array(sent.shards, pa.int64()), "v": _cells(v[sent.context_starts], first), "k": _cells(np.diff(np.r_[sent.context_starts, len(v)]), first), "w": _cells(w, sent.shard_starts)}
    for name, x in more.items():
        cells[name.lower()] = _cells(x[sent.order][sent.context_starts], first) if name.isupper() else _cells(x[sent.order], sent.shard_starts)
    return cells


def _by_shard(batches: Iterator[pa.RecordBatch], name: str = "shard") -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows sorted by shard, a stream for each shard; no more than an Arrow batch is held."""
    rows = ({c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)} for batch in batches for i in range(batch.num_rows))
    row = next(rows, None)

    def stream(shard: int) -> Iterator[dict]:
        nonlocal row
        while row is not None and row[name].as_py() == shard:
            yield row
            row = next(rows, None)

    while row is not None:
        shard = row[name].as_py()
        mine = stream(shard)
        yield shard, mine
        for _ in mine:  # what the reader left
            pass


def fit(numbered: DataFrame, vocab: Vocabulary, shard_tokens: int = SHARD_TOKENS, part_tokens: int = PART_TOKENS) -> Model:
    """The tries of all training texts."""
    shards, texts, width = max(1, -(-vocab.tokens // shard_tokens)), vocab.texts, vocab.width

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(batches, texts):
            a, b, which = batch.pairs(np.repeat(~batch.held, batch.lengths))
            v, w, c = batch.ids[a], batch.ids[b], batch.counts[a]
            n = np.bincount(which, minlength=len(a))
            sent = _arranged(_dealt(v, c, w, shards, part_tokens), a)
            yield pa.RecordBatch.from_pydict(_sent_cells(sent, v, w, C=c, n=n))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            got = [[_numbers(row[x].as_py()) for x in ("v", "k", "w", "c", "n")] for row in rows]
            each = [np.concatenate(x) for x in zip(*got)]
            v, size, w, c, n = each
            contexts, first, rank = np.unique(v, return_index=True, return_inverse=True)
            keys, which = np.unique(np.repeat(rank, size) * width + w, return_inverse=True)
            count = np.bincount(which, weights=n, minlength=len(keys))
            of, total = keys // width, c[first]
            sizes = np.bincount(of, minlength=len(contexts))
            codes = 1 + np.minimum(np.rint(-CODE_STEPS * np.log10((count - DISCOUNT) / total[of])), 65534)
            levels = Trie.levels(width, contexts, sizes, keys % width, codes)
            split = total > part_tokens
            columns = {"shard": pa.array([shard], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(Trie.LEVELS, levels)}}
            columns |= {c: pa.array([x[split]], pa.list_(pa.int64())) for c, x in (("split_v", contexts), ("split_t", sizes))}
            yield pa.RecordBatch.from_pydict(columns)

    dealt = numbered.mapInArrow(send, "shard long, v binary, k binary, w binary, c binary, n binary")
    levels = ", ".join(f"{c} binary" for c in Trie.LEVELS)
    tries = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, f"shard long, {levels}, split_v array<long>, split_t array<long>")
    tries = materialize(tries, "lm-tries")
    split = tries.select(F.explode(F.arrays_zip("split_v", "split_t")).alias("s")).groupBy(F.col("s.split_v").alias("v")).agg(F.sum("s.split_t").alias("t"))
    return Model(tries, split, vocab, shards)


def score(numbered: DataFrame, model: Model, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Every text of the batches with its counts, its base score and the model's log10 probability."""
    vocab, shards = model.vocabulary, model.shards
    texts, width, total, distinct = vocab.texts, vocab.width, vocab.tokens, vocab.distinct
    none = np.zeros(0, np.int64)
    empty = Trie.levels(width, none, none, none, none)  # a shard may be asked that nothing was dealt to

    def pairs(batch: _Batch) -> tuple[np.ndarray, ...]:
        """Bigrams after a known context, arranged; and of each token its bigram, or -1."""
        known = batch.counts[batch.before] > 0
        a, b, which = batch.pairs(known)
        v, w, c = batch.ids[a], batch.ids[b], batch.counts[a]
        sent = _arranged(_dealt(v, c, w, shards, part_tokens), a)
        place = np.empty(len(a), np.int64)
        place[sent.order] = np.arange(len(a))
        of = np.full(len(batch.tokens), -1)
        of[known] = place[which]
        return sent, v, w, c, of

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _batches(batches, texts):
            sent, v, w, _, _ = pairs(batch)
            yield pa.RecordBatch.from_pydict({"batch": pa.array([row["batch"]] * len(sent.shards), pa.int64()), **_sent_cells(sent, v, w)})

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of each batch that are dealt out over shards, as far as their counts tell."""
        for batch in batches:
            for number, known in zip(*batch.columns):
                cells = known.as_py() or []
                v = np.concatenate([_numbers(c["ids"])[_numbers(c["counts"]) > part_tokens] for c in cells] + [np.full(int(texts > part_tokens), _START)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(v), pa.int64()), pa.array(v)], ["batch", "v"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            head = next(rows)
            with Trie.mapped(width, [head[c].as_py() for c in Trie.LEVELS] if head["batch"].as_py() is None else empty) as trie:
                for row in rows if head["batch"].as_py() is None else chain([head], rows):
                    codes, n = trie.find(*(_numbers(row[x].as_py()) for x in ("v", "k", "w")))
                    columns = {"batch": [row["batch"].as_py()], "shard": [shard], "codes": [_cell(codes.astype(np.int64))], "t": [_cell(n)]}
                    yield pa.RecordBatch.from_pydict(columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _batches(batches, texts, ("answers", "split")):
            unigram = (batch.counts + 0.5) / (total + 0.5 * (distinct + 1))
            base = np.log10(unigram)[batch.tokens]
            sent, v, w, c, of = pairs(batch)
            probability = unigram[batch.tokens]
            if len(sent.order):
                answers = sorted(zip(*(row["answers"].field(c).to_pylist() for c in ("shard", "codes", "t"))))
                codes = np.concatenate([_numbers(a[1]) for a in answers])
                t = np.concatenate([_numbers(a[2]) for a in answers]).astype(np.float64)
                t = np.repeat(t, np.diff(np.r_[sent.context_starts, len(codes)]))
                v, c = v[sent.order], c[sent.order]
                if row["split"] is not None:
                    names, totals = (row["split"].field(f).to_numpy() for f in ("v", "t"))
                    order = np.argsort(names)
                    at = np.minimum(np.searchsorted(names, v, sorter=order), len(names) - 1)
                    wide = names[order[at]] == v
                    t[wide] = totals[order[at]][wide]
                found = np.where(codes > 0, 10.0 ** (-(codes - 1) / CODE_STEPS), 0.0)
                seen = of >= 0
                p = of[seen]
                probability[seen] = found[p] + DISCOUNT * t[p] / c[p] * probability[seen]
            sums = lambda x: np.add.reduceat(x, batch.first)
            yield pa.RecordBatch.from_pydict({
                "doc_id": row["doc_ids"], "held_out": pa.array(batch.held), "n_tokens": pa.array(batch.lengths), "n_known": pa.array(sums((batch.counts[batch.tokens] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(batch.lengths), total)), "base_score": pa.array(sums(base)), "score": pa.array(sums(np.log10(probability))),
            })

    levels = ", ".join(f"{c} binary" for c in Trie.LEVELS)
    asked = numbered.mapInArrow(ask, "batch long, shard long, v binary, k binary, w binary")
    held = model.tries.select("shard", *Trie.LEVELS).unionByName(asked, allowMissingColumns=True)
    # a shard's trie has no batch and comes first
    answers = held.repartition("shard").sortWithinPartitions("shard", "batch").select("shard", "batch", "v", "k", "w", *Trie.LEVELS).mapInArrow(answer, "batch long, shard long, codes binary, t binary")
    answered = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "codes", "t")).alias("answers"))
    wide = numbered.select("batch", "known").mapInArrow(frequent, "batch long, v long").join(model.split, "v").groupBy("batch").agg(F.collect_list(F.struct("v", "t")).alias("split"))
    return numbered.join(answered, "batch", "left").join(wide, "batch", "left").mapInArrow(finish, SCORES)


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """``score`` of all documents by the model of those that are not held out."""
    vocab, numbered = learn_words(pack(docs, held_out))
    return score(numbered, fit(numbered, vocab))
