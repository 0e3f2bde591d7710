"""Elias-Fano sequences and tries against sorted arrays; scores against plain dictionaries of counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.llm import lm_scoring
from heronry.llm.elias_fano import EliasFano, Trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=300), st.integers(1, 2**20), st.lists(st.integers(0, 2**46), max_size=50))
def test_sequence(values, room, asked):
    values = np.sort(np.array(values, np.int64))
    bound = int(values[-1] + room if len(values) else room)
    got = EliasFano.read(np.frombuffer(EliasFano.of(values, bound).to_bytes(), np.uint8))
    assert (got.values(np.arange(len(values))) == values).all()
    x = np.array([*(a % bound for a in asked), 0, bound - 1, *values], np.int64)
    at, same = got.successors(x)
    assert (at == np.searchsorted(values, x)).all() and (same == np.isin(x, values)).all()


def test_dense_and_large_sequences():
    rng = np.random.default_rng(3)
    for n, bound in ((100_000, 50), (100_000, 100_000), (70_001, 10**14), (1, 2**50)):
        values = np.sort(rng.integers(0, bound, n))
        got = EliasFano.read(np.frombuffer(EliasFano.of(values, bound).to_bytes(), np.uint8))
        assert len(got.to_bytes()) * 8 / n < 64 + max(2, math.log2(bound / n) + 4) or n == 1
        x = rng.integers(0, bound, 5000)
        at, same = got.successors(x)
        assert (at == np.searchsorted(values, x)).all() and (same == np.isin(x, values)).all()


def test_trie_finds_what_was_stored():
    rng = np.random.default_rng(4)
    width = 5000
    stored = {(int(v), int(w)): int(c) for v, w, c in zip(rng.zipf(1.3, 4000) % 300, rng.integers(1, width, 4000), rng.integers(1, 65536, 4000))}
    keys = sorted(stored)
    contexts, sizes = np.unique([v for v, _ in keys], return_counts=True)
    levels = Trie.levels(width, contexts, sizes, np.array([w for _, w in keys]), np.array([stored[k] for k in keys]))
    asked = {v: sorted({int(w) for w in rng.integers(0, width, 40)} | {w for u, w in keys if u == v}) for v in range(0, 400, 2)}
    with Trie.mapped(width, levels) as trie:
        codes, n = trie.find(np.array([*asked]), np.array([len(x) for x in asked.values()]), np.concatenate([*asked.values()]))
    assert codes.tolist() == [stored.get((v, w), 0) for v, ws in asked.items() for w in ws]
    assert n.tolist() == [sum(u == v for u, _ in keys) for v in asked]


def brute(rows, held):
    """rows (doc_id, text); held tells which ids are held out."""
    split = [(i, [w.encode() for w in WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] + [b""]) for i, text in rows]
    ones, twos, after = Counter(), Counter(), Counter()
    for i, words in split:
        if not held(i):
            ones.update(words)
            twos.update(zip([None, *words], words))
    for v, _ in twos:
        after[v] += 1
    texts, total = ones[b""], sum(ones.values())
    out = []
    for i, words in split:
        base = score = 0.0
        for v, w in zip([None, *words], words):
            p = (ones[w] + 0.5) / (total + 0.5 * (len(ones) + 1))
            base += math.log10(p)
            c = texts if v is None else ones[v]
            score += math.log10(max(twos[v, w] - lm_scoring.DISCOUNT, 0) / c + lm_scoring.DISCOUNT * after[v] / c * p if c else p)
        out.append((i, held(i), len(words), sum(ones[w] > 0 for w in words), total, base, score))
    return out


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 900}"
    texts = [" ".join(rng.choice(["the", word(), word(), "of"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [*enumerate(texts)]


ODD = [(500, None), (501, ""), (502, " \n\t"), (503, "The THE the É é İ"), (503, "The THE the É é İ"), (None, "the of w1"), (504, "neverseen " * 3), (505, "the of " * 3000), (506, "a\x1cb\x00c\x85d")]


def same(got, want):
    order = lambda r: (str(r[0]), r[2], r[6])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)
    for g, w in zip(got, want):  # a code is off by half a step at most
        assert abs(g[6] - w[6]) <= 0.51 / lm_scoring.CODE_STEPS * g[2] + 1e-9


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def test_scores(spark):
    rows = corpus(300) + ODD
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, held string, batch int").repartition(4)
    got = lm_scoring.scores(docs, held())
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), brute(rows, fold))


def test_small_batches_many_shards_and_frequent_contexts(spark):
    """Contexts dealt out over several shards give the same scores."""
    rows = corpus(200, 2) + ODD
    packed = lm_scoring.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), held(), batch_tokens=700)
    assert packed.count() > 10
    vocab, numbered = lm_scoring.learn_words(packed, list_words=150)
    words = vocab.words.collect()
    assert len({r["id"] for r in words}) == len({r["word"] for r in words}) == vocab.distinct and max(r["id"] for r in words) < vocab.width
    model = lm_scoring.fit(numbered, vocab, shard_tokens=300, part_tokens=60)
    assert model.shards > 10 and model.split.count() > 3
    same(lm_scoring.score(numbered, model, part_tokens=60).collect(), brute(rows, fold))


def test_other_texts_by_a_stored_model(spark):
    rows = corpus(100, 3)
    packed = lm_scoring.pack(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    vocab, numbered = lm_scoring.learn_words(packed)
    model = lm_scoring.fit(numbered, vocab)
    other = [(1000 + i, t) for i, t in corpus(20, 4)]
    asked = lm_scoring.number(lm_scoring.pack(spark.createDataFrame(other, "doc_id long, text string"), F.lit(True)), vocab)
    want = [r for r in brute(rows + other, lambda i: i >= 1000) if r[0] >= 1000]
    same(lm_scoring.score(asked, model).collect(), want)


@pytest.mark.parametrize("rows", [[], [(next(i for i in range(99) if fold(i)), "all held out")]])
def test_nothing_learnt(spark, rows):
    got = lm_scoring.scores(spark.createDataFrame(rows, "doc_id long, text string"), held()).collect()
    assert len(got) == len(rows) and all(r["score"] == r["base_score"] and r["train_tokens"] == 0 for r in got)


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after a context that was seen."""
    rows = [(0, "a b a c a b"), (1, "b a"), (2, "c c a d")]
    packed = lm_scoring.pack(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    vocab, numbered = lm_scoring.learn_words(packed)
    model = lm_scoring.fit(numbered, vocab)
    asked = [(10 + i, f"a {w}".strip()) for i, w in enumerate(["a", "b", "c", "d", "zzz", ""])]
    numbered = lm_scoring.number(lm_scoring.pack(spark.createDataFrame(asked, "doc_id long, text string"), F.lit(True)), vocab)
    by = {r["doc_id"]: r["score"] for r in lm_scoring.score(numbered, model).collect()}
    ones = Counter(w for _, t in rows for w in [*t.split(), ""])
    twos = Counter(p for _, t in rows for p in zip(["^", *t.split()], [*t.split(), ""]))
    after = Counter(v for v, _ in twos)
    unigram = lambda w: (ones[w] + 0.5) / (vocab.tokens + 0.5 * (vocab.distinct + 1))
    p = lambda v, w: max(twos[v, w] - 0.75, 0) / (ones[v] if v != "^" else 3) + 0.75 * after[v] / (ones[v] if v != "^" else 3) * unigram(w) if v == "^" or ones[v] else unigram(w)
    assert abs(sum(p("a", w) for w in ["a", "b", "c", "d", "", "zzz"]) - 1) < 1e-12
    for i, w in enumerate(["a", "b", "c", "d", "zzz"]):
        assert abs(by[10 + i] - sum(map(math.log10, (p("^", "a"), p("a", w), p(w, ""))))) < 1e-3
