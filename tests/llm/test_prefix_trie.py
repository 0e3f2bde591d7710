"""The conversation trie against a recursive version over plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from heronry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    remainder = lambda c: c - c % 20 if c >= 0 else -(-c - -c % 20)  # noqa: E731  towards zero
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(remainder(c), [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in below)
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def built_by_spark(spark, rows, most):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), most)
    assert got.columns == prefix_trie.COLUMNS
    return sorted(repr(tuple(r)) for r in got.collect())


def conversations(seed, n, texts, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        rows += [(conv, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(rng.randint(1, longest))]
    return rows


EDGES = [
    (0, None, "user", "before all"), (0, 0, None, "hi there"), (0, 0, "user", None), (0, 1, "a", "x  y\n z"), (0, 1, "a", "x  y\n z"),  # repeated row, tied turns
    (3, 5, "user", ""), (25, 1, "user", "no head"), (25, 2, "user", "two"), (None, 1, "user", "lost"), (41, 1, "u", "alone"), (-3, 1, "user", "below"), (-45, 2, "x", "y"),
    (2**40, 7, "user", "big"), (2**40 + 1, 7, "user", "big"),
]


@pytest.mark.parametrize("most", [1, 4000])
def test_edges(spark, most):
    assert built_by_spark(spark, EDGES, most) == brute(EDGES)


@pytest.mark.parametrize(("texts", "n", "longest", "most"), [(["a", "b c"], 120, 4, 12), (["same words here"], 60, 6, 10)])
def test_groups_dealt_anew(spark, texts, n, longest, most):
    """Hot first turns, dealt anew several times, and long chains of shared turns."""
    rows = conversations(7, n, texts, longest)
    rows += [(1000 + i, t, "system", "shared prompt") if t < 12 else (1000 + i, t, "user", f"own {i % 5}") for i in range(20, 60) for t in range(13)]
    assert built_by_spark(spark, rows, most) == brute(rows)


def test_one_conversation_told_often(spark):
    """Members of one path over many runs of ids, in the order of their numbers."""
    rows = [(c * 900, 0, "user", "hello you") for c in range(300)]
    assert built_by_spark(spark, rows, 5) == brute(rows)


def test_conversation_left_without_turns(spark):
    """All own turns are replaced and there is no head: a member of the root that ends there."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 1, "user", "gone")]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
    more = spark.createDataFrame([(*r, "x", 1) for r in EDGES], SCHEMA + ", gid string, n int")
    assert sorted(repr(tuple(r)) for r in prefix_trie.trie(more).collect()) == brute(EDGES)


def test_long_texts_and_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t % 7} " + "word " * (2000 if t == 3 else 1)) for t in range(700)] + [(21, t, "user", f"turn {t % 7} ") for t in range(5)]
    assert built_by_spark(spark, rows, 100) == brute(rows)
