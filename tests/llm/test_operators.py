"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns whose names clash with the operators' own."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from heronry.llm import bpe, langid, licenses, media_gif, near_copies, orc_tokens, packing, queries, repetition, runtime, simhash, suffix_dedup, tokens, toxicity
from heronry.llm.runtime import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, fp string, block int, uid string, spans string"


def table(spark, texts, ids=None):
    rng = random.Random(len(texts))
    ids = ids or list(range(len(texts)))
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or ""), "x", "y", 1, "z", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    """Clean, copied, near-copied and odd texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randrange(2, 9)))
    make = lambda n: " ".join(word() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    out = [make(rng.randrange(5, 400)) for _ in range(30)]
    passage = make(120)
    out += [make(60) + " " + passage + " " + make(40) for _ in range(4)]
    out += [out[3], out[3], out[4], out[5].replace("a", "b", 1), out[6] + " end"]
    out += [None, "", " ", "\n\t ", "word", "a b c", "a" * 3000, "ab " * 900, "日本語 テキスト 😀", "x  y\n\nz 's it's 12", passage * 3, "\u0000\u0001 \x1c", make(4000)]
    return out


IDS = lambda n: [None if i % 17 == 5 else i // 2 if i % 11 == 3 else i for i in range(n)]


def collect(df):
    return [tuple(r) for r in df.collect()]


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


LIBRARY: dict = {}


def library_ids(name, text):
    if name not in LIBRARY:
        LIBRARY[name] = Tokenizer.from_file(P.path(name))
    tok = LIBRARY[name]
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_bytes_are_the_librarys(texts, name):
    enc = tokens.TokenBytes(P.path(name))
    odd = ["a  b\n\nc 'S it's  ", "ÀÉ été  x\x1cy 345½²", "\n", "x \n y", "İ ΣΑΣ", "<|endoftext|> foo<|endoftext|>", "a <|startoftext|>b <|ENDOFTEXT|> c", "<|", " x y ", "µm ªb ß ẞ ſ", "don'T we'LL"]
    for t in [*filter(None, texts), *odd]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library_ids(name, t), t[:50]


def test_op1_packs_every_piece_once(spark, texts, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 15)
    rows = packing.pack(table(spark, texts, IDS(len(texts))), P.path("word_bpe_49k.json"), 256, 0).collect()
    want = []
    for i, t in zip(IDS(len(texts)), texts):
        ids = np.array([*library_ids("word_bpe_49k.json", t), 0], "<u4")
        want += [(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    same_rows([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(w[3] for w in want) // 256)
    assert least <= len(bins) <= 1.1 * least + 1


def test_op1_full_pieces_of_many_partitions(spark):
    docs = spark.range(0, 1040, 1, 520).selectExpr("id as doc_id", "'a b c d e f g h i' as text")
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 4, 0).collect()
    places = Counter((r.sequence_id, r.offset) for r in rows)
    assert len(rows) == 3 * 1040 and max(places.values()) == 1
    full = [r for r in rows if r.length == 4]
    assert len({r.sequence_id for r in full}) == len(full) == 2080 and all(r.sequence_id < 0 and r.offset == 0 for r in full)


def test_op1_crossover_keeps_items_and_beats_best_fit():
    rng = random.Random(1)
    for low, high, gain in ((300, 900, 8), (600, 750, 20), (1, 2047, 0)):
        sizes = [rng.randint(low, high) for _ in range(2000)]
        plain = packing.Packing(sizes, 2048)
        plain.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
        found = []
        for seed in range(4):  # epochs of one island
            found = packing.evolve(sizes, 2048, found, seed)
        bins = found[0].max() + 1
        assert packing.lower_bound(sizes, 2048) <= bins <= len(plain.bins) - gain
        child = packing.crossover(sizes, 2048, found[0], found[-1], rng)
        for labels in (child, *found):
            assert len(labels) == 2000 and np.bincount(labels, sizes).max() <= 2048


def test_op1_migration_sends_the_best_on(spark):
    rows = [(b, i, b"", [b"%d%d" % (b, i), b"x"]) for b in (1, 2) for i in range(packing.ISLANDS)]
    got = packing.migrate(spark.createDataFrame(rows, packing.ISLAND)).collect()
    assert {(r.block, r.island): bytes(r.population[-1]) for r in got} == {(b, (i + 1) % packing.ISLANDS): b"%d%d" % (b, i) for b in (1, 2) for i in range(packing.ISLANDS)}
    assert all(len(r.population) == 3 for r in got)


def test_op2_round_trip(spark, texts):
    docs = table(spark, texts, IDS(len(texts)))
    got = media_gif.store_and_read(docs).collect()
    want = []
    for i, t in zip(IDS(len(texts)), texts):
        raw = (t or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    same_rows([tuple(r)[:5] for r in got], want)
    assert all(r.feature.startswith(f"{r.n_frames}x10:") and r.duration_ms == 100 * r.n_frames for r in got)
    stored = materialize(media_gif.with_media(docs), "test-gif")
    rendered = media_gif.frames(stored.where("doc_id is not null")).groupBy("doc_id", "frame").agg(F.collect_set(F.struct("starts_ms", "duration_ms", "width", "height", "histogram")).alias("f"))
    kept = media_gif.decoded(stored).where("doc_id is not null").select("doc_id", F.explode("frames").alias("r")).select("doc_id", "r.*")
    kept = kept.groupBy("doc_id", "frame").agg(F.collect_set(F.struct("starts_ms", "duration_ms", "width", "height", "histogram")).alias("f"))
    same_rows([(r.doc_id, r.frame, sorted(map(repr, r.f))) for r in kept.collect()], [(r.doc_id, r.frame, sorted(map(repr, r.f))) for r in rendered.collect()])
    digest = {r.media_sha256 for r in got}
    assert digest == {hashlib.sha256(r.media).hexdigest() for r in stored.collect()}


def test_op2_frames_of_long_payloads_and_damaged_files(spark):
    data = bytes(random.Random(6).randrange(256) for _ in range(64 * 2500))
    whole = media_gif.encode_payload(data)
    rows = media_gif.timed(media_gif.render(whole))
    assert [(r["starts_ms"], r["height"], sum(r["histogram"])) for r in rows] == [(0, 1024, 65536), (100, 1024, 65536), (200, 1024, 65536)]
    assert np.array(rows[0]["histogram"])[::21].tolist() == np.bincount(np.frombuffer(data[:65536], np.uint8) >> 6, minlength=4).tolist()
    rng, bad = random.Random(8), [None, b"", b"GIF89a", whole[:5000], b"GIF89a" + b"\xff" * 4 + whole[10:]]
    for _ in range(60):
        part = bytearray(whole[:3000])
        for _ in range(3):
            part[rng.randrange(6, 13) if rng.random() < 0.3 else rng.randrange(780, 900)] = rng.randrange(256)
        bad.append(bytes(part))
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([whole, *bad])], "doc_id long, media binary")
    got = media_gif.frames(rows).collect()
    assert [r.frame for r in got if r.doc_id == 0] == [0, 1, 2] and not any(r.doc_id in (1, 2) for r in got)


@pytest.mark.parametrize("size", [2, 3, 7, 8])
def test_op2_lzw_of_every_code_size(size):
    rng = random.Random(size)
    for n in (0, 1, 2, 63, 5000, 60000):
        data = bytes(rng.randrange(1 << size) if rng.random() < 0.4 else 1 for _ in range(n))
        assert media_gif.lzw_decode(media_gif.pack_codes(media_gif.lzw_codes(data, size), size), size) == data


def test_op2_disposal_transparency_and_long_payloads():
    def frame(box, samples, disposal, clear=None, interlace=False):
        left, top, w, h = box
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
        body = media_gif.pack_codes(media_gif.lzw_codes(bytes(samples)))
        return control + b"\x2c" + np.array([left, top, w, h], "<u2").tobytes() + bytes([0x40 * interlace, 8]) + media_gif._blocks(body)

    head = b"GIF89a" + np.array([2, 2], "<u2").tobytes() + bytes([0xF7, 0, 0]) + media_gif.grey()
    parts = [frame((0, 0, 2, 2), [1, 2, 3, 4], 1), frame((0, 0, 1, 1), [9], 3), frame((1, 1, 1, 1), [8], 2), frame((0, 0, 2, 1), [5, 6], 1, clear=5)]
    red = [f.canvas[..., 0].ravel().tolist() for f in media_gif.decode_gif(head + b"".join(parts) + b"\x3b")]
    assert red == [[1, 2, 3, 4], [9, 2, 3, 4], [1, 2, 3, 8], [1, 6, 3, 0]]
    rows = np.repeat(np.arange(9), 2)
    order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, 9, step)]
    tall = b"GIF89a" + np.array([2, 9], "<u2").tobytes() + bytes([0xF7, 0, 0]) + media_gif.grey() + frame((0, 0, 2, 9), np.repeat(order, 2).tolist(), 0, interlace=True) + b"\x3b"
    assert media_gif.decode_gif(tall)[0].canvas[..., 0].ravel().tolist() == rows.tolist()
    data = bytes(random.Random(2).randrange(256) for _ in range(64 * 2500))
    found = media_gif.decode_gif(media_gif.encode_payload(data))
    assert len(found) == 3 and b"".join(map(media_gif.samples_of, found)) == data


def test_op2_a_small_stream_expands_no_further_than_wanted():
    """Long runs of one sample: a few bytes would be hundreds of megabytes."""
    codes = media_gif.pack_codes(media_gif.lzw_codes(bytes(9_000_000)))
    assert len(codes) < 10_000
    assert media_gif.lzw_decode(codes, 8, 100) == bytes(100) and media_gif.lzw_decode(codes * 9, 8, 100) == bytes(100)
    assert media_gif.lzw_decode(codes, 8, 10**9) == media_gif.lzw_decode(codes, 8) == bytes(9_000_000)


def test_op2_long_text_is_drawn_frame_by_frame(spark):
    text = "0123456789abcdef" * 65536  # 16 frames
    row = media_gif.store_and_read(table(spark, [text])).first()
    assert (row.payload_bytes, row.n_frames, row.payload_sha256) == (1 << 20, 16, hashlib.sha256(text.encode()).hexdigest())


def brute_repetition(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def brute_verdict(t):
    """Shares of characters in duplicated n-grams (the largest) and lines, and the verdict, from words alone."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shares = {}
    for n in range(5, 11):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        shares[n] = sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    doubled = sum(len(x) for k, x in enumerate(lines) if x in lines[:k]) / max(1, sum(map(len, lines)))
    fine = all(shares[n] <= repetition.MOST_COVERED[n] for n in shares) and doubled <= repetition.MOST_IN_LINES
    return doubled, max(shares.values()), fine and not brute_repetition(t)[-1]


def test_op3_verdict_is_in_characters(texts):
    rng = random.Random(11)
    for _ in range(150):
        words = [rng.choice(["été", "ñandú", "plain", "œuvre", "日本", "a", "zzz"]) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 120))]
        at, n = rng.randrange(0, len(words) + 1), rng.randrange(0, 30)
        sep = rng.choice([" ", "\n"])
        t = " ".join(words + words[at : at + n]) + sep + " ".join(words[at : at + n]) + "\n" * rng.randrange(2) + " ".join(words[at : at + n])
        assert repetition.measure(t)[-3:] == pytest.approx(brute_verdict(t)), t
    for t in texts:
        if len(t or "") < 5000:
            assert repetition.measure(t or "")[-3:] == pytest.approx(brute_verdict(t))


def test_op3_counts(spark, texts):
    docs = table(spark, texts, IDS(len(texts)))
    got = repetition.rules(docs).collect()
    same_rows([tuple(r)[:7] for r in got], [(i, *brute_repetition(t)) for i, t in zip(IDS(len(texts)), texts)])
    assert all(not r.kept for r in got if r.base_failed)
    kept = repetition.filter_kept(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_op3_limits_fall_with_length():
    words = [f"word{k:02d}" for k in range(88)]
    text = lambda n: " ".join(words[:n] + words[30:40] + words[n:])
    assert repetition.measure(text(70))[5] is False and repetition.measure(text(70))[-1] is False  # 20 of 98 words
    assert repetition.measure(" ".join([text(70), *(f"more{k}" for k in range(20))]))[-1] is True
    limits = [repetition.MOST_COVERED[n] for n in sorted(repetition.MOST_COVERED)]
    assert all(a > b for a, b in zip(limits, limits[1:]))


def test_op4_is_tiktoken(spark, texts):
    ranks = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = table(spark, texts, IDS(len(texts)))
    for step, overlap in ((bpe.STEP, bpe.OVERLAP), (200, 20)):
        got = bpe.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, step, overlap)
        want = []
        for i, t in zip(IDS(len(texts)), texts):
            ids = ranks.encoding.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        same_rows(collect(got), want)


def test_op4_stitching_random():
    ranks, rng = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(4)
    alphabet = ["a", "b", "'", "'re", "'ll", " ", "  ", "\n", "1", "é", "!", "\t", "日"]
    for _ in range(800):
        x = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 30]) for _ in range(rng.randrange(0, 60)))
        for step, overlap in ((16, 9), (7, 20), (40, 12)):
            parts = bpe.chunks(x, step, overlap)
            ends = [bpe.boundaries(ranks.pattern, p) for p in parts]
            assert bpe.stitch(ranks.pattern, parts, ends, step) == ranks.pattern.findall(x)


def test_op5_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == langid.held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def test_op5_edges(spark, texts):
    docs = table(spark, texts, IDS(len(texts)))
    got = langid.identify(docs, langid.fit(docs, sample_docs=20)).collect()
    assert len(got) == len(texts)
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, none).collect()} == {("und", 0.0)}
    model = langid.fit(docs, sample_docs=20)
    assert [x[0] for x in langid.labelled(model, [None, "", "12 34 !"])] == ["und"] * 3


def tiny_network(rng, hidden=3, languages=2):
    shapes = {f"{k}{d}": x for d in (0, 1) for k, x in (("w", (3 * hidden, 256)), ("u", (3 * hidden, hidden)), ("v", (languages, hidden)))}
    return {k: rng.standard_normal(x) * 0.5 for k, x in shapes.items()} | {"bias": rng.standard_normal((languages, 1))}


def test_op5_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 101, (6, 4))
    codes[4:, 1] = 0  # past the end of a text
    want, p = np.array([0, 1, 1, 0]), tiny_network(rng)
    _, grad = langid.gradients(p, codes, want)
    for name in p:
        places = [(x, y) for x in range(p[name].shape[0]) for y in (range(96, 102) if name[0] == "w" else range(p[name].shape[1]))]
        for at in places:
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                sides.append(langid.gradients(moved, codes, want)[0])
            assert grad[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-7), (name, at)


def test_op5_positions_by_plain_arithmetic():
    rng = np.random.default_rng(1)
    p = tiny_network(rng)
    model = langid.Model(["a", "b"], [p["w0"], p["w1"]], [p["u0"], p["u1"]], [p["v0"], p["v1"]], p["bias"])
    codes = rng.integers(0, 256, 7)
    squash = lambda x: 1 / (1 + np.exp(-x))
    states = []
    for d in (0, 1):
        h, out = np.zeros(3), []
        for byte in codes[:: 1 - 2 * d]:
            a, b = p[f"w{d}"][:, byte], p[f"u{d}"] @ h
            z, r = squash(a[:3] + b[:3]), squash(a[3:6] + b[3:6])
            h = z * h + (1 - z) * np.tanh(a[6:] + r * b[6:])
            out.append(h)
        states.append(out[:: 1 - 2 * d])
    got = langid.label_positions(model, codes[:, None])
    for t in range(7):
        logits = p["v0"] @ states[0][t] + p["v1"] @ states[1][t] + p["bias"][:, 0]
        assert got[:, t, 0] == pytest.approx(np.exp(logits) / np.exp(logits).sum())


def test_op5_learns_two_alphabets():
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8)
    windows[20:] = rng.integers(65, 91, (20, langid.WINDOW))
    model = langid.train(windows, np.repeat([0, 1], 20), ["low", "up"])
    assert [langid.predict(model, [w.tobytes().decode()])[0][0] for w in windows] == ["low"] * 20 + ["up"] * 20


def brute_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op6_components(spark, texts):
    ids = IDS(len(texts))
    got = simhash.clusters(table(spark, texts, ids), 4, 4).collect()
    fps = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    want = [(d, f"{f:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(zip(ids, fps))]
    same_rows([(r.doc_id, r.fingerprint, r.component_id) for r in got], want)
    kept = simhash.keep_one(table(spark, texts, ids))
    assert kept.count() == len(least) and len(kept.columns) == len(SCHEMA.split(", "))


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5])
def test_op6_ball_finds_every_pair(monkeypatch, radius):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for f in list(fps[: 80 if radius < 5 else 20]):
        x = f
        for _ in range(rng.randrange(0, radius + 2)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    monkeypatch.setattr(simhash, "AT_ONCE", 1 << 14)
    fps = fps if radius < 5 else fps[::4]
    parts = [simhash.collisions(fps, p, 3, radius) for p in range(8)]
    got = simhash.forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    want = simhash.forest(fps[a[a != b]], fps[b[a != b]])
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_components_of_a_long_chain(spark):
    rows = [(i + 1, i) for i in range(60)] + [(200, 100), (200, 150)]
    got = dict(collect(simhash.components(spark.createDataFrame(rows, "high long, low long"))))
    assert got == {**{i: 0 for i in range(1, 61)}, 150: 100, 200: 100}


def brute_repeats(raw, n):
    c = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        flags = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                flags[i : i + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~flags]) if t else b""
        out.append((len(t), int(flags.sum()), int((np.diff(np.r_[0, flags.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "shard"), [(400, 60, 2000), (40, 10, 3)])
def test_op7_matches_brute_force(spark, texts, length, gram, shard):
    ids = IDS(len(texts))
    if shard == 3:  # grams with many contexts are divided over shards and merged
        base = "the quick brown fox jumps over the lazy dog and runs far away "
        texts = [*texts, *(f"{k} start " + base + f"{k * 7} end" for k in range(25))]
        ids = list(range(len(texts)))
    raw = [(t or "").encode() for t in texts]
    passage = 280 if length == 400 else 55
    shorter = [r[1:3] for r in brute_repeats(raw, passage)]
    want = [(i, *r, *p) for i, r, p in zip(ids, brute_repeats(raw, length), shorter)]
    docs = table(spark, texts, ids)
    same_rows(collect(suffix_dedup.digests(docs, length, gram, shard, shard, passage)), want)
    cut = suffix_dedup.remove_repeats(docs, length, gram, shard, shard)
    assert cut.columns == docs.columns and cut.count() == len(texts)


def test_op7_suffix_array_and_common_prefixes():
    rng = random.Random(7)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 8))]
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        sizes = np.array([len(p) for p in parts])
        stops = np.cumsum(sizes + 1) - 1
        ends = np.repeat(stops, sizes + 1)
        order, rank = suffix_dedup.suffix_array(data, ends, int(sizes.max()) + 1)
        suffixes = [data[i : ends[i]].tobytes() for i in range(len(data))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        for counts in (sizes + 1, np.array([rng.randrange(1, n + 1) for n in sizes])):  # all suffixes, and the first ones of each text
            inside = np.zeros(len(data), bool)
            for a, n in zip(stops - sizes, counts):
                inside[a : a + n] = True
            kept = inside[order]
            lcp = suffix_dedup.kasai(data, stops - sizes, counts, ends, order[kept], (np.cumsum(kept) - 1)[rank], 1000)
            for k in range(1, kept.sum()):
                a, b = suffixes[order[kept][k - 1]], suffixes[order[kept][k]]
                assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_licences(model, text):
    """Families (confirmed, unconfirmed) and the best probability of one text, paragraph by paragraph."""
    parts = [p for p in re.split(r"\n[^\S\n]*\n\s*", text or "") if p.strip()]
    units = [*parts, *(line for p in parts if "\n" in p for line in p.split("\n"))]
    sure, confirmed, best = set(), set(), 0.0
    for unit in units:
        words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", unit.lower())
        pairs = {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
        z = np.array(model["bias"]) + sum((np.array(model["weights"][g]) for g in {*words, *pairs} if g in model["weights"]), np.zeros(len(model["bias"])))
        p = np.exp((z - z.max()) / model["temperature"])
        p /= p.sum()
        family = model["classes"][int(p.argmax())]
        if family == "unknown" or p.max() < 0.5:
            continue
        best = max(best, float(p.max()))
        three = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        (confirmed if any(confirms(t, family, words, three) for t in licenses.TEMPLATES[family]) else sure).add(family)
    return len(parts), ",".join(sorted(confirmed)), ",".join(sorted(sure - confirmed)), best


def confirms(template, family, words, three):
    """Half of the trigrams, four or all; and on the right side of every near template of another family."""
    bag = lambda t: set(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))
    n, k = len(licenses.trigrams(template)), len(three & set(licenses.trigrams(template)))
    if 2 * k < n or k < min(n, 4):
        return False
    for other in (t for f, v in licenses.TEMPLATES.items() if f != family for t in v):
        mine, theirs = bag(template) - bag(other), bag(other) - bag(template)
        if bag(template) & bag(other) and len(mine) <= 3 and len(theirs) <= 3 and (mine - set(words) or theirs & set(words)):
            return False
    return True


LICENCES = licenses.TEMPLATES
#: Openings and parts of public licences that no template holds, and texts with such words that are no notices.
OPENINGS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction, including the rights to use, copy,\nmodify, merge, publish, and to permit persons to whom the Software is furnished to do so, subject to these conditions:"),
    ("gpl-3.0", "GNU General Public, version 3"),
    ("gpl-3.0", "This file is licensed under the GNU General Public License, version 3, or any later version"),
    ("apache-2.0", "Distributed under the Apache License, Version 2.0, see the file"),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
]
HARD = ["The dean said the licensed nurses work under the license office", "the software industry has grown", "a heron stands in public water", "Mit der Zeit kam er", *licenses.OTHERS]


@pytest.fixture(scope="module")
def licence_model():
    return licenses.train([f"ordinary line number {i} about herons and the source of the river mit dem Boot" for i in range(300)])


def test_op8_scores_every_paragraph(spark, texts, licence_model):
    cases = [(t, f) for f, v in LICENCES.items() for t in v]
    wrapped = [f"some words here\n\n{textwrap.fill(t, 72)}\n \nmore words" for t, _ in cases]
    notes = [f"some words here\n{t}" for t, _ in cases] + wrapped + [t for _, t in OPENINGS] + HARD + [None, "", "no notice at all\nlicense", "This work is licensed under the\n", " \n\n\t\n", "x " * 40_000 + "\n" + cases[0][0], *texts]
    docs = table(spark, notes)
    got = {r.doc_id: r for r in licenses.scan(docs, licence_model).collect()}
    for i, note in enumerate(notes):
        n, confirmed, unconfirmed, best = brute_licences(licence_model, note)
        assert (got[i].n_paragraphs, got[i].families, got[i].unconfirmed) == (n, confirmed, unconfirmed), note
        assert got[i].best_probability == pytest.approx(best, abs=1e-5)
    for k in range(len(wrapped)):
        assert got[len(cases) + k].n_paragraphs == 3
    right = [cases[i % len(cases)][1] in got[i].families.split(",") for i in range(2 * len(cases))]
    assert sum(right) >= 0.9 * len(right)
    for k, (family, _) in enumerate(OPENINGS):
        r = got[2 * len(cases) + k]
        assert family in [*r.families.split(","), *r.unconfirmed.split(",")], OPENINGS[k]
    assert not any(got[2 * len(cases) + len(OPENINGS) + k].families for k in range(len(HARD)))
    plan = licenses.scan(docs, licence_model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


TOLD_APART = [
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Distributed under the terms of the Apache 2.0 license", "apache-2.0"),
    (textwrap.fill("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", 40), "bsd"),
]


def test_op8_families_are_told_apart_by_the_shipped_model(spark, small):
    """The model as the query trains it, from the corpus: near families, and paragraphs with their lines."""
    model = licenses.train(licenses.sample_lines(runtime.documents(spark, small)))
    assert not {"the", "of", "a"} & set(model["hints"])
    got = {r.doc_id: r for r in licenses.scan(table(spark, [t for t, _ in TOLD_APART] + HARD), model).collect()}
    for i, (note, family) in enumerate(TOLD_APART):
        assert (got[i].families, got[i].unconfirmed) == (family, ""), note
    assert not any(got[len(TOLD_APART) + k].families for k in range(len(HARD)))
    for i, (note, _) in enumerate(TOLD_APART):
        n, confirmed, unconfirmed, best = brute_licences(model, note)
        assert (got[i].n_paragraphs, got[i].families, got[i].unconfirmed) == (n, confirmed, unconfirmed) and got[i].best_probability == pytest.approx(best, abs=1e-5)


def test_op8_short_templates_need_all_their_trigrams(licence_model):
    assert brute_licences(licence_model, "The dean said the licensed nurses work under the MIT license office")[1] == ""
    assert brute_licences(licence_model, "Released under the MIT License.")[1] == "mit"


def test_op8_temperature_is_of_left_out_templates():
    lines = [f"plain text {i} of ordinary things" for i in range(60)]
    texts, labels, folds, classes = licenses.examples(lines, np.random.default_rng(1))
    assert classes[-1] == "unknown" and set(folds) == {0, 1, 2}
    for family, templates in LICENCES.items():
        own = [set(folds[i] for i in np.flatnonzero(labels == classes.index(family)))]
        assert own == [set(range(min(3, len(templates))))]
    rng = np.random.default_rng(2)
    x = licenses.Sparse(texts, {g: i for i, g in enumerate(sorted({g for t in texts for g in licenses.grams(t.lower().split())}))})
    w, b, d = rng.normal(size=(x.size, 3)), rng.normal(size=3), rng.normal(size=(x.n, 3))
    assert (x.scores(w, b) * d).sum() == pytest.approx((w * x.gradient(d)).sum() + (d.sum(0) * b).sum())  # the gradient is the transpose of the scores


def test_op9_reads_back(spark, texts):
    ids = IDS(len(texts))
    docs = table(spark, texts, ids)
    got = sorted(collect(orc_tokens.store_and_read(docs, P.path("byte_bpe_50k.json"), 2)), key=lambda r: r[1])
    lists = {}
    for i, t in zip(ids, texts):
        x = np.array([*library_ids("byte_bpe_50k.json", t), 2], "<u4")
        lists.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d or 0))
    at, seen = 0, {}
    for d, start, n, crc in got:
        assert start == at
        at += n
        seen.setdefault(d, []).append((n, crc))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in lists.items()}


def test_op9_filter_reaches_the_files(spark, texts, tmp_path):
    path = str(tmp_path / "ids")
    orc_tokens.write_ids(table(spark, texts), path, P.path("byte_bpe_50k.json"), 2)
    found = orc_tokens.read_ids(spark, path).where("doc_id = 3")
    assert "EqualTo(doc_id,3)" in found._jdf.queryExecution().toString() and found.count() == 1


def test_op9_files_have_indexes_and_run_lengths(spark, tmp_path):
    docs = spark.range(0, 6000, 1, 4).selectExpr("id as doc_id", "repeat('the ', int(id % 50) + 50) as text")
    path = str(tmp_path / "ids")
    orc_tokens.write_ids(docs, path, P.path("byte_bpe_50k.json"), 2, row_index_stride=1000, stripe_bytes=1 << 16)
    files = sorted(Path(path).glob("*.orc"))
    rows, stripes = [], 0
    for f in files:
        orc = pyarrow.orc.ORCFile(str(f))
        stripes += orc.nstripes
        assert orc.row_index_stride == 1000 and orc.compression == "SNAPPY"
        found = [orc.read_stripe(k).to_pylist() for k in range(orc.nstripes)] if hasattr(orc.read_stripe(0), "to_pylist") else []
        rows += [r for part in found for r in part]
        assert f.stat().st_size < 4 * sum(len(r["ids"]) for part in found for r in part) / 20  # runs of one id
    assert stripes >= len(files) and sorted(r["doc_id"] for r in rows) == list(range(6000))
    for r in rows[::500]:
        assert r["ids"] == [*library_ids("byte_bpe_50k.json", "the " * (r["doc_id"] % 50 + 50)), 2]


def test_op10_chain_by_plain_arithmetic():
    rng = np.random.default_rng(4)
    known = {w.encode(): i for i, w in enumerate("abcdefghij")}
    texts = [" ".join(rng.choice(list("abcdefghijxyz"), rng.integers(0, 12))) for _ in range(90)]
    labels = np.stack([["a" in t.split() for t in texts], ["b" in t.split() or "a" in t.split() and "c" in t.split() for t in texts]], 1).astype(int)
    fold, rows = np.arange(90) % toxicity.FOLDS, toxicity.Chain(known, []).rows(texts)
    chain = toxicity.train_chain(known, rows, labels, fold)
    squash, odds = lambda z: 1 / (1 + np.exp(-z)), lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))) / 4
    got = chain.predict(rows)
    for i, t in enumerate(texts):
        out = []
        for w, u, b in chain.links:
            z = b + sum(w[known[x.encode()]] for x in set(t.split()) if x.encode() in known) + sum(odds(p) * k for p, k in zip(out, u))
            out.append(squash(z))
        assert [g[i] for g in got] == pytest.approx(out)
    # the second link learns from what models that had not seen a row say of it
    outside = np.zeros(90)
    for f in range(toxicity.FOLDS):
        w, _, b = toxicity.logistic(rows.take(fold != f), np.zeros(((fold != f).sum(), 0)), labels[fold != f, 0].astype(float), len(known))
        outside[fold == f] = squash(rows.take(fold == f).scores(w) + b)
    w, u, b = toxicity.logistic(rows, odds(outside)[:, None], labels[:, 1].astype(float), len(known))
    assert chain.links[1][0] == pytest.approx(w) and chain.links[1][1] == pytest.approx(u)


def test_op10_learns_words_and_chains(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(60)) for _ in range(400)]
    toxic = [i % 4 == 0 for i in range(400)]
    text = [t + (f" {rng.choice(['nasty', 'vile'])}" if x else "") for t, x in zip(base, toxic)]
    text = [t + (" spam" if i % 3 == 0 else "") for i, t in enumerate(text)]
    docs = table(spark, text + [None, "", "vile"])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(x)) for i, x in enumerate(toxic[:300])] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 403 and all(got[i].toxic == toxic[i] for i in range(400))
    assert got[402].toxic and not got[400].toxic and not got[401].toxic
    assert all((got[i].p_low_quality > 0.5) == (i % 3 == 0) for i in range(400))
    none = toxicity.classify(docs, toxicity.fit(docs, labels.where("doc_id < 0"))).collect()
    assert {(r.p_toxic, r.toxic) for r in none} == {(0.0, False)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, small, texts, tmp_path, name):
    """On the smallest tables, and on odd texts with null ids and repeated rows."""
    table(spark, texts, IDS(len(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    for folder, files in ((small, f"{small}/documents.parquet"), (str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        df = queries.QUERIES[name](spark, folder)
        want = con.sql(queries.ORACLE_SQL[name])
        assert dict(zip(want.columns, map(str, want.types))).keys() == set(df.columns)
        columns = sorted(df.columns)
        same_rows(collect(df.select(*columns)), want.select(*columns).fetchall())


def test_empty_tables(spark, tmp_path):
    empty = table(spark, ["x"]).where("doc_id < 0")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def near_components(texts, shingle=5):
    """Least index of each component of texts 4 bits apart or with a Jaccard similarity of 0.8 or more, by brute force."""
    sets, fps = [], [brute_fingerprint(t) for t in texts]
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            near = (fps[a] ^ fps[b]).bit_count() <= 4 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            if near and label[a] != label[b]:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    return sorted(set(label))


def test_pipeline_stages(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        kept.append(docs)
        counts.append(docs.count())
    for before, after, n in zip([spark.read.parquet(f"{small}/documents.parquet"), *kept], kept[:4], names):
        assert after.columns == columns, n
    quality, single, cut, packed = kept[1], kept[2], kept[3], kept[4]
    want = {r.doc_id for r in kept[0].collect() if repetition.measure(r.text)[-1]}
    assert {r.doc_id for r in quality.collect()} == want
    rows = quality.orderBy("doc_id").collect()
    assert {r.doc_id for r in single.collect()} == {rows[k].doc_id for k in near_components([r.text for r in rows])}
    assert [r.text for r in cut.orderBy("doc_id").collect()] == brute_passages([r.text for r in single.orderBy("doc_id").collect()])
    total = sum(len(library_ids("word_bpe_49k.json", r.text)) + 1 for r in cut.collect())
    assert packed.agg(F.sum("length")).first()[0] == total


@pytest.mark.parametrize("block", [2048, 4])
def test_near_copies_of_a_few_words_are_one(spark, texts, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng, base, other = random.Random(8), texts[9].split(), texts[12].split()
    many = list(texts)
    for words in (base, other):
        for k in range(14):
            copy = list(words)
            for at in rng.sample(range(len(copy)), 1 + k % 6):
                copy[at] = f"changed{k}"
            many.append(" ".join(copy))
    docs = table(spark, many)
    want = near_components(many)
    assert len(want) < simhash.keep_one(docs, 4, 4).count()
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    staged = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in staged.collect()) == want
    assert near_copies.keep_one(docs.where("doc_id < 0")).count() == 0


def brute_passages(texts, n=51):
    """Texts without the words of any n-word string that starts twice or more, first word's begin to last word's end."""
    words = [list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    strings = Counter(tuple(m.group() for m in ws[i : i + n]) for ws in words for i in range(len(ws) - n + 1))
    out = []
    for text, ws in zip(texts, words):
        inside = [False] * (len(ws) + 1)
        for i in range(len(ws) - n + 1):
            if strings[tuple(m.group() for m in ws[i : i + n])] > 1:
                inside[i : i + n] = [True] * n
        data, at, kept, i = (text or "").encode(), 0, [], 0
        while i < len(ws):
            if inside[i]:
                end = inside.index(False, i)
                kept.append(data[at : ws[i].start()])
                at, i = ws[end - 1].end(), end
            else:
                i += 1
        out.append(None if text is None else b"".join([*kept, data[at:]]).decode())
    return out


@pytest.mark.parametrize(("letters", "low", "high"), [((1, 2), 101, 280), ((1, 6), 150, 280), ((3, 9), 250, 420)])
def test_pipeline_cuts_passages_of_over_50_words(spark, letters, low, high):
    """Passages of any size in bytes that documents share go; documents that share less stay as they are."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randrange(*letters)))
    make = lambda n: " ".join(word() + rng.choice("xyz") * (letters[1] < 3 and rng.random() < 0.3) for _ in range(n))
    shared = [make(51 + k) for k in range(8)]
    assert low <= min(len(p.encode()) for p in shared) < high
    fifty = make(50)
    texts = [f"{make(60)} {shared[k % 8]} {make(50)}" for k in range(24)] + [make(150) for _ in range(20)]
    texts += [f"{make(30)} {fifty} {make(30)}" for _ in range(3)] + [shared[0].replace(" ", "\n", 3), "a " * 300, "b " * 50, None, "", make(20) + " " + " ".join([shared[1]] * 3)]
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, table(spark, texts), "").collect()}
    want = brute_passages(texts)
    assert [cut[k] for k in range(len(texts))] == want
    assert all(shared[k % 8] not in cut[k] and len(cut[k].split()) <= 112 for k in range(24))
    if letters[0] == 3:
        assert all(cut[k] == texts[k] for k in range(24, 47))


def test_passages_in_divided_and_tiny_shards(spark):
    """Many texts around one passage, over several shards."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 70))) + f" {passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(70)) for _ in range(60)]
    cut = suffix_dedup.remove_passages(table(spark, texts), shard=5, most=7)
    assert [r.text for r in cut.orderBy("doc_id").collect()] == brute_passages(texts)


def test_names_held_by_different_sets_are_given_anew(spark, texts, monkeypatch):
    right = near_copies.names_of
    monkeypatch.setattr(near_copies, "names_of", lambda found, salt: (right(found, salt)[0] >> (56 if salt < 2 else 0), right(found, salt)[1]))
    want = near_components(texts)
    assert sorted(r.doc_id for r in near_copies.keep_one(table(spark, texts)).collect()) == want


def test_pipeline_odd_rows(spark):
    """Empty tables, null ids, texts and languages, repeated rows and clashing columns pass through every stage."""
    odd = [None, "", " ", "word", "日本語 " * 30] + ["the heron stands in the water and waits for fish " + " ".join(f"w{k}" for k in range(90))] * 3
    ids = [None, 1, 1, 2, 3, None, 4, 4]
    for docs in (table(spark, odd, ids).withColumn("lang", F.lit(None).cast("string")), table(spark, odd, ids), table(spark, odd, ids).where("doc_id < 0")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            assert docs.columns == columns
            docs = materialize(stage(spark, docs, ""), f"test-odd-{name}")
        assert "sequence_id" in docs.columns

def test_frequent_keys_are_not_gathered(spark):
    """Joins past a broadcast for frequent keys: the same rows as a plain join, whichever keys are frequent."""
    many = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(5000)] + [(9, -1)], "key long, row long")
    one = many.groupBy("key").agg(F.count("*").alias("held"), F.min("row").alias("least")).where("key <> 5")
    want = sorted(map(tuple, many.join(one, "key").collect()))
    for total in (0, 10, 2_000_000, 10**9):  # all, most, one and no key frequent
        got = runtime.join_hot(many, one, ["key"], runtime.hot(one, "held", total))
        assert got.columns == ["key", "row", "held", "least"]
        assert sorted(map(tuple, got.collect())) == want
