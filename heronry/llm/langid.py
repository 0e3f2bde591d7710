"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into windows, all of them; two recurrent passes run over many windows in
lockstep, every position gets a label distribution, and a document's score is the mean over its
letter positions. Training is backpropagation through time on a bounded sample of windows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
when nothing was labelled to learn from. A null ``doc_id`` is not held out and is not learned
from. Repeated rows are labelled each on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 64
HIDDEN = 8
#: Bound of the training sample: documents of each language, and windows of each document.
SAMPLE_DOCS = 400
#: Values of ``lang`` that are learned, the most frequent ones: a bound on the sample where the column is dirty.
MOST_LANGUAGES = 256
SAMPLE_WINDOWS = 8
STEPS = 260
BATCH = 160
RATE = 0.02
UNKNOWN = "und"
HELD_OUT = 2

#: Windows that run in lockstep; bounds the memory of a task whatever the texts' lengths.
LOCKSTEP = 4096


@dataclass
class Model:
    """Weights as float32; of each direction: input table, recurrent matrix, output matrix."""

    languages: list[str]
    w: list[np.ndarray]  # (3H, 256) gate inputs of each byte value
    u: list[np.ndarray]  # (3H, H)
    v: list[np.ndarray]  # (L, H)
    bias: np.ndarray  # (L, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_direction(w: np.ndarray, u: np.ndarray, codes: np.ndarray, keep: bool = False):
    """States (T, H, N) of one pass over codes (T, N); with ``keep`` also what backpropagation needs."""
    steps, n = codes.shape
    h3, h = u.shape
    state, out, saved = np.zeros((h, n), w.dtype), np.empty((steps, h, n), w.dtype), []
    for t in range(steps):
        a = w.take(codes[t], axis=1)
        b = u @ state
        gates = _squash(np.clip(a[: 2 * h] + b[: 2 * h], -30, 30))
        z, r = gates[:h], gates[h:]
        c = np.clip(a[2 * h :] + r * b[2 * h :], -15, 15)
        c *= 2
        c = _squash(c)
        c *= 2
        c -= 1
        if keep:
            saved.append((state, z, r, c, b[2 * h :]))
        state = c + z * (state - c)
        out[t] = state
    return (out, saved) if keep else out


def label_positions(model: Model, codes: np.ndarray) -> np.ndarray:
    """Probabilities (L, T, N) of every language at every position of windows (T, N)."""
    there = run_direction(model.w[0], model.u[0], codes)
    back = run_direction(model.w[1], model.u[1], codes[::-1])[::-1]
    logits = np.einsum("lh,thn->ltn", model.v[0], there, optimize=True)
    logits += np.einsum("lh,thn->ltn", model.v[1], back, optimize=True)
    logits += model.bias[:, :, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def gradients(p: dict[str, np.ndarray], codes: np.ndarray, want: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the positions of windows (T, N) with a byte, and its gradient, by backpropagation through time."""
    t_max, n = codes.shape
    h, kind = p["u0"].shape[1], p["u0"].dtype
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    runs = [run_direction(p[f"w{d}"], p[f"u{d}"], codes[:: 1 - 2 * d], True) for d in (0, 1)]
    states = [runs[0][0], runs[1][0][::-1]]
    logits = sum(np.einsum("lh,thn->ltn", p[f"v{d}"], states[d]) for d in (0, 1)) + p["bias"][:, :, None]
    logits -= logits.max(axis=0)
    prob = np.exp(logits)
    prob /= prob.sum(axis=0)
    weight = (codes > 0).astype(kind)
    weight /= max(1.0, float(weight.sum()))
    loss = float(-(np.log(prob[want, :, np.arange(n)]).T * weight).sum())
    prob[want, :, np.arange(n)] -= 1
    delta = prob * weight
    grad["bias"] += delta.sum(axis=(1, 2))[:, None]
    for d in (0, 1):
        grad[f"v{d}"] += np.einsum("ltn,thn->lh", delta, states[d])
        into = np.einsum("lh,ltn->thn", p[f"v{d}"], delta)[:: 1 - 2 * d]
        u, order = p[f"u{d}"], codes[:: 1 - 2 * d]
        dh = np.zeros((h, n), kind)
        gates = np.empty((t_max, 3 * h, n), kind)
        for t in range(t_max - 1, -1, -1):
            before, z, r, c, bc = runs[d][1][t]
            dh = dh + into[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * bc * r * (1 - r)
            gates[t] = np.concatenate([dz, dr, dc])
            back = np.concatenate([dz, dr, dc * r])
            grad[f"u{d}"] += back @ before.T
            dh = dh * z + u.T @ back
        np.add.at(grad[f"w{d}"].T, order.reshape(-1), gates.transpose(0, 2, 1).reshape(-1, 3 * h))
    return loss, grad


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fit on windows (N, WINDOW) of bytes with a language index each, by Adam."""
    rng, h, n_lang = np.random.default_rng(seed), HIDDEN, len(languages)
    small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {f"{k}{d}": small(*s) for d in (0, 1) for k, s in (("w", (3 * h, 256)), ("u", (3 * h, h)), ("v", (n_lang, h)))}
    p["bias"] = np.zeros((n_lang, 1), np.float32)
    first, second = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    steps = STEPS if len(windows) else 0
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        _, grad = gradients(p, np.ascontiguousarray(windows[pick].T), labels[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k, g in grad.items():
            g *= min(1.0, 1.0 / (size + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, [p["w0"], p["w1"]], [p["u0"], p["u1"]], [p["v0"], p["v1"]], p["bias"])


_LETTER_BYTES = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of whole texts; the windows of all of them run together."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    total = int(counts.sum())
    if not total or not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    joined = b"".join(r.ljust(int(c) * WINDOW, b"\0") for r, c in zip(raw, counts))
    windows = np.frombuffer(joined, np.uint8).reshape(total, WINDOW)
    pooled, letters = np.zeros((total, len(model.languages))), np.zeros(total)
    for at in range(0, total, LOCKSTEP):
        part = windows[at : at + LOCKSTEP]
        inside = _LETTER_BYTES[part.T].astype(np.float32)
        prob = label_positions(model, np.ascontiguousarray(part.T))
        pooled[at : at + LOCKSTEP] = np.einsum("ltn,tn->nl", prob, inside)
        letters[at : at + LOCKSTEP] = inside.sum(axis=0)
    owner = np.repeat(np.arange(len(texts)), counts)
    by_doc = np.stack([np.bincount(owner, pooled[:, k], len(texts)) for k in range(pooled.shape[1])], 1)
    n_letters = np.bincount(owner, letters, len(texts))
    out = []
    for text, p, n in zip(texts, by_doc, n_letters):
        if not n or not any(map(str.isalpha, text or "")):
            out.append((UNKNOWN, 0.0))
        else:
            k = int(p.argmax())
            out.append((model.languages[k], float(min(1.0, p[k] / n))))
    return out


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 7) -> Model:
    """Train on at most ``sample_docs`` documents of each of the ``MOST_LANGUAGES`` most frequent languages that are not held out.

    The sample is chosen by a hash of the id, so it does not depend on partitions or order, and
    of each document windows are taken from all over the text. Only they reach the driver.
    """
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learn = learn.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    common = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], [], [], [], np.zeros((0, 1), np.float32))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = F.lit(-1)
    for k in languages:
        share = F.when(F.col("lang") == k, F.lit(int((1 << 30) * min(1.0, sample_docs / counts[k])))).otherwise(share)

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for lang, text in zip(frame["lang"], frame["text"]):
                data = text.encode("utf-8", "replace")
                last = max(0, len(data) - WINDOW)
                for k in range(SAMPLE_WINDOWS if last else 1):
                    at = last * k // max(1, SAMPLE_WINDOWS - 1)
                    rows.append((lang, data[at : at + WINDOW].ljust(WINDOW, b"\0")))
            yield pd.DataFrame(rows, columns=["lang", "window"])

    sample = learn.where(place <= share).select("lang", "text").mapInPandas(windows, "lang string, window binary")
    bound = 2 * sample_docs * SAMPLE_WINDOWS * len(languages)
    got = sample.limit(bound).toPandas().sort_values(["lang", "window"], ignore_index=True)
    data = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    index = {k: i for i, k in enumerate(languages)}
    labels = got["lang"].map(index).to_numpy(np.int64)
    # every language weighs the same: its windows are repeated up to those of the largest
    most = np.bincount(labels, minlength=len(languages)).max(initial=0)
    rng = np.random.default_rng(seed)
    even = np.concatenate([rng.choice(own, most) for k in range(len(languages)) if len(own := np.flatnonzero(labels == k))] or [np.zeros(0, int)])
    return train(data[even], labels[even], languages, seed)


def _batches(texts: list) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= LOCKSTEP * WINDOW or i - start >= 2000:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def labelled(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    return [r for a, b in _batches(texts) for r in predict(model, texts[a:b])]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = labelled(model, batch.column(2).to_pylist())
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(remainder(doc_id) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = labelled(model, batch.column(at).to_pylist())
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in found], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT
