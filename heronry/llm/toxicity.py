"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after the other; each model sees the words of a text and the
probabilities of all categories before it. In training those probabilities come from models
that have not seen the row (out-of-fold), as they will be when predicting.

Categories here are the labelled ones: low quality, then toxic. Defined results: a null or empty
text has no words and gets the chain's bias; rows with a null id or label are not learned from;
without labelled rows every probability is zero. Repeated rows are judged each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.runtime import id_text, materialize

#: The bound of what is learned from: labelled documents of each combination of labels.
SAMPLE_EACH = 2500
#: Words of fewer documents of the sample are not learned.
LEAST_SEEN = 8
#: Words enter the vocabulary when so many standard deviations off chance; most words of a text
#: say nothing about it, and models that see them learn the sample by heart.
LEAST_OFF = 5
FOLDS = 3
ROUNDS = 150
STEM = 5
#: The sample holds more toxic documents than the corpus does, yet one toxic word among clean ones
#: weighs little: on held-out labelled documents 0.3 finds most of them and no clean one.
THRESHOLD = 0.3
CATEGORIES = ("low_quality", "toxic")

#: ASCII punctuation becomes blank and A-Z lower case; all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: str) -> set[bytes]:
    """Distinct words, and the first bytes of longer ones marked as such: rare forms share a stem."""
    found = set(text.encode("utf-8", "replace").translate(_FOLD).split())
    return found | {b"^" + w[:STEM] for w in found if len(w) > STEM}


@dataclass
class Rows:
    """Sparse rows of word indexes with dense extra columns (earlier probabilities as log odds)."""

    ends: np.ndarray
    index: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(w[self.index])]
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def gradient(self, d: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(d, np.diff(self.ends)), size)

    def take(self, keep: np.ndarray) -> "Rows":
        sizes = np.diff(self.ends)
        return Rows(np.r_[0, np.cumsum(sizes[keep])], self.index[np.repeat(keep, sizes)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_odds(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))) / 4


def logistic(rows: Rows, extra: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of words, weights of extra columns and bias, by Adam on the whole sample."""
    w, u, b = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, u, np.zeros(1))]
    for step in range(1, ROUNDS + 1):
        d = (sigmoid(rows.scores(w) + extra @ u + b) - y) / max(1, len(y))
        grads = [rows.gradient(d, size) + 1e-4 * w, extra.T @ d + 1e-4 * u, np.array([d.sum()])]
        moves = []
        for (m, v), g in zip(state, grads):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            moves.append(0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6))
        w, u, b = w - moves[0], u - moves[1], b - float(moves[2][0])
    return w, u, b


@dataclass
class Chain:
    known: dict[bytes, int]
    links: list[tuple[np.ndarray, np.ndarray, float]]

    def predict(self, rows: Rows) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for w, u, b in self.links:
            extra = np.stack([log_odds(p) for p in out], 1) if out else np.zeros((len(rows.ends) - 1, 0))
            out.append(sigmoid(rows.scores(w) + extra @ u + b))
        return out

    def rows(self, texts: list[str]) -> Rows:
        found, known = [], self.known
        for t in texts:
            found.append([known[x] for x in words(t) if x in known])
        ends = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
        return Rows(ends, np.array([i for f in found for i in f], np.int64))


def train_chain(known: dict[bytes, int], rows: Rows, labels: np.ndarray, fold: np.ndarray) -> Chain:
    extra, links = np.zeros((len(labels), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        links.append(logistic(rows, extra, y, len(known)))
        if k + 1 == labels.shape[1]:
            break
        outside = np.full(len(y), 0.5)
        for f in range(FOLDS):
            out = fold == f
            w, u, b = logistic(rows.take(~out), extra[~out], y[~out], len(known))
            outside[out] = sigmoid(rows.take(out).scores(w) + extra[out] @ u + b)
        extra = np.c_[extra, log_odds(outside)]
    return Chain(known, links)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents, about ``SAMPLE_EACH`` of each combination, chosen by a hash of the id."""
    flags = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    counts = {(r["low_quality"], r["toxic"]): r["n"] for r in flags.groupBy("low_quality", "toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(-1)
    for (low, toxic), n in counts.items():
        share = F.when((F.col("low_quality") == low) & (F.col("toxic") == toxic), F.lit(int((1 << 30) * min(1.0, SAMPLE_EACH / n)))).otherwise(share)
    place = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30))
    chosen = flags.where(place <= share).orderBy(place, "id").limit(2 * SAMPLE_EACH * max(1, len(counts)))
    # the limit bounds the broadcast
    return id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "low_quality", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    sample = materialize(_sample(docs, labels), "toxic-sample")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, toxic, text in zip(frame["low_quality"], frame["toxic"], frame["text"]):
                found = list(words(text))
                yield pd.DataFrame({"word": found, "low_quality": low, "toxic": toxic})

    seen = sample.select("low_quality", "toxic", "text").mapInPandas(spread, "word binary, low_quality int, toxic int")
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum("low_quality").alias("q")).first()
    n = max(1, total["n"])
    counted = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("low_quality").alias("q"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_SEEN)

    def off(c: str) -> F.Column:
        """Standard deviations between a word's count in a category and the count expected."""
        p = min(max((total[c] or 0) / n, 1e-6), 1 - 1e-6)
        return F.abs(F.col(c) - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))

    far = counted.withColumn("off", F.greatest(off("q"), off("t"))).where(F.col("off") >= LEAST_OFF)
    top = far.select("word").collect()
    known = {bytes(r["word"]): i for i, r in enumerate(sorted(top))}
    coder = Chain(known, [])

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = coder.rows(frame["text"].tolist())
            parts = [rows.index[a:b].astype("<i4").tobytes() for a, b in zip(rows.ends[:-1], rows.ends[1:])]
            yield frame.drop(columns="text").assign(index=parts)

    got = sample.mapInPandas(code, "id long, low_quality int, toxic int, index binary").toPandas().sort_values(["id", "low_quality", "toxic"], ignore_index=True)
    if not len(got) or not known:
        return Chain({}, [])
    lists = [np.sort(np.frombuffer(b, "<i4")) for b in got["index"]]
    rows = Rows(np.r_[0, np.cumsum(list(map(len, lists)))], np.concatenate(lists).astype(np.int64))
    fold = (got["id"].to_numpy(np.int64) * 2654435761 >> 16) % FOLDS
    return train_chain(known, rows, got[list(CATEGORIES)].to_numpy(np.int64), fold)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability for each category, and ``toxic``."""
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = chain.predict(chain.rows(part.column(1).to_pylist())) or [np.zeros(part.num_rows)] * len(CATEGORIES)
                columns = [part.column(0), *[pa.array(p, pa.float64()) for p in found], pa.array(found[-1] >= THRESHOLD)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    return id_text(docs).mapInArrow(run, schema)
