"""Quality rules on repetition: characters covered by duplicated word n-grams and lines.

Each text is hashed word by word; n-gram hashes of every length roll from those of the length
before it in numpy, and the characters under the windows that occur more than once are counted.

Defined results: a null or empty text has no words, fails the base rule and is not kept.
Repeated rows are judged each on their own. Columns other than those named are not read, except
by ``filter_kept``, which returns its input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols counted, and the largest share of characters that may lie inside
#: duplicated n-grams of each length, or inside lines equal to an earlier one. Characters of first
#: occurrences count as duplicated too, so one line said twice costs twice its share.
SYMBOLS = "#*$%&|<>"
MOST_COVERED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
MOST_IN_LINES = 0.25
BASE_WINDOW = 8
BASE_LEAST_WORDS = 20
BASE_MOST_REPEATED = 30  # per cent of the words

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "dup_line_share": pa.float64(), "dup_gram_share": pa.float64(), "kept": pa.bool_(),
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_share double, dup_gram_share double, kept boolean"


def covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Which words lie in an n-word window whose hash occurs twice or more; None if there is none."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str) -> tuple:
    """One text's counts and verdict, in the order of ``FIELDS``."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # at the six ASCII white-space bytes
    n = len(words)
    in_words = len(text) - (len(data) - sum(map(len, words)))
    size = len if len(data) == len(text) else lambda part: len(part.decode("utf-8", "replace"))  # in characters
    lines = [line for line in data.split(b"\n") if line.strip()]
    seen: set[bytes] = set()
    doubled = 0
    for line in lines:
        if line in seen:
            doubled += size(line)
        seen.add(line)
    repeated, worst, fine = 0, 0.0, True
    if n >= 5:
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        hashes ^= hashes >> np.uint64(29)
        lengths = np.fromiter(map(size, words), np.int64, n)
        total = int(lengths.sum())
        rolled = hashes
        for k in range(2, max(MOST_COVERED) + 1):
            if k > n:
                break
            rolled = rolled[:-1] * _MULTIPLIER + hashes[k - 1 :]
            if k not in MOST_COVERED:
                continue
            inside = covered(rolled, k, n)
            if inside is None:  # then no longer window is doubled either
                break
            if k == BASE_WINDOW:
                repeated = int(inside.sum())
            share = int(lengths[inside].sum()) / total
            worst, fine = max(worst, share), fine and share <= MOST_COVERED[k]
    failed = n < BASE_LEAST_WORDS or 100 * repeated > BASE_MOST_REPEATED * n
    in_lines = doubled / max(1, sum(map(size, lines)))
    kept = not failed and fine and in_lines <= MOST_IN_LINES
    return n, in_words, sum(map(text.count, SYMBOLS)), len(lines) - len(seen), repeated, failed, in_lines, worst, kept


def _measured(texts: list[str]) -> list[pa.Array]:
    columns = list(zip(*map(measure, texts))) or [()] * len(FIELDS)
    return [pa.array(c, kind) for c, kind in zip(columns, FIELDS.values())]


def rules(docs: DataFrame) -> DataFrame:
    """doc_id with every count and the verdict ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_measured(batch.column(1).to_pylist())], ["doc_id", *FIELDS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + SCHEMA)


def filter_kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([measure(t)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
