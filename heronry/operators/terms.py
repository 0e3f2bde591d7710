"""Texts as their different words, counted in the row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: a list of words is much larger in Python than in Arrow."""
    return (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about ``size`` bytes together, at most ``rows`` of them."""
    for batch in batches:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            used = int(before[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(before, used + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def occurrences(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Of each whitespace token of texts, in order, its row and itself: the tokens of ``scalars.tokens``."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts])  # a slice with a buffer of its own
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    # bytes below 128 are never part of a longer character
    plain = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(np.where((raw >= 9) & (raw <= 13), np.uint8(32), raw)), offset=texts.offset)
    lists = pc.split_pattern(plain, " ")
    row, token = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy()), lists.flatten()
    some = pc.not_equal(token, "")
    return row[some.to_numpy(zero_copy_only=False)], token.filter(some)


def counts(row: np.ndarray, token: pa.StringArray, ordered: bool = False) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Of each different token of a row, in the order of rows (and of tokens, if asked for), the row, the token and its count."""
    if not len(row):
        return row, token, np.zeros(0, np.int64)
    named = token.dictionary_encode()
    n, place, words = len(named.dictionary), named.indices.to_numpy(), named.dictionary
    if ordered:
        order = pc.sort_indices(words)
        rank = np.empty(n, np.int64)
        rank[order.to_numpy()] = np.arange(n)
        place, words = rank[place], words.take(order)
    pair, tf = np.unique(row.astype(np.int64) * n + place, return_counts=True)
    return pair // n, words.take(pa.array(pair % n)), tf


def squares(row: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
    """The squared norm of each of ``rows`` rows, exactly."""
    total = np.zeros(rows, np.int64)
    np.add.at(total, row, tf.astype(np.int64) ** 2)
    return total
