"""Byte-level BPE in overlapping chunks: pre-tokenise in parallel, stitch, encode; decode by joining bytes.

A text of any length is cut into chunks that overlap. Chunks are rows, so one long text keeps
many tasks busy. Each chunk is pre-tokenised from its own start, which may lie inside a
pre-token; as the pattern never looks behind, two runs that share one boundary agree from there
on. Stitching follows the true run to its last boundary that the chunk's end cannot have
influenced, and goes on in the next chunk if that has the same boundary; where it has not (a
pre-token longer than the overlap), it matches on in the text itself until they meet.

Defined results: a null text is an empty text and has no ids. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.runtime import id_text

STEP = 16_384
OVERLAP = 512
#: A match that ends so many characters before the chunk's end was not influenced by it: the
#: pattern reads at most two characters past a match.
MARGIN = 8
REMEMBERED = 500_000
LONGEST_KEPT = 64

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_loaded: dict[tuple[str, str], "Ranks"] = {}


class Ranks(dict):
    """Pre-token -> id bytes (little-endian unsigned 32-bit), by the merges of a rank file."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoding._encode_single_piece(piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = found
        return found

    def encode(self, pieces: list[str]) -> bytes:
        if len(self) > REMEMBERED:  # frequent pieces are met early, so the first half stays
            kept = list(islice(self.items(), REMEMBERED // 2))
            self.clear()
            self.update(kept)
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
    return _loaded[path, pattern]


def chunks(text: str, step: int = STEP, overlap: int = OVERLAP) -> list[str]:
    return [text[at : at + step + overlap] for at in range(0, max(1, len(text)), step)]


def boundaries(pattern, chunk: str) -> np.ndarray:
    """Ends of the pre-tokens of one chunk, relative to its start."""
    return np.cumsum(np.fromiter(map(len, pattern.findall(chunk)), np.int32), dtype=np.int32)


def stitch(pattern, parts: list[str], ends: list[np.ndarray], step: int = STEP) -> list[str]:
    """The pre-tokens of the whole text from the boundaries of its chunks."""
    text = "".join([p[:step] for p in parts[:-1]] + parts[-1:])
    true, at = [0], 0
    for k, (part, found) in enumerate(zip(parts, ends)):
        base = k * step
        limit = len(text) if k == len(parts) - 1 else base + len(part) - MARGIN
        own = found.astype(np.int64) + base
        own = own[own <= limit]
        meets = set(own.tolist())
        meets.add(base)
        while at < limit and at not in meets:
            at = pattern.match(text, at).end()
            true.append(at)
        if at in meets:
            more = own[np.searchsorted(own, at, "right") :].tolist()
            if more:
                true += more
                at = more[-1]
    return [text[a:b] for a, b in zip(true, true[1:])]


def digest(ranks: Ranks, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(ranks.decode(ids)).hexdigest()


def _digests(docs: list, ids: list[bytes], ranks: Ranks) -> pa.RecordBatch:
    columns = list(zip(*[digest(ranks, i) for i in ids])) or [()] * 3
    kinds = [pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *map(pa.array, columns, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_and_decode(docs: DataFrame, path: str, pattern: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Per document its number of ids, and digests of the ids and of the bytes decoded from them.

    A text of one chunk needs no stitching and is done where it is read; the chunks of longer
    ones are dealt out, pre-tokenised, and come together by document.
    """
    rows = id_text(docs)
    short = F.length("text") <= step

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [ranks.encode(ranks.pattern.findall(t)) for t in part.column(1).to_pylist()]
                yield _digests(part.column(0).to_pylist(), ids, ranks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = chunks(text, step, overlap)
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"uid": [uid] * n, "doc_id": pa.array([doc] * n, pa.int64()), "k": range(n), "chunk": parts}, pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("chunk", pa.string())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            found = [boundaries(ranks.pattern, c).tobytes() for c in batch.column(3).to_pylist()]
            yield batch.append_column("ends", pa.array(found, pa.binary()))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        ranks = load(path, pattern)
        group = group.sort_values("k")
        ends = [np.frombuffer(e, np.int32) for e in group.ends]
        ids = ranks.encode(stitch(ranks.pattern, group.chunk.tolist(), ends, step))
        return _digests([None if pd.isna(group.doc_id.iloc[0]) else int(group.doc_id.iloc[0])], [ids], ranks).to_pandas()

    done = rows.where(short).mapInArrow(whole, OUT)
    long = rows.where(~short).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    pieces = long.mapInArrow(cut, "uid long, doc_id long, k long, chunk string").repartition("uid", "k")
    ended = pieces.mapInArrow(split, "uid long, doc_id long, k long, chunk string, ends binary")
    return done.unionByName(ended.groupBy("uid").applyInPandas(join, OUT))
