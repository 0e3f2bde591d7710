"""Media columns in GIF: lossless 8-bit samples, LZW both ways, rendered frames with histograms.

``encode_gif`` writes timed frames of palette samples; ``decode_gif`` reads any GIF87a/89a: LZW
code streams of every code size, global and local palettes, interlacing, transparency, and the
disposal of each frame before the next is drawn. ``frames`` turns a column of GIFs into one row
per rendered frame with its time and its colour histogram.

Defined results: a null text is an empty text (64 zero bytes, one frame). A GIF that is null or
cannot be read gives no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.runtime import id_text, materialize, shared_path

WIDTH = 64
#: Rows of samples in a frame; a longer payload goes on in the next frame.
ROWS = 1024
#: A larger canvas or frame is refused: a rendered one takes four bytes a pixel.
MOST_PIXELS = 1 << 24
DELAY = 10  # hundredths of a second
#: Samples that may be expanded without being counted, and those of a code in the most hostile stream on average.
MOST_UNCOUNTED = 1 << 26
_MEAN_LONGEST = 2048

_ORDER = np.arange(1, 4098)


@cache
def _widths(clear: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the 1st, 2nd, ... code after a clear code, known from the count alone, and their sums before."""
    widths = np.minimum(12, np.floor(np.log2(clear + _ORDER)).astype(np.int64) + 1)
    return widths, np.cumsum(widths) - widths


def lzw_codes(data: bytes, size: int = 8) -> list[int]:
    """LZW codes of samples, a clear code first and whenever the table is full, an end code last."""
    clear = 1 << size
    codes, table, free = [clear], {}, clear + 2
    out, get = codes.append, table.get
    if data:
        prefix = data[0]
        for c in memoryview(data)[1:]:
            key = prefix << 8 | c
            found = get(key)
            if found is not None:
                prefix = found
                continue
            out(prefix)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                out(clear)
                table.clear()
                free = clear + 2
            prefix = c
        out(prefix)
    out(clear + 1)
    return codes


def pack_codes(codes: list[int], size: int = 8) -> bytes:
    """Codes as a little-endian bit stream whose code width grows with the table."""
    clear = 1 << size
    values = np.array(codes, np.uint32)
    at = np.arange(len(values))
    last = np.maximum.accumulate(np.where(np.r_[True, values[:-1] == clear], at, 0))  # first code of a run
    widths = _widths(clear)[0][np.minimum(at - last, 4096)]
    widths[0] = size + 1
    ends = np.cumsum(widths)
    begins = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, np.uint8)
    byte, moved = begins >> 3, values << (begins & 7).astype(np.uint32)
    if size >= 7:  # codes are longer than a byte, so no two begin in the same one
        for lane in range(3):
            out[byte + lane] |= (moved >> np.uint32(8 * lane)).astype(np.uint8)
    else:
        for lane in range(3):
            np.bitwise_or.at(out, byte + lane, (moved >> np.uint32(8 * lane)).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


def lzw_decode(stream: bytes, size: int, wanted: int | None = None) -> bytes:
    """Samples of an LZW bit stream, ``wanted`` of them at most. A stream that ends early gives what it holds.

    Beyond what is wanted no more than the samples of one run of 4,096 codes are expanded, or those
    of a stream too short to make more than ``MOST_UNCOUNTED``.
    """
    clear = 1 << size
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    widths, starts = _widths(clear)
    full = len(widths) - 1
    bits, bit, count = 8 * len(stream), 0, 0
    singles = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    add = out.append
    table, previous = list(singles), b""
    held, made = 0, 0
    counted = wanted is not None and bits // (size + 1) * _MEAN_LONGEST > MOST_UNCOUNTED
    while bit + size < bits:
        if counted:
            held, made = held + sum(map(len, out[made:])), len(out)
            if held >= wanted:
                break
        most = (bits - bit) // (size + 1) + 1
        if count < full:
            w = widths[count : count + most]
            begins = starts[count : count + most] + (bit - starts[count])
        else:
            w = np.full(min(most, 4096), 12)
            begins = bit + 12 * np.arange(len(w))
        inside = begins + w <= bits
        begins, w = begins[inside], w[inside]
        if not len(begins):
            break
        byte = begins >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begins & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        values = iter(codes[:n].tolist())
        if not previous:
            previous = table[next(values, 0)] if n else b""
            add(previous)
        learn, known = table.append, len(table)
        for code in values:
            if code < known:
                entry = table[code]
            else:
                entry = previous + previous[:1]
            if known < 4096:
                learn(previous + entry[:1])
                known += 1
            add(entry)
            previous = entry
        if len(stops):
            if codes[n] == clear + 1:
                break
            bit = int(begins[n] + w[n])
            table, previous, count = list(singles), b"", 0
        else:
            bit = int(begins[-1] + w[-1])
            count = min(count + n, full)
    return b"".join(out)[:wanted]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def grey() -> bytes:
    return bytes(v for k in range(256) for v in (k, k, k))


def encode_gif(frames: list[tuple[int, int, bytes]], delay: int = DELAY, palette: bytes | None = None) -> bytes:
    """Frames of (width, height, samples), each drawn at the corner over the one before it."""
    width, height = max(f[0] for f in frames), max(f[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette or grey()]
    for w, h, samples in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08")
        out.append(_blocks(pack_codes(lzw_codes(samples))))
    return b"".join([*out, b"\x3b"])


def encode_payload(payload: bytes) -> bytes:
    """Bytes, a multiple of ``WIDTH``, as the samples of as many frames as they need."""
    step = WIDTH * ROWS
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    return encode_gif([(WIDTH, len(p) // WIDTH, p) for p in parts])


@dataclass
class Frame:
    """A rendered frame: the whole canvas, and the rectangle that was drawn last."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]
    delay: int
    disposal: int

    def histogram(self) -> np.ndarray:
        """Opaque pixels in 4 x 4 x 4 cells of red, green and blue."""
        pixels = self.canvas.reshape(-1, 4)
        cells = (pixels[:, 0] >> 6).astype(np.int64) << 4 | (pixels[:, 1] >> 6) << 2 | pixels[:, 2] >> 6
        return np.bincount(cells[pixels[:, 3] > 0], minlength=64)


def decode_gif(data: bytes) -> list[Frame]:
    return list(render(data))


def render(data: bytes) -> Iterator[Frame]:
    """Frame after frame; a damaged file, or one of more than ``MOST_PIXELS``, raises an error."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MOST_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear = 0, 0, -1

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = sub_blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n
        size = data[at]
        if w * h > MOST_PIXELS or not 0 < size < 9:
            raise ValueError(f"a frame of {w} x {h} with codes of {size} bits")
        stream, at = sub_blocks(at + 1)
        samples = np.frombuffer(lzw_decode(stream, size, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        samples = samples[: region.shape[0], : region.shape[1]]
        colours = np.zeros((256, 3), np.uint8)
        if palette is not None:
            colours[: len(palette)] = palette
        if clear < 0:
            region[..., :3], region[..., 3] = colours[samples], 255
        else:
            drawn = samples != clear
            region[..., :3][drawn] = colours[samples[drawn]]
            region[..., 3][drawn] = 255
        yield Frame(canvas.copy(), (top, left, *samples.shape), delay, disposal)
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, -1


def samples_of(frame: Frame) -> bytes:
    """The samples of a frame of ``encode_payload``: its palette is the grey ramp, so red is the sample."""
    top, left, height, width = frame.box
    return frame.canvas[top : top + height, left : left + width, 0].tobytes()


FRAME = "frame int, starts_ms int, duration_ms int, width int, height int, histogram array<long>"
_FRAME = pa.struct([*((c, pa.int32()) for c in ("frame", "starts_ms", "duration_ms", "width", "height")), ("histogram", pa.list_(pa.int64()))])


def timed(found: Iterable[Frame]) -> list[dict]:
    """Frames as rows: when each is shown and for how long, its size and colour histogram."""
    rows, now = [], 0
    for i, f in enumerate(found):
        rows.append({"frame": i, "starts_ms": now, "duration_ms": 10 * f.delay, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "histogram": f.histogram().tolist()})
        now += 10 * f.delay
    return rows


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the GIF of the text's bytes, padded with zero bytes to a multiple of ``WIDTH``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                raw = [t.encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                media = pa.array((encode_payload(r.ljust(max(1, -(-len(r) // WIDTH)) * WIDTH, b"\0")) for r in raw), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per rendered frame of any GIFs: key, frame, starts_ms, duration_ms, width, height, histogram.

    A GIF that cannot be read to its end gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), *_FRAME])
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = timed(render(data or b""))
                except Exception:  # noqa: BLE001  whatever damaged bytes make the decoder raise
                    continue
                if rows:
                    yield pa.RecordBatch.from_pylist([{"key": k, **r} for r in rows], schema)

    return media.select(F.col(key).cast("long"), column).mapInArrow(run, "key long, " + FRAME).withColumnRenamed("key", key)


DECODED = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<struct<{FRAME}>>"


def decoded(media: DataFrame) -> DataFrame:
    """What stored GIFs of ``with_media`` hold: digests of payload and medium, and the timed frames as the decoder draws them.

    One frame is drawn at a time; a payload is never whole in memory.
    """

    def one(doc: int | None, n: int, data: bytes) -> tuple:
        digest, size, tail = hashlib.sha256(), 0, b""

        def drawn() -> Iterator[Frame]:
            nonlocal size, tail
            for frame in render(data):
                samples = samples_of(frame)
                digest.update(samples)
                size, tail = size + len(samples), (tail + samples)[-WIDTH:]
                yield frame

        rows = timed(drawn())
        return doc, n, size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(_FRAME)]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [one(*(x.as_py() for x in r)) for r in zip(*(part.column(i) for i in range(3)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)


def digests(stored: DataFrame) -> DataFrame:
    """Rows of ``decoded`` with number, time and a feature of their stored frames: the cells of all histograms that hold a pixel."""
    zero = F.array_repeat(F.lit(0).cast("long"), 64)
    cells = F.aggregate(F.transform("frames", lambda f: f["histogram"]), zero, lambda a, h: F.zip_with(a, h, lambda x, y: x + y))
    named = F.transform(cells, lambda n, i: F.when(n > 0, F.concat(i.cast("string"), F.lit("."), n.cast("string"))))
    last = F.element_at("frames", -1)
    head = F.concat(F.size("frames").cast("string"), F.lit("x"), (F.element_at("frames", 1)["duration_ms"] / 10).cast("int").cast("string"), F.lit(":"))
    return stored.select(
        *(c for c in stored.columns if c != "frames"), F.concat(head, F.array_join(named, "-")).alias("feature"), F.size("frames").alias("n_frames"),
        (last["starts_ms"] + last["duration_ms"]).alias("duration_ms"),
    )


def store_and_read(docs: DataFrame) -> DataFrame:
    """Write the GIFs as a table in the shared folder, decode what is read back, store the timed frames and digest those that are read back."""
    spark = docs.sparkSession
    media = with_media(docs)
    path = shared_path(spark, "gif")
    media.write.option("compression", "zstd").parquet(path)
    return digests(materialize(decoded(spark.read.schema(media.schema).parquet(path)), "gif-frames"))
