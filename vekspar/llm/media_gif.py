"""GIF media columns: decoding into timed frames, and lossless storage of bytes as samples.

The decoder reads both GIF versions: global and local palettes, interlacing, graphic control
extensions with delay, disposal and transparency, and LZW streams of any code size, deferred
clear codes included. Every stream goes through the dictionary; numpy packs and cuts the codes,
whose widths follow from their number since the last clear code. The encoder compresses.

Defined results: null media give no frame; data that is no GIF, or whose canvas has more than
`most_pixels` pixels, gives one row whose error is set and whose other columns are null; a null text is stored as an empty one; repeated rows
stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, pick, slices, texts_of

GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
BINS = 16
#: Of a canvas or frame: 64 MB as RGBA.
MOST_PIXELS = 1 << 24


class GifError(ValueError):
    """The data is not a GIF that can be read."""


# --- LZW ---------------------------------------------------------------------------------


@cache
def widths(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The widths of the first n codes after a clear code, and the bits before each and behind the last."""
    last = (1 << size) + 1 + np.arange(n)
    out = np.clip(np.floor(np.log2(last)).astype(np.int64) + 1, size + 1, 12)
    out[:1] = size + 1
    return out, np.concatenate(([0], np.cumsum(out)))


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """A compressed code stream of samples below 1 << size. A full dictionary is cleared."""
    clear, end = 1 << size, (1 << size) + 1
    codes, runs = [clear], []  # runs: numbers of codes that share a dictionary, the clear code at their end included
    put, free = codes.append, end + 1
    table: dict[int, int] = {}
    get, begun = table.get, 1
    left = iter(samples)
    prefix = next(left, None)
    for s in left:
        key = prefix << 8 | s
        found = get(key)
        if found is not None:
            prefix = found
            continue
        put(prefix)
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(clear)
            runs.append(len(codes) - begun)
            begun, free = len(codes), end + 1
            table.clear()
        prefix = s
    if prefix is not None:
        put(prefix)
    put(end)
    runs.append(len(codes) - begun)
    of, _ = widths(size, 4096)
    wide = np.concatenate(([size + 1], *(of[:n] for n in runs)))
    bits = np.array(codes, np.uint16)[:, None] >> _BITS & 1
    return np.packbits(bits.astype(np.uint8)[wide[:, None] > _BITS], bitorder="little").tobytes()


_BITS = np.arange(12, dtype=np.uint16)


def lzw_decode(data: bytes, size: int, most: int | None = None) -> np.ndarray:
    """The samples of a code stream whose literals have size bits; no more than about most are decoded."""
    if not 1 <= size <= 11:
        raise GifError(f"code size {size}")
    clear, end = 1 << size, (1 << size) + 1
    first = [bytes((i & 255,)) for i in range(clear)] + [b"", b""]
    raw, total = np.frombuffer(data + b"\0\0\0", np.uint8), len(data) * 8
    _, before = widths(size, 4096)
    out: list[bytes] = []
    at = done = length = 0  # bits read; codes since the last clear code; samples
    table, last = list(first), None
    while most is None or length < most:
        # As many codes as share the dictionary's growth. Their places follow from their number alone.
        place = at + (before[done:] - before[done] if done < 4096 else 12 * np.arange(4097))
        place = place[: int(np.searchsorted(place, total, side="right"))]
        if len(place) < 2:
            break
        where = place[:-1]
        byte = where >> 3
        value = raw[byte].astype(np.int32) | raw[byte + 1].astype(np.int32) << 8 | raw[byte + 2].astype(np.int32) << 16
        codes = value >> (where & 7) & ((1 << np.diff(place)) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        begun, last = len(out), _expand(codes[:n].tolist(), table, last, out)
        length += sum(map(len, out[begun:]))
        at, done = int(place[n]), done + n
        if len(stop):
            if codes[n] == end:
                break
            at, done, table, last = int(place[n + 1]), 0, list(first), None
    return np.frombuffer(b"".join(out), np.uint8)


def _expand(codes: list[int], table: list[bytes], last: bytes | None, out: list[bytes]) -> bytes | None:
    """Appends the entries of codes to out, and the entries that they make to the table."""
    size = len(table)
    put, grow = out.append, table.append
    for code in codes:
        if code < size:
            entry = table[code]
            if last is not None and size < 4096:
                grow(last + entry[:1])
                size += 1
        elif code == size and last is not None and size < 4096:
            entry = last + last[:1]
            grow(entry)
            size += 1
        else:
            raise GifError("a code comes before its entry")
        put(entry)
        last = entry
    return last


# --- The container -----------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes, with the terminator."""
    whole = len(data) // 255
    framed = np.full((whole, 256), 255, np.uint8)
    framed[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return framed.tobytes() + (bytes((len(rest),)) + rest if rest else b"") + b"\0"


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block is cut off")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int = -1


def encode(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF of frames with 256 colours each; the first frame's palette is the global one."""
    first = frames[0].palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), first.tobytes()]
    for f in frames:
        h, w = f.indices.shape
        local = b"" if np.array_equal(f.palette, first) else f.palette.tobytes()
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent >= 0), f.delay, max(f.transparent, 0), 0))
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, w, h, 0x87 if local else 0) + local + b"\x08")
        out.append(_blocks(lzw_encode(f.indices.tobytes())))
    return b"".join([*out, b"\x3b"])


def read(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, list[Frame]]:
    """Width, height and frames."""
    try:
        return _read(data, most_pixels)
    except (struct.error, IndexError, ValueError) as e:
        raise e if isinstance(e, GifError) else GifError(str(e)) from e


def _read(data: bytes, most_pixels: int) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_pixels:
        raise GifError(f"a canvas of {width} x {height} pixels")
    at, common = 13, None

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        at += 3 * n
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(n, 3)

    common = colours(flags)
    frames, control = [], (0, 0, -1)
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return width, height, frames
        if kind == 0x21:
            label = data[at]
            body, at = _unblock(data, at + 1)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (delay, packed >> 2 & 7, index if packed & 1 else -1)
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(packed)
            palette = common if palette is None else palette
            if palette is None:
                raise GifError("no palette")
            if w * h > most_pixels:
                raise GifError(f"a frame of {w} x {h} pixels")
            size = data[at]
            body, at = _unblock(data, at + 1)
            samples = lzw_decode(body, size, w * h)[: w * h]
            if len(samples) < w * h:
                raise GifError("too few samples")
            if samples.max(initial=0) >= len(palette):
                raise GifError("a sample is outside the palette")
            grid = samples.reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(s, h, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(grid)
                straight[rows] = grid
                grid = straight
            frames.append(Frame(left, top, grid, palette, *control))
            control = (0, 0, -1)
        else:
            raise GifError(f"block {kind:#x}")


def canvases(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as each frame shows it."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for i, f in enumerate(frames):
        h, w = f.indices.shape
        at = (slice(f.top, min(f.top + h, height)), slice(f.left, min(f.left + w, width)))
        before = canvas[at].copy() if f.disposal in (2, 3) else None
        indices = f.indices[: max(0, height - f.top), : max(0, width - f.left)]
        area, colours = canvas[at], np.full((max(256, len(f.palette)), 4), 255, np.uint8)
        colours[: len(f.palette), :3] = f.palette
        if f.transparent < 0:
            area[:] = colours[indices]
        else:
            painted = indices != f.transparent
            area[painted] = colours[indices[painted]]
        if i + 1 == len(frames):
            yield canvas
            return
        yield canvas.copy()
        if f.disposal == 2:
            canvas[at] = 0
        elif f.disposal == 3:
            canvas[at] = before


# --- Operators ---------------------------------------------------------------------------


def frames(media: DataFrame, id_col: str = "media_id", data_col: str = "data", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row for each frame as shown: its time, size, rule, RGBA pixels and colour histograms.

    Columns: id, frame, start_ms, delay_ms, width, height, disposal, rgba, red, green, blue
    (arrays of 16 counts over the canvas' painted pixels), error.
    """
    m = pick(media, id=id_col, data=data_col)
    schema = f"id {m.schema['id'].dataType.simpleString()}, frame int, start_ms long, delay_ms long, width int, height int, disposal int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"
    names = ["id", "frame", "start_ms", "delay_ms", "width", "height", "disposal", "rgba", "red", "green", "blue", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
            for key, data in zip(batch.column("id").to_pylist(), batch.column("data"), strict=True):
                if not data.is_valid:
                    continue
                try:
                    w, h, found = read(data.as_py(), most_pixels)
                except GifError as e:
                    yield pa.record_batch([pa.array([c], k) for c, k in zip((key, *[None] * 10, str(e)), kinds, strict=True)], names)
                    continue
                now = 0
                for i, (f, canvas) in enumerate(zip(found, canvases(w, h, found), strict=True)):
                    row = (key, i, now, f.delay * 10, w, h, f.disposal, canvas.tobytes(), *(b.tolist() for b in histograms(canvas)), None)
                    now += f.delay * 10
                    yield pa.record_batch([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names)  # a frame at a time

    return mapped(m, run, schema)


def histograms(canvas: np.ndarray) -> list[np.ndarray]:
    """Painted pixels by BINS ranges of red, green and blue."""
    painted = canvas.reshape(-1, 4)
    if not painted[:, 3].all():
        painted = painted[painted[:, 3] > 0]
    return [np.bincount(painted[:, c] // (256 // BINS), minlength=BINS) for c in range(3)]


def store_payload(payload: bytes, width: int = 64) -> bytes:
    """Bytes (a multiple of width) as grey samples, in frames of at most 65,535 rows."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    parts = [samples[i : i + 65_535] for i in range(0, len(samples), 65_535)]
    return encode([Frame(0, 0, p, GREY, delay=10) for p in parts], width, len(parts[0]))


def read_payload(data: bytes) -> tuple[bytes, list[tuple[int, int, list[np.ndarray]]]]:
    """The bytes that the frames show on the canvas, one after the other; start, delay and histograms of each frame."""
    width, height, found = read(data)
    parts, told, now = [], [], 0
    for f, canvas in zip(found, canvases(width, height, found), strict=True):
        h, w = f.indices.shape
        parts.append(canvas[f.top : f.top + h, f.left : f.left + w, 0].tobytes())
        told.append((now, f.delay * 10, histograms(canvas)))
        now += f.delay * 10
    return b"".join(parts), told


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """Each whole text stored as a GIF and read back: doc_id, sizes, digests and the feature.

    The feature lists each frame as shown: its start and delay, and its histograms of red, green and blue.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text in texts_of(batch):
                raw = text.encode()
                media = store_payload(raw + bytes(-len(raw) % width or (0 if raw else width)), width)
                payload, found = read_payload(media)
                feature = ";".join(f"{start}+{delay}ms " + " ".join(f"{name}=" + ",".join(map(str, b)) for name, b in zip("rgb", bins, strict=True)) for start, delay, bins in found)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
