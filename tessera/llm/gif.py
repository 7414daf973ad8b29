"""Media columns: GIF. LZW code streams, palettes, disposal and transparency, timed frames and their colour histograms.

Code widths follow from a code's place since the last clear code alone, so a whole run of codes is packed or unpacked with a few array
operations. Decoding needs no string table either: the string of a code is what was put out where its entry began, one value longer, so
lengths and places of many files' codes follow by doubling pointers in arrays. Only the encoder walks its input value by value.

A payload is stored in 192 columns, a frame for each 128 rows, under a palette of 256 distinct colours. A later frame is drawn over the one
before: where a value is the same it is transparent, if the frame leaves a value free to say so.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import stage

WIDTH = 192
ROWS = 128
DELAY_CS = 10


# --- code streams -----------------------------------------------------------------------------------------------------


@lru_cache
def _table_widths(depth: int) -> np.ndarray:
    return np.clip(np.floor(np.log2((1 << depth) + 1 + np.arange(8192))).astype(np.int64) + 1, depth + 1, 12)


def _widths(depth: int, low: int, high: int) -> np.ndarray:
    """Bits of codes low to high after a clear code: one more each time the table outgrows them, 12 at most."""
    known = _table_widths(depth)
    return known[low:high] if high <= len(known) else np.concatenate([known[low:], np.full(high - max(low, len(known)), 12)])


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """LZW with a clear code at the start and whenever the table of 4096 strings is full."""
    clear, end = 1 << depth, (1 << depth) + 1
    codes: list[int] = []
    segments = [[clear], codes]
    table: dict[int, int] = {}
    get, nxt, w = table.get, end + 1, -1
    for k in data:
        if w < 0:
            w = k
            continue
        key = w << 8 | k
        c = get(key)
        if c is not None:
            w = c
            continue
        codes.append(w)
        table[key] = nxt
        nxt += 1
        w = k
        if nxt == 4096:
            codes.append(clear)
            codes = []
            segments.append(codes)
            table.clear()
            nxt = end + 1
    if w >= 0:
        codes.append(w)
    codes.append(end)
    code = np.fromiter(chain.from_iterable(segments), "<u2", sum(map(len, segments)))
    width = np.concatenate([np.array([depth + 1]), *[_widths(depth, 0, len(s)) for s in segments[1:]]]).astype(np.uint8)
    bits = np.unpackbits(code.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16, dtype=np.uint8) < width[:, None]], bitorder="little").tobytes()


def read_codes(data: bytes, depth: int) -> list[np.ndarray]:
    """The runs of codes between clear codes, up to the end code or where the stream breaks off."""
    clear, end = 1 << depth, (1 << depth) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, since, runs, held = 8 * len(data), 0, 0, [], []
    while True:
        width = _widths(depth, since, since + min(4096, (total - at) // (depth + 1) + 1))
        pos = at + np.concatenate([[0], np.cumsum(width)[:-1]])
        fit = int(np.searchsorted(pos + width, total, side="right"))
        pos, width = pos[:fit], width[:fit]
        byte = pos >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (pos & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else fit
        held.append(codes[:n])
        if not len(stop) and fit:
            at, since = int(pos[-1] + width[-1]), since + n
            continue
        runs.append(np.concatenate(held))
        if not fit or codes[n] == end:
            return runs
        at, since, held = int(pos[n] + width[n]), 0, []


def expand_codes(streams: list[tuple[list[np.ndarray], int, int]]) -> list[bytes]:
    """The values of many code streams, each given by its runs, its depth and how many values it must have; ValueError where one has fewer."""
    runs = [(r, depth, i) for i, (rs, depth, _) in enumerate(streams) for r in rs]
    size = np.array([len(r) for r, _, _ in runs], np.int64)
    owner = np.repeat([i for _, _, i in runs], size).astype(np.int64)
    clear = np.repeat([1 << d for _, d, _ in runs], size).astype(np.int64)
    code = np.concatenate([*(r for r, _, _ in runs), np.zeros(0, np.int64)])
    place = np.arange(len(code))
    start = np.repeat(np.cumsum(size) - size, size)
    # an entry begins with the code that is as far into its run as the entry is into the table
    made = code >= clear + 2
    parent = np.where(made, start + code - clear - 2, place)
    wrong = (parent > place) | (made & (parent == place)) | (code == clear) | (code == clear + 1)
    made &= ~wrong
    parent = np.where(made, parent, place)
    length, hop = made.astype(np.int64), parent
    while (more := length[hop]).any():
        length, hop = length + more, hop[hop]
    length += 1
    begin = np.cumsum(length) - length
    # every value is a copy of an earlier one, until a code that is the value itself
    shift = np.where(made, begin[parent] - begin, 0)
    source = np.arange(int(length.sum())) + np.repeat(shift, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    values = np.repeat(code, length)[source].astype(np.uint8)
    bounds = np.append(begin, len(values))[np.searchsorted(owner, np.arange(len(streams) + 1))]
    limit, bad = bounds[1:].copy(), np.flatnonzero(wrong)
    np.minimum.at(limit, owner[bad], begin[bad])
    out = []
    for (_, _, want), a, b in zip(streams, bounds.tolist(), limit.tolist(), strict=False):
        if b - a < want:
            raise ValueError("a code stream breaks off, or has a code that can't be")
        out.append(values[a : a + want].tobytes())
    return out


def lzw_decode(data: bytes, depth: int, size: int) -> bytes:
    """The first `size` values of a code stream; a stream that breaks off, or has a code that can't be, raises ValueError."""
    return expand_codes([(read_codes(data, depth), depth, size)])[0]


# --- files ------------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """One image of a file: its own values, where it lies, and how long and how it stays."""

    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int  # 0, 1: stays; 2: its place becomes background; 3: what was there before comes back
    transparent: int | None
    palette: np.ndarray
    values: np.ndarray


@dataclass
class Gif:
    width: int
    height: int
    background: np.ndarray
    frames: list[Frame] = field(default_factory=list)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(width: int, height: int, palette: np.ndarray, frames: list[Frame]) -> bytes:
    """Write a file with one global palette of 256 colours; frames may differ in place, size, delay, disposal and transparency."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0) + b"\x08" + _blocks(lzw_encode(f.values.astype(np.uint8).tobytes())))
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes) -> Gif:
    """Read a file: all frames with their values in order of rows, interlaced ones put in order. Damage raises ValueError."""
    return decode_gifs([data])[0]


def decode_gifs(files: list[bytes]) -> list[Gif]:
    """Read many files, whose code streams are expanded together."""
    parsed = [_parse(data) for data in files]
    streams = [(read_codes(raw, depth), depth, f.width * f.height) for _, waiting in parsed for f, raw, depth, _ in waiting]
    done = iter(expand_codes(streams))
    for _, waiting in parsed:
        for f, _, _, interlaced in waiting:
            f.values = np.frombuffer(next(done), np.uint8).reshape(f.height, f.width)
            if interlaced:
                order = np.concatenate([np.arange(0, f.height, 8), np.arange(4, f.height, 8), np.arange(2, f.height, 4), np.arange(1, f.height, 2)])
                straight = np.empty_like(f.values)
                straight[order] = f.values
                f.values = straight
    return [gif for gif, _ in parsed]


def _parse(data: bytes) -> tuple[Gif, list[tuple[Frame, bytes, int, bool]]]:
    """A file's structure, and for each frame its code stream, depth, and whether it is interlaced."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    at = 13

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        table = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
        return table

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    common = colours(flags) if flags & 0x80 else np.zeros((0, 3), np.uint8)
    gif = Gif(width, height, common[back] if back < len(common) else np.zeros(3, np.uint8))
    delay, disposal, transparent, waiting = 0, 0, None, []
    try:
        while at < len(data) and data[at] != 0x3B:
            kind = data[at]
            at += 1
            if kind == 0x21:
                label = data[at]
                at += 1
                body = sub_blocks()
                if label == 0xF9:
                    packed, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            elif kind == 0x2C:
                left, top, w, h, packed = struct.unpack("<HHHHB", data[at : at + 9])
                at += 9
                palette = colours(packed) if packed & 0x80 else common
                depth = data[at]
                at += 1
                if not 1 <= depth <= 11:
                    raise ValueError("no such depth")
                gif.frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, None))
                waiting.append((gif.frames[-1], sub_blocks(), depth, bool(packed & 0x40)))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the file breaks off") from e
    return gif, waiting


def render(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas (height x width x RGBA) as each frame shows it, by the rules of disposal and transparency."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, gif.height - f.top)), max(0, min(f.width, gif.width - f.left))
        part = canvas[f.top : f.top + h, f.left : f.left + w]
        values = f.values[:h, :w]
        rgb = f.palette[np.minimum(values, len(f.palette) - 1)] if len(f.palette) else np.zeros((h, w, 3), np.uint8)
        new = np.concatenate([rgb, np.full((h, w, 1), 255, np.uint8)], axis=2)
        part[:] = new if f.transparent is None else np.where((values == f.transparent)[..., None], part, new)
        yield canvas.copy()
        if f.disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before


#: Colour bins: the two high bits of red, green and blue.
BINS = 64


def bins_of(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] >> 6 << 4 | rgb[..., 1] >> 6 << 2 | rgb[..., 2] >> 6


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels of a canvas by colour bin."""
    return np.bincount(bins_of(canvas[..., :3])[canvas[..., 3] > 0], minlength=BINS)


def frame_histograms(gif: Gif) -> Iterator[np.ndarray]:
    """The colour histogram of the canvas as each frame shows it: render() by bins, one byte a pixel."""
    canvas = np.full((gif.height, gif.width), BINS, np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, gif.height - f.top)), max(0, min(f.width, gif.width - f.left))
        part, values = canvas[f.top : f.top + h, f.left : f.left + w], f.values[:h, :w]
        bins = bins_of(f.palette)[np.minimum(values, len(f.palette) - 1)] if len(f.palette) else np.zeros((h, w), np.uint8)
        part[:] = bins if f.transparent is None else np.where(values == f.transparent, part, bins)
        yield np.bincount(canvas.reshape(-1), minlength=BINS + 1)[:BINS]
        if f.disposal == 2:
            part[:] = BINS
        elif before is not None:
            canvas = before


def frame_rows(gif: Gif) -> list[dict]:
    """A row for each frame: its time, place, disposal and colour histogram."""
    clock, rows = 0, []
    for i, (f, counts) in enumerate(zip(gif.frames, frame_histograms(gif), strict=True)):
        rows.append({"frame": i, "start_ms": 10 * clock, "duration_ms": 10 * f.delay_cs, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "histogram": counts.tolist()})
        clock += f.delay_cs
    return rows


# --- tables -----------------------------------------------------------------------------------------------------------

#: 256 distinct colours: three bits of red and green, two of blue.
COLOURS = np.stack([(np.arange(256) >> 5) * 36, (np.arange(256) >> 2 & 7) * 36, (np.arange(256) & 3) * 85], axis=1).astype(np.uint8)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text (null: empty) and their count before blanks pad them to a positive multiple of 192."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH))


def store_bytes(payload: bytes) -> bytes:
    """A payload as palette values, 192 a row, 128 rows a frame; values that the frame before has in the same place are transparent."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames, canvas = [], None
    for part in (rows[i : i + ROWS] for i in range(0, len(rows), ROWS)):
        values, free = part, None
        if canvas is not None:
            unused = np.flatnonzero(np.bincount(part.reshape(-1), minlength=256) == 0)
            if len(unused):
                free = int(unused[-1])
                values = np.where(part == canvas[: len(part)], free, part)
        frames.append(Frame(0, 0, WIDTH, len(part), DELAY_CS, 1, free, COLOURS, values))
        canvas = part if canvas is None or len(part) == ROWS else canvas
    return encode_gif(WIDTH, min(len(rows), ROWS), COLOURS, frames)


def stored_bytes(gif: Gif) -> bytes:
    """The payload back from a file of store_bytes: what the canvas shows of each frame's rows."""
    canvas, parts = np.zeros((gif.height, gif.width), np.uint8), []
    for f in gif.frames:
        part = canvas[: f.height]
        part[:] = f.values if f.transparent is None else np.where(f.values == f.transparent, part, f.values)
        parts.append(part.tobytes())
    return b"".join(parts)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([store_bytes(p) for _, p in made], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


FRAMES = "array<struct<frame: int, start_ms: long, duration_ms: long, left: int, top: int, width: int, height: int, disposal: int, histogram: array<long>>>"


def describe_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode stored files: payload digests, `frames` (time, place, disposal and colour histogram of each) and their sums as a feature string.

    The feature is frames|milliseconds|histogram, the histogram summed over what each frame shows.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    frame = pa.struct([*[(c, pa.int64() if c.endswith("_ms") else pa.int32()) for c in ("frame", "start_ms", "duration_ms", "left", "top", "width", "height", "disposal")], ("histogram", pa.list_(pa.int64()))])

    def one(data: bytes, gif: Gif) -> tuple:
        payload, frames = stored_bytes(gif), frame_rows(gif)
        counts = np.sum([f["histogram"] for f in frames], axis=0)
        feature = f"{len(frames)}|{10 * sum(f.delay_cs for f in gif.frames)}|{','.join(map(str, counts.tolist()))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                files = part.column(2).to_pylist()
                rows = [one(d, g) for d, g in zip(files, decode_gifs(files), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([r[i] for r in rows], t) for i, t in enumerate([*kinds, pa.list_(frame)])]], names=[key, "n_bytes", *names, "frames"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {FRAMES}")


def _parts(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of media, one row at least."""
    ends = np.cumsum([v.as_buffer().size for v in batch.column(2)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def op5_gif(spark, sf_dir: str) -> DataFrame:
    """Every whole text as a stored GIF, read back and described.

    A null or empty text is one row of blanks; a very long one has a frame for each 24,576 bytes; equal texts have equal files and repeated
    rows each have theirs; other columns are not read, whatever their names; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return describe_media(stage(encode_media(docs), "gif"))
