"""GIF columns: LZW code streams, palettes, interlace, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import chunks

CLEAR, END, FREE, FULL = 256, 257, 258, 4096
#: Codes between two clears until the table is full, and the width of the code at each place after a clear.
RUN = FULL - FREE
WIDTH = np.array([max(9, min(12, (FREE + max(j - 1, 0)).bit_length())) for j in range(RUN + 1)], np.int64)
WIDE, TALL, DELAY_CS = 192, 4096, 4
#: Samples between two clears of a stream of single samples: its codes have 9 or 10 bits.
LITERALS = 766


class GifError(ValueError):
    """A stream that isn't a GIF, or that ends or points where it may not."""


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    delay_cs: int
    disposal: int
    transparent: int | None
    rgba: np.ndarray = field(repr=False)


@dataclass
class Animation:
    width: int
    height: int
    loops: int | None
    frames: list[Frame]


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples; the table is cleared when it is full."""
    codes, widths, run = [np.array([CLEAR])], [np.array([9])], []
    table: dict[int, int] = {}
    get, add, free = table.get, run.append, FREE
    now = data[0]
    for b in memoryview(data)[1:]:
        key = now << 8 | b
        known = get(key)
        if known:
            now = known
            continue
        add(now)
        now = b
        if free < FULL:
            table[key] = free
            free += 1
        if len(run) == RUN:
            codes.append(np.array([*run, CLEAR]))
            widths.append(WIDTH[: RUN + 1])
            run.clear()
            table.clear()
            free = FREE
    codes.append(np.array([*run, now, END]))
    widths.append(np.append(WIDTH, [12])[: len(run) + 2])
    return _pack(np.concatenate(codes), np.concatenate(widths))


def _pack(code: np.ndarray, width: np.ndarray) -> bytes:
    """Codes of up to 12 bits behind one another, lowest bit first."""
    bits = np.unpackbits(code.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def literal_encode(data: bytes) -> bytes:
    """A code stream of single samples, cleared while codes are short: larger than ``lzw_encode``'s, made without a loop."""
    runs = -(-len(data) // LITERALS)
    code = np.full((runs, LITERALS + 1), CLEAR, np.int64)
    samples = np.zeros(runs * LITERALS, np.int64)
    samples[: len(data)] = np.frombuffer(data, np.uint8)
    code[:, :LITERALS] = samples.reshape(runs, LITERALS)
    last = len(data) - (runs - 1) * LITERALS
    code[-1, last] = END
    flat, width = code.ravel(), np.tile(WIDTH[: LITERALS + 1], runs)
    end = (runs - 1) * (LITERALS + 1) + last + 1
    return _pack(np.concatenate([[CLEAR], flat[:end]]), np.concatenate([[9], width[:end]]))


@functools.cache
def _places(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width, and bits before it, of each code after a clear; far more places than a table has entries."""
    free = np.minimum(FULL, (1 << bits) + 2 + np.maximum(np.arange(1 << 15) - 1, 0))
    width = np.minimum(12, np.maximum(bits + 1, np.frexp(free.astype(float))[1]))
    return width, np.concatenate([[0], np.cumsum(width)])


def _codes(data: np.ndarray, at: int, bits: int) -> tuple[np.ndarray, bool, int]:
    """The codes from bit ``at`` to the next clear or end code, whether it was the end, and the bit behind it."""
    found, j, clear, (widths, before) = [], 0, 1 << bits, _places(bits)
    total = (len(data) - 3) * 8
    step = LITERALS + 1
    while True:
        if j + step <= len(widths):
            width, p = widths[j : j + step], before[j : j + step] + at
        else:
            width, p = np.full(step, 12), at + before[-1] + 12 * (np.arange(j, j + step) - len(widths))
        whole = step if p[-1] + width[-1] <= total else int(np.searchsorted(p + width, total, "right"))
        width, p = width[:whole], p[:whole]
        byte = p >> 3
        code = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (p & 7) & ((1 << width) - 1)
        stop = (code >> 1 == clear >> 1).argmax() if whole else 0
        if whole and code[stop] >> 1 == clear >> 1:
            found.append(code[:stop])
            return np.concatenate(found), code[stop] == clear + 1, int(p[stop] + width[stop])
        found.append(code)
        if whole < step:
            return np.concatenate(found), True, total
        j, step = j + step, min(4096, 4 * step)


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """The samples of a code stream whose smallest codes have ``bits`` bits.

    A code's width depends only on its place after the last clear, so that a whole run of codes is cut
    out at once. Entry k of the table is the string of code k and the sample after it, which is a slice
    of what is already decoded.
    """
    if not 2 <= bits <= 8:
        raise GifError(f"code size {bits}")
    clear, out = 1 << bits, []
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    at, over = 0, False
    while not over:
        code, over, at = _codes(data, at, bits)
        if not len(code):
            continue
        if code.max() < clear:
            out.append(code.astype(np.uint8).tobytes())
            continue
        got, begin, entry = bytearray(), [], clear + 2
        mark = begin.append
        for c in code.tolist():
            here = len(got)
            if c < clear:
                mark(here)
                got.append(c)
                continue
            k = c - entry
            if k >= len(begin):
                raise GifError("a code before its entry")
            mark(here)
            end = begin[k + 1] + 1
            got += got[begin[k] : end]
            if end > here:
                got.append(got[begin[k]])
        out.append(bytes(got))
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.frombuffer(data[at : at + 3 * n], np.uint8)
    if len(colours) < 3 * n:
        raise GifError("a palette ends early")
    rgba = np.full((256, 4), 255, np.uint8)
    rgba[:, :3] = 0
    rgba[:n, :3] = colours.reshape(n, 3)
    return rgba.view(np.uint32).ravel(), at + 3 * n


def decode(data: bytes) -> Animation:
    """Every frame of a GIF with its time, and the canvas after it as RGBA.

    Disposal 2 clears a frame's area before the next one, 3 puts back what was there, and 0 and 1 leave
    it. A transparent index leaves the canvas as it is. A frame may reach beyond the canvas: its samples
    are kept, and the canvas takes what fits. A stream with fewer samples than its frame is an error.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 128:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((height, width), np.uint32)
    frames, loops, delay, disposal, clear = [], None, 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            block, at = _blocks(data, at + 2)
            if kind == 0xF9 and len(block) >= 4:
                delay, disposal = struct.unpack_from("<H", block, 1)[0], block[0] >> 2 & 7
                clear = block[3] if block[0] & 1 else None
            elif kind == 0xFF and block[:11] == b"NETSCAPE2.0" and len(block) >= 14:
                loops = struct.unpack_from("<H", block, 12)[0]
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            raise GifError(f"block {data[at]:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 128:
            palette, at = _palette(data, at, flags)
        if palette is None:
            raise GifError("a frame without a palette")
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        held = lzw_decode(stream, bits)
        if len(held) < w * h:
            raise GifError(f"a frame of {w * h} samples has {len(held)}")
        samples = np.frombuffer(held[: w * h], np.uint8).reshape(h, w)
        if flags & 64:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven, samples = samples, np.empty_like(samples)
            samples[rows] = woven
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        fits = samples[: area.shape[0], : area.shape[1]]
        if clear is None:
            area[...] = palette[fits]
        else:
            np.copyto(area, palette[fits], where=fits != clear)
        frames.append(Frame(left, top, samples, delay, disposal, clear, canvas.copy().view(np.uint8).reshape(height, width, 4)))
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None
    return Animation(width, height, loops, frames)


def encode(frames: list[np.ndarray], delay_cs: int = DELAY_CS, palette: np.ndarray | None = None, packed: bool = True) -> bytes:
    """8-bit index frames, each at the canvas' upper left corner, as a GIF that loops.

    ``packed`` looks for strings in the samples; without it the streams hold single samples, are about
    twice as large on text and take a third of the time. Both are LZW streams that any reader decodes.
    """
    if palette is None:
        i = np.arange(256)
        palette = np.stack([(i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85], 1)
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for f in frames:
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0), b"\x08"]
        stream = (lzw_encode if packed else literal_encode)(f.tobytes())
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)] + [b"\0"]
    return b"".join(out) + b";"


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours, two bits a channel; transparent pixels don't count."""
    p = rgba.reshape(-1, 4).view(np.uint32).ravel()
    p = p[p >= 1 << 24] if p.size and p.min() < 1 << 24 else p
    return np.bincount((p & 0xC0) >> 2 | (p & 0xC000) >> 12 | (p & 0xC00000) >> 22, minlength=64)


def to_frames(payload: bytes) -> list[np.ndarray]:
    """A payload of whole rows of 192 samples as frames of 4,096 rows at most."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDE)
    return [rows[k : k + TALL] for k in range(0, len(rows), TALL)]


FRAME_SCHEMA = "frame int, start_ms long, delay_ms long, width int, height int, disposal int, histogram array<long>, error string"


def decode_frames(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per frame of the GIFs in the binary column ``content``, with the other columns beside it.

    A frame has its number, its start and duration, its size and the 64-colour histogram of the canvas
    after it. A null or broken GIF gives one row with null frame columns and the reason in ``error``.
    """
    rest = [c for c in df.columns if c != content]
    ours = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]
    if clash := set(rest) & set(ours):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in enumerate(batch.column(content)):
                try:
                    frames, error = decode(blob.as_py() or b"").frames, None
                except (ValueError, IndexError, struct.error) as e:
                    frames, error = [], str(e) or type(e).__name__
                start, rows = 0, []
                for n, f in enumerate(frames):
                    rows.append((n, start, f.delay_cs * 10, f.indices.shape[1], f.indices.shape[0], f.disposal, histogram(f.rgba).tolist(), None))
                    start += f.delay_cs * 10
                rows = rows or [(None,) * 7 + (error or "no frames",)]
                kept = batch.select(rest).take(pa.array([k] * len(rows)))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*rest, *ours])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content), FRAME_SCHEMA])
    return df.select(*rest, content).mapInArrow(run, fields)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int"


def stored_texts(documents: DataFrame) -> DataFrame:
    """Each text as the samples of a GIF: stored, read back, and described.

    The payload is the UTF-8 text and as many spaces as fill rows of 192, one row at least; a null or
    empty text is one row of spaces. What is hashed comes from the decoded frames, not from the text.
    ``feature`` has the summed 64-colour histogram of the frames. Rows are independent: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, data in chunks(batches, limit=8 << 20):
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                payload = data[a:b].tobytes()
                payload = payload.ljust(max(1, -(-len(payload) // WIDE)) * WIDE)
                media = encode(to_frames(payload))
                frames = decode(media).frames
                back = b"".join(f.indices.tobytes() for f in frames)
                colours = sum(histogram(f.rgba[: f.indices.shape[0]]) for f in frames)
                rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, colours.tolist())), len(frames)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in STORED.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, STORED)
