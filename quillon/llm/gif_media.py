"""GIF media columns: write payloads as animated GIFs, and decode GIFs to timed frames with colour histograms.

The decoder reads any GIF87a or GIF89a stream: LZW code streams with clear codes at any place, global and local
palettes, interlacing, transparency, and disposal 0 to 3. Each frame is the whole canvas as shown, with its time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import mapped, replaced

WIDTH = 64
#: Rows of pixels in one written frame.
FRAME_ROWS = 256
#: Delay of a written frame, in hundredths of a second.
DELAY = 10
BINS = 8
#: Pixels of a canvas or an image block; a GIF that claims more counts as malformed, as it would take that memory.
MOST_PIXELS = 1 << 24
#: Rows of one batch that the Python side returns.
BATCH = 512

_CLEAR, _END, _FIRST = 256, 257, 258


class Frame(NamedTuple):
    """A shown canvas, its time, and what the image block itself held (row-major colour indices)."""

    start_ms: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray
    indices: bytes


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of the 0th to (n - 1)th code after a clear code, as a decoder counts its table."""
    size = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.ceil(np.log2(size + 1)), least + 1, 12).astype(np.int64)


_WIDTHS8 = _widths(4096, 8)


def lzw_encode(data: bytes) -> bytes:
    """An 8-bit LZW code stream; the table is cleared when it is full."""
    codes: list[int] = [_CLEAR]
    clears = [0]
    table: dict[int, int] = {}
    free, at = _FIRST, -1
    find, emit = table.get, codes.append
    for b in data:
        if at < 0:
            at = b
            continue
        key = at << 8 | b
        known = find(key)
        if known is not None:
            at = known
            continue
        emit(at)
        at = b
        if free < 4096:
            table[key] = free
            free += 1
        else:
            clears.append(len(codes))
            emit(_CLEAR)
            table.clear()
            free = _FIRST
    if at >= 0:
        emit(at)
    emit(_END)
    # A code's width follows from its place after the last clear code; the first clear code has 9 bits.
    place = np.arange(len(codes))
    starts = np.asarray(clears) + 1
    since = place - np.concatenate([[0], starts])[np.searchsorted(starts, place, side="right")]
    width = _WIDTHS8[np.minimum(since, 4095)]
    bits = (np.asarray(codes, dtype=np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """The colour indices of an LZW code stream, at most ``most`` of them.

    Code widths depend only on how many codes came since the last clear code, so the codes up to the next one are cut
    out of the stream together; only the table look-ups go code by code. A truncated stream gives what it holds.
    """
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    n_bits = len(stream) * 8
    widths = _WIDTHS8 if least == 8 else _widths(4096, least)
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    got, bit, since = 0, 0, 0
    table, before = literals.copy(), b""
    while got < most:
        take = widths[since : since + 4096] if since < 4096 else np.full(4096, 12)
        offsets = bit + np.concatenate([[0], np.cumsum(take)])
        take = take[: int(np.searchsorted(offsets[1:], n_bits, side="right"))]
        if not len(take):
            break
        at = offsets[: len(take)]
        codes = (words[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << take) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stops[0]) if len(stops) else len(codes)
        entries, before = _looked_up(codes[:upto].tolist(), table, before)
        out += entries
        got += sum(map(len, entries))
        since += upto
        bit = int(offsets[upto])
        if not len(stops):
            continue
        if codes[upto] == end:
            break
        bit += int(take[upto])
        table, before, since = literals.copy(), b"", 0
    return b"".join(out)[:most]


def _looked_up(codes: list[int], table: list[bytes], before: bytes) -> tuple[list[bytes], bytes]:
    """The strings of codes without a clear code between them; ``table`` grows up to 4096 of them."""
    out: list[bytes] = []
    append, add = out.append, table.append
    first = 0
    if codes and not before:
        if codes[0] >= len(table):
            raise ValueError("a GIF code stream begins with an unknown code")
        before = table[codes[0]]
        append(before)
        first = 1
    grows = first + 4096 - len(table)
    for code in codes[first:grows]:
        try:
            entry = table[code]
        except IndexError:
            # The string that this very code is about to define; no other code may lie beyond the table.
            if code != len(table):
                raise ValueError("a GIF code stream holds an unknown code") from None
            entry = before + before[:1]
        add(before + entry[:1])
        append(entry)
        before = entry
    for code in codes[max(grows, first) :]:
        before = table[code]
        append(before)
    return out, before


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


_GREYS = bytes(v for i in range(256) for v in (i, i, i))


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), with zero bytes up to a positive multiple of the width."""
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % WIDTH or (WIDTH if not raw else 0))


def encode_gif(payload: bytes) -> bytes:
    """The payload, a positive multiple of the width, as a grey animation of full-width frames."""
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREYS]
    for top in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - top)
        control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0)
        image = struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, n, 0)
        parts += [control, image, b"\x08", _blocks(lzw_encode(payload[top * WIDTH : (top + n) * WIDTH]))]
    return b"".join([*parts, b"\x3b"])


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, n, step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode_gif(data: bytes) -> list[Frame]:
    """All frames of a GIF as they are shown; a malformed header or image raises ValueError."""
    return [f._replace(canvas=f.canvas.copy()) for f in shown_frames(data)]


def shown_frames(data: bytes) -> Iterator[Frame]:
    """The frames one by one, on one canvas that is only right until the next is asked for."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = np.frombuffer(data[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    clock = 0
    disposal, delay, transparent = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                transparent = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, colours = at + 10, palette
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            colours, at = np.frombuffer(data[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n
        if colours is None:
            raise ValueError("an image has no palette")
        if w * h > MOST_PIXELS or not 1 <= data[at] <= 11:
            raise ValueError("an image is too large or has no such codes")
        stream, at_next = sub_blocks(at + 1)
        indices = lzw_decode(stream, data[at], w * h)
        at = at_next
        pixels = np.frombuffer(indices + b"\0" * (w * h - len(indices)), dtype=np.uint8).reshape(h, w)
        if flags & 0x40:
            pixels = _deinterlaced(pixels)
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + h, left : left + w]
        shown = pixels[: view.shape[0], : view.shape[1]]
        opaque = (shown != transparent) & (shown < len(colours))
        if opaque.all():
            view[..., :3], view[..., 3] = colours[shown], 255
        else:
            view[opaque, :3], view[opaque, 3] = colours[shown[opaque]], 255
        yield Frame(clock, delay, disposal, canvas, pixels.tobytes())
        clock += delay
        if disposal == 2:
            view[:] = 0
        elif before is not None:
            canvas = before
        disposal, delay, transparent = 0, 0, -1


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels by red, green and blue value, in equal bins of each."""
    shown = canvas[..., 3] > 0
    seen = (canvas.reshape(-1, 4) if shown.all() else canvas[shown])[:, :3] // (256 // BINS)
    return [int(x) for c in range(3) for x in np.bincount(seen[:, c], minlength=BINS)]


def _appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def write_gifs(docs: DataFrame, text_column: str = "text", to: str = "_media") -> DataFrame:
    """``docs`` with each text stored as a GIF.

    - A null or empty text is one row of zero bytes. A long one takes more frames; its task holds it a few times.
    - Equal texts, and so repeated rows, give equal bytes. An empty table gives no rows.
    - Other columns may have any names; one of the added name, in any case, is replaced.
    """
    docs = replaced(docs, to)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            media = [encode_gif(payload_of(t)) for t in batch.column(place).to_pylist()]
            yield _appended(batch, {to: pa.array(media, pa.binary())})

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(to, T.BinaryType())]))


FRAMES = "array<struct<start_ms:bigint,delay_ms:bigint,width:int,height:int,histogram:array<int>>>"


def read_gifs(media: DataFrame, column: str = "_media", payload: str = "_payload", frames: str = "_frames") -> DataFrame:
    """``media`` with the frames that the GIFs show and the colour indices that they hold, all frames in order.

    - A null or malformed GIF, and one whose canvas or image has more than MOST_PIXELS pixels, has null frames and a null
      payload; one without images has no frames and an empty payload. A code stream that ends early gives what it holds.
    - Any number of frames is read: one canvas at a time is held, beside the payload.
    - Repeated rows agree. An empty table gives no rows.
    - Other columns may have any names; those of the added names, in any case, are replaced.
    """
    media = replaced(media, payload, frames)
    place = media.columns.index(column)
    struct_type = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int32()))])

    def one(data: bytes | None) -> tuple[bytes | None, list | None]:
        if data is None:
            return None, None
        held, shown = [], []
        try:
            for f in shown_frames(data):
                held.append(f.indices)
                shown.append({"start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "histogram": histogram(f.canvas)})
        except (ValueError, IndexError, struct.error):
            return None, None
        return b"".join(held), shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            both = [one(x) for x in batch.column(place).to_pylist()]
            yield _appended(batch, {payload: pa.array([p for p, _ in both], pa.binary()), frames: pa.array([f for _, f in both], pa.list_(struct_type))})

    fields = [T.StructField(payload, T.BinaryType()), T.StructField(frames, T.StructType.fromDDL(f"x {FRAMES}")[0].dataType)]
    return mapped(media, run, T.StructType([*media.schema.fields, *fields]))
