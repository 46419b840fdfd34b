"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames, histograms.

``frames`` turns a binary column into one row a frame: its time, its rectangle, the canvas after
the frame is drawn (RGBA, as a viewer shows it) and a histogram of 4 x 4 x 4 colours.

LZW without a loop over codes. The width of the i-th code after a clear depends on i alone, so a
stream's codes are cut with array operations. Entry e of the dictionary is the output of code e
and one more pixel, which lies next in the output: so each output pixel has an earlier pixel as
its source, and pointer doubling finds the literal that it stems from. Lengths come by doubling too.

Defined results (column ``error``, null where all is well): null or empty bytes give one row without
a frame, ``empty``; no GIF header, ``header``; no image, ``no image``; a stream that breaks off or
refers to a code it has not defined keeps the pixels before that, transparent after them, ``truncated``
or ``code``; a frame without any palette is not drawn, ``palette``; a canvas of more than
MAX_PIXELS is not drawn, ``canvas``; a frame that reaches over the canvas is clipped. The frames before a
defect are kept. Frames are decoded one by one, so a file's length costs no memory. Repeated rows, and ids that are null, are decoded as they occur; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: A header may claim 65,535 x 65,535; beyond this a canvas fits neither a task's memory nor, as RGBA, a row.
MAX_PIXELS = 1 << 26
BINS = 64
SCHEMA = "id long, frame int, n_frames int, canvas_width int, canvas_height int, loops int, left int, top int, width int, height int, start_cs long, delay_cs int, disposal int, transparent boolean, interlaced boolean, visible int, histogram array<int>, rgba binary, error string"
_SCHEDULE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit offsets, widths) of the first n codes after a clear."""
    have = _SCHEDULE.get(min_size)
    if have is None or len(have[0]) < n:
        size = max(4200, n)
        nxt = (1 << min_size) + 2 + np.arange(size) - 1
        width = np.full(size, min_size + 1)
        for w in range(min_size + 1, 12):
            width[nxt >= 1 << w] = w + 1
        width[0] = min_size + 1
        have = _SCHEDULE[min_size] = (np.concatenate(([0], np.cumsum(width)[:-1])), width)
    return have[0][:n], have[1][:n]


def _expand(c: np.ndarray, min_size: int, room: int) -> tuple[np.ndarray, str | None]:
    """Pixels of the codes between two clears; at most ``room`` (and the rest of a code)."""
    first = (1 << min_size) + 2
    at = np.arange(len(c))
    p = np.where(c < first - 2, -1, c - first)
    bad = (p >= at) | (p >= 4096 - first) | (c == first - 2) | (c == first - 1)
    error = None
    if bad.any():
        n = int(bad.argmax())
        c, p, at, error = c[:n], p[:n], at[:n], "code"
    if not len(c):
        return np.zeros(0, np.uint8), error
    size, jump = np.ones(len(c), np.int64), p.copy()
    while (far := jump >= 0).any():
        to = np.where(far, jump, 0)
        size = np.where(far, size + size[to], size)
        jump = np.where(far, jump[to], -1)
    starts = np.cumsum(size) - size
    n = int(np.searchsorted(starts, room))
    c, p, size, starts = c[:n], p[:n], size[:n], starts[:n]
    back = np.where(p < 0, 0, starts[np.maximum(p, 0)] - starts)
    src = np.arange(int(size.sum())) + np.repeat(back, size)
    while True:
        to = src[src]
        if np.array_equal(to, src):
            break
        src = to
    return np.repeat(c.astype(np.uint8), size)[src], error


def lzw(data: bytes, min_size: int, n_pixels: int) -> tuple[np.ndarray, str | None]:
    """(at most n_pixels palette indexes, error)."""
    if not 1 <= min_size <= 11:
        return np.zeros(0, np.uint8), "code"
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    bits, at, out, got, error, ended = 8 * len(data), 0, [], 0, None, False
    while not ended and got < n_pixels and error is None:
        n = max(1, min((bits - at) // (min_size + 1), 4200))
        while True:
            off, width = _schedule(min_size, n)
            fits = int(np.searchsorted(off + width, bits - at, side="right"))
            pos = at + off[:fits]
            c = word[pos >> 3] >> (pos & 7) & ((1 << width[:fits]) - 1)
            stop = np.flatnonzero((c == clear) | (c == end))
            if len(stop) or fits < n or n >= bits - at:
                break
            n *= 4  # a full dictionary without a clear: the width stays 12
        k = int(stop[0]) if len(stop) else fits
        x, error = _expand(c[:k], min_size, n_pixels - got)
        out.append(x)
        got += len(x)
        if not len(stop):
            error = error or ("truncated" if got < n_pixels else None)
            break
        ended = c[k] == end
        at += int(off[k] + width[k])
    x = np.concatenate(out)[:n_pixels] if out else np.zeros(0, np.uint8)
    return x, error or ("truncated" if len(x) < n_pixels else None)


def _blocks(b: bytes, i: int) -> tuple[bytes, int, bool]:
    """(joined sub-blocks, place after them, whether they ended)."""
    parts = []
    while i < len(b):
        n = b[i]
        if not n:
            return b"".join(parts), i + 1, True
        parts.append(b[i + 1 : i + 1 + n])
        i += 1 + n
    return b"".join(parts), len(b), False


def _palette(b: bytes, i: int, packed: int) -> tuple[np.ndarray | None, int]:
    """(256 colours as RGBA in 32 bits, place after them)."""
    if not packed & 0x80:
        return None, i
    n = 2 << (packed & 7)
    table = np.full(256, 0xFF000000, np.uint32)
    x = np.frombuffer(b[i : i + 3 * n], np.uint8)
    x = x[: len(x) // 3 * 3].reshape(-1, 3).astype(np.uint32)
    table[: len(x)] |= x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16
    return table, i + 3 * n


@dataclass
class _Image:
    """One image block as the file holds it."""

    left: int
    top: int
    width: int
    height: int
    flags: int
    palette: np.ndarray | None
    min_size: int
    data: tuple[int, int]
    disposal: int
    delay: int
    clear: int


def _images(b: bytes) -> tuple[np.ndarray | None, int, list[_Image], str | None]:
    """(shared palette, loops, images, why the file ends early); nothing is decoded yet."""
    shared, i = _palette(b, 13, b[10])
    out: list[_Image] = []
    loops, disposal, delay, clear, problem = 1, 0, 0, -1, "truncated"
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            problem = None
            break
        if kind == 0x21 and i + 1 < len(b):
            label = b[i + 1]
            data, i, whole = _blocks(b, i + 2)
            if label == 0xF9 and len(data) >= 4:
                disposal, delay, clear = data[0] >> 2 & 7, data[1] | data[2] << 8, data[3] if data[0] & 1 else -1
            elif label == 0xFF and data[:11] == b"NETSCAPE2.0" and len(data) >= 14 and data[11] == 1:
                loops = data[12] | data[13] << 8
            if not whole:
                break
            continue
        if kind != 0x2C or i + 11 > len(b):
            break
        place = [b[i + k] | b[i + k + 1] << 8 for k in (1, 3, 5, 7)]
        flags = b[i + 9]
        own, i = _palette(b, i + 10, flags)
        if i >= len(b):
            break
        min_size, start = b[i], i + 1
        i = start
        while i < len(b) and b[i]:
            i += 1 + b[i]
        out.append(_Image(*place, flags, own if own is not None else shared, min_size, (start, min(i + 1, len(b))), disposal, delay, clear))
        disposal, delay, clear = 0, 0, -1
        if i >= len(b):
            break
        i += 1
    return shared, loops, out, problem


def _bins(colours: np.ndarray) -> np.ndarray:
    """Histogram of packed RGBA; what is transparent isn't counted."""
    c = colours[colours >> 24 > 0]
    return np.bincount((c >> 2 & 0x30) | (c >> 12 & 0x0C) | (c >> 22 & 0x03), minlength=BINS)


def decode_frames(b: bytes | None) -> Iterator[dict]:
    """The frames of one file, one by one, as dicts of SCHEMA's columns without id; never raises on any bytes."""
    if not b:
        yield {"error": "empty"}
        return
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        yield {"error": "header"}
        return
    w, h = b[6] | b[7] << 8, b[8] | b[9] << 8
    common = {"canvas_width": w, "canvas_height": h, "loops": 1}
    if not 0 < w * h <= MAX_PIXELS:
        yield common | {"error": "canvas"}
        return
    _, loops, images, problem = _images(b)
    common["loops"] = loops
    if not images:
        yield common | {"error": "no image"}
        return
    canvas = np.zeros((h, w), np.uint32)  # RGBA, red in the lowest byte
    total, clock = np.zeros(BINS, np.int64), 0
    for n, im in enumerate(images):
        x, y, fw, fh = im.left, im.top, im.width, im.height
        y1, x1, error = min(y + fh, h), min(x + fw, w), None
        inside = y < y1 and x < x1
        region = canvas[y:y1, x:x1] if inside else canvas[:0]
        before = region.copy()
        if im.palette is None:
            error = "palette"
        elif fw * fh > MAX_PIXELS:
            error = "canvas"
        else:
            px, error = lzw(_blocks(b, im.data[0])[0], im.min_size, fw * fh)
            got = len(px)
            if got < fw * fh:
                px = np.concatenate((px, np.zeros(fw * fh - got, np.uint8)))
            full = px.reshape(fh, fw)
            show = None if got == fw * fh else (np.arange(fw * fh) < got).reshape(fh, fw)
            if im.clear >= 0:
                show = full != im.clear if show is None else show & (full != im.clear)
            if im.flags & 0x40 and fh:
                rows = np.concatenate([np.arange(s, fh, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                inverse = np.argsort(rows)
                full, show = full[inverse], show if show is None else show[inverse]
            if inside:
                new = im.palette[full[: y1 - y, : x1 - x]]
                if show is None:
                    region[:] = new
                else:
                    np.copyto(region, new, where=show[: y1 - y, : x1 - x])
        drawn = _bins(region)
        total = total + drawn if n == 0 else total - _bins(before) + drawn  # the canvas starts blank
        if n == len(images) - 1 and problem and error is None:
            error = problem
        yield common | {"n_frames": len(images), "frame": n, "left": x, "top": y, "width": fw, "height": fh, "start_cs": clock, "delay_cs": im.delay, "disposal": im.disposal, "transparent": im.clear >= 0, "interlaced": bool(im.flags & 0x40), "visible": int(total.sum()), "histogram": total.tolist(), "rgba": canvas.astype("<u4", copy=False).tobytes(), "error": error}
        clock += im.delay
        if im.disposal in (2, 3):
            total = total - drawn
            region[:] = before if im.disposal == 3 else 0
            total = total + _bins(before) if im.disposal == 3 else total


def decode(b: bytes | None) -> list[dict]:
    return list(decode_frames(b))


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "string": pa.string()}
_ARROW = [_TYPES[x.split()[1]] for x in SCHEMA.split(", ")]
BATCH_BYTES = 8 << 20


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _ARROW, strict=True)], _NAMES)

    for b in batches:
        rows, size = [], 0
        for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for r in decode_frames(data.as_py()):
                rows.append(r | {"id": i})
                size += 300 + len(r.get("rgba") or b"")
                if size > BATCH_BYTES:
                    yield emit(rows)
                    rows, size = [], 0
        if rows:
            yield emit(rows)


def frames(df: DataFrame, id_column: str, gif_column: str) -> DataFrame:
    """One row a frame (SCHEMA), by a map over the table; no shuffle."""
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(gif_column).cast("binary").alias("gif")).mapInArrow(_frames, SCHEMA)


def lzw_encode(pixels: bytes, min_size: int) -> bytes:
    clear, end, first = 1 << min_size, (1 << min_size) + 1, (1 << min_size) + 2 << 8
    codes: list[int] = [clear << 8]
    lengths, begun = [1], 1
    table: dict[int, int] = {}  # (code, next pixel) -> code; codes are kept shifted by 8 bits
    get, put, nxt, literal = table.get, codes.append, first, [c << 8 for c in range(256)]
    w = literal[pixels[0]] if pixels else -1
    for c in pixels[1:]:
        k = w | c
        if x := get(k):
            w = x
            continue
        put(w)
        table[k] = nxt
        nxt += 256
        w = literal[c]
        if nxt > 4095 << 8:
            put(clear << 8)
            lengths.append(len(codes) - begun)
            begun = len(codes)
            table.clear()
            nxt = first
    if w >= 0:
        put(w)
    put(end << 8)
    lengths.append(len(codes) - begun)
    flat = (np.array(codes, np.uint32) >> 8).astype(np.uint16)
    width = np.concatenate([_schedule(min_size, n)[1] for n in lengths])
    bits = np.unpackbits(flat.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16)[None, :] < width[:, None]], bitorder="little").tobytes()


def encode(width: int, height: int, palette: np.ndarray, images: list[dict], loops: int = 0) -> bytes:
    """A GIF of images {left, top, pixels (2-d indexes), delay, disposal, clear, interlaced, palette}."""

    def colours(t: np.ndarray) -> tuple[int, bytes]:
        bits = max(1, (len(t) - 1).bit_length())
        return bits, t.astype(np.uint8).tobytes() + bytes(3 * ((1 << bits) - len(t)))

    bits, table = colours(palette)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0xF0 | bits - 1, 0, 0]), table, b"\x21\xff\x0bNETSCAPE2.0\x03\x01", loops.to_bytes(2, "little"), b"\0"]
    for im in images:
        px, clear, local = im["pixels"], im.get("clear"), im.get("palette")
        out.append(bytes([0x21, 0xF9, 4, im.get("disposal", 0) << 2 | (clear is not None)]) + im.get("delay", 0).to_bytes(2, "little") + bytes([clear or 0, 0]))
        own, flags = b"", 0x40 if im.get("interlaced") else 0
        depth = bits
        if local is not None:
            depth, own = colours(local)
            flags |= 0x80 | depth - 1
        if im.get("interlaced"):
            px = px[np.concatenate([np.arange(s, len(px), d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])]
        place = b"".join(v.to_bytes(2, "little") for v in (im.get("left", 0), im.get("top", 0), px.shape[1], px.shape[0]))
        data = lzw_encode(px.astype(np.uint8).tobytes(), max(2, depth))
        out.append(b"\x2c" + place + bytes([flags]) + own + bytes([max(2, depth)]))
        out += [bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


#: Bytes that one frame of a drawn page holds.
CELLS = 1 << 16


def page_gif(html: bytes, page_id: int) -> bytes:
    """The tables hold no media, so each page is drawn: every byte of its html is a pixel, in as many frames as that takes, then come 0 to 3 changes."""
    seed = zlib.crc32(html) ^ page_id & 0xFFFFFFFF
    b = np.frombuffer(html, np.uint8)
    width = max(1, int(np.ceil(np.sqrt(min(len(b), CELLS)))))
    height = max(1, -(-min(len(b), CELLS) // width))
    sheets = max(1, -(-len(b) // (width * height)))
    px = np.concatenate((b, np.zeros(sheets * width * height - len(b), np.uint8))).reshape(sheets, height, width)
    k = np.arange(256)
    palette = np.stack([k, (k * (seed & 15) * 16 + (seed >> 4 & 63)) & 255, 255 - (k * (seed >> 12 & 15) >> 4)], 1)
    images = [{"pixels": x, "delay": 4 + (seed & 7), "disposal": seed >> 3 & 1, "interlaced": bool(seed & 32)} for x in px]
    for n in range(seed >> 6 & 3):
        s = seed >> (n * 3)
        y, x, d = min(s & 7, height - 1), min(s >> 2 & 7, width - 1), 6 + (s >> 5 & 3)
        images.append({"left": x, "top": y, "pixels": px[-1, y : y + d, x : x + d] ^ np.uint8(n + 1), "delay": 2 + (s & 3), "disposal": s >> 8 & 3, "clear": s & 15 if s & 64 else None, "palette": palette[::-1] if s & 128 else None})
    return encode(width, height, palette, images)


def page_gifs(pages: DataFrame) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_gif(x.as_py() or b"", i or 0) for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True)], pa.binary())], ["page_id", "gif"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("binary").alias("html")).mapInArrow(draw, "page_id long, gif binary")


def op1_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of the GIFs of all pages."""
    return frames(page_gifs(read(spark, sf_dir, "pages")), "page_id", "gif").withColumnRenamed("id", "page_id")
