"""Media columns: GIF reading, with a writer that stores bytes losslessly as grey pixels.

Reader: the blocks of GIF87a and GIF89a, LZW code streams of any code size with early or deferred clear
codes, interlaced images, global and local palettes, transparency, the four disposal rules, and frame
delays. A frame is the whole canvas as it is shown, with a colour histogram of 64 bins (two bits a
channel), of the shown pixels of its own rectangle.

Writer: rows of 64 bytes are rows of pixels with a grey palette, `ROWS` rows a frame; each frame draws
over the last and stays. The payload is read back from the shown canvases, not from the code stream.

Code widths depend only on a code's place after the last clear code, so codes are packed and unpacked
in NumPy; only the string table runs in a Python loop, one step a code.

Edge cases: null and empty texts are one row of zeros; a broken file raises in `frames_of` and gives no
frames but an `error` in `frames`, as does a canvas of more than `MAX_PIXELS`; truncated pixel data leaves the remaining pixels undrawn; long texts
are more frames, never larger canvases; repeated rows give equal rows; null ids stay null; an empty table gives
an empty result; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.vectext import blocks

WIDTH, ROWS, DELAY = 64, 1024, 4
#: Canvases and images beyond are refused: their size is only said in a header, whatever the file holds.
MAX_PIXELS = 1 << 25
_BITS = np.arange(12, dtype=np.uint32)
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_SINGLE = [bytes([i]) for i in range(256)]
_widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class GifError(ValueError):
    pass


def code_widths(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, first bit) of the n codes after a clear code, for a minimum code size. The reader's table
    has grown by one entry a code from the second code on."""
    if size not in _widths or len(_widths[size][0]) < n:
        k = np.arange(max(n, 8192))
        entries = (1 << size) + 2 + np.maximum(k - 1, 0)
        bits = np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)
        bits = np.maximum(bits, size + 1)
        _widths[size] = (bits, np.cumsum(bits) - bits)
    return tuple(x[:n] for x in _widths[size])


def lzw_codes(data: bytes) -> list[int]:
    """Codes for 8-bit samples, a clear code first and whenever the table is full."""
    codes, table, entry = [256], {}, 258
    add, get = codes.append, table.get
    stream = iter(data)
    prefix = next(stream)
    for c in stream:
        key = prefix << 8 | c
        known = get(key)
        if known is not None:
            prefix = known
            continue
        add(prefix)
        table[key] = entry
        entry += 1
        prefix = c
        if entry == 4096:
            add(256)
            table.clear()
            entry = 258
    add(prefix)
    add(257)
    return codes


def pack(codes: list[int]) -> bytes:
    c = np.array(codes, np.uint32)
    clear = np.flatnonzero(c == 256)
    place = np.arange(len(c))
    place[1:] -= np.repeat(clear + 1, np.diff(np.append(clear + 1, len(c))))
    bits = code_widths(8, int(place.max()) + 1)[0][place]
    bits[0] = 9
    use = _BITS < bits[:, None]
    return np.packbits(((c[:, None] >> _BITS) & 1).astype(np.uint8)[use], bitorder="little").tobytes()


def lzw_samples(data: bytes, size: int, most: int) -> bytes:
    """The pixels of a code stream, at most `most`."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + bytes(8), np.uint8)
    total = len(data) * 8
    base = _SINGLE[:clear] + [b"", b""]
    table, out, length, seen = list(base), [], 0, 0
    prev: bytes | None = None
    at = place = 0
    while at + size < total and length < most:
        widths, first = code_widths(size, place + 4096)
        bit = at + first[place:] - first[place]
        fits = bit + widths[place:] <= total
        bit, mask = bit[fits], (1 << widths[place:][fits]) - 1
        if not len(bit):
            break
        i = bit >> 3
        word = raw[i].astype(np.int64) | raw[i + 1].astype(np.int64) << 8 | raw[i + 2].astype(np.int64) << 16
        codes = word >> (bit & 7) & mask
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        known = len(table)
        add, grow = out.append, table.append
        for c in codes[:n].tolist():
            if prev is None:
                if c >= clear:
                    raise GifError("code stream begins inside the table")
                entry = table[c]
            else:
                if c < known:
                    entry = table[c]
                elif c == known and known < 4096:
                    entry = prev + prev[:1]
                else:
                    raise GifError("code beyond the table")
                if known < 4096:
                    grow(prev + entry[:1])
                    known += 1
            add(entry)
            prev = entry
        length += sum(map(len, out[seen:]))
        seen = len(out)
        if len(stop):
            if codes[n] == end:
                break
            at, place = int(bit[n] + widths[place + n]), 0
            table, prev = list(base), None
        else:
            at, place = int(bit[-1] + widths[place + len(bit) - 1]), place + len(bit)
    return b"".join(out)[:most]


@dataclass
class Frame:
    number: int
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height
    canvas: np.ndarray  # (height, width, 3)
    drawn: np.ndarray  # pixels of the box that this frame draws

    def histogram(self) -> np.ndarray:
        x, y, w, h = self.box
        top = self.canvas[y : y + h, x : x + w].reshape(-1, 3)[self.drawn.reshape(-1)] >> 6
        return np.bincount(top[:, 0].astype(np.int64) << 4 | top[:, 1].astype(np.int64) << 2 | top[:, 2], minlength=64)


def frames_of(gif: bytes) -> Iterator[Frame]:
    """The frames as shown. A canvas is reused for the next frame: copy what is to be kept."""
    if gif[:6] not in (b"GIF87a", b"GIF89a") or len(gif) < 13:
        raise GifError("not a GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", gif[6:13])
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 << ((flags & 7) + 1)
        if at + n > len(gif):
            raise GifError("palette is cut off")
        table = np.zeros((256, 3), np.uint8)
        table[: n // 3] = np.frombuffer(gif, np.uint8, n, at).reshape(-1, 3)
        return table, at + n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(gif) and gif[at]:
            parts.append(gif[at + 1 : at + 1 + gif[at]])
            at += 1 + gif[at]
        return b"".join(parts), at + 1

    common, at = palette(flags, at)
    if height * width > MAX_PIXELS:
        raise GifError(f"canvas of {width} x {height} is over {MAX_PIXELS} pixels")
    canvas = np.zeros((height, width, 3), np.uint8)
    ground = common[back] if common is not None else np.zeros(3, np.uint8)
    number, delay, disposal, clear = 0, 0, 0, -1
    while at < len(gif):
        kind = gif[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = gif[at + 1] if at + 1 < len(gif) else 0
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                clear = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise GifError(f"unknown block {kind:#x}")
        if at + 10 > len(gif):
            raise GifError("image is cut off")
        x, y, w, h, local = struct.unpack("<HHHHB", gif[at + 1 : at + 10])
        if w * h > MAX_PIXELS:
            raise GifError(f"image of {w} x {h} is over {MAX_PIXELS} pixels")
        own, at = palette(local, at + 10)
        colours = own if own is not None else common
        if colours is None or at >= len(gif) or not 1 <= gif[at] <= 11:
            raise GifError("image without palette or code size")
        size = gif[at]
        body, at = sub_blocks(at + 1)
        pixels = np.frombuffer(lzw_samples(body, size, w * h), np.uint8)
        drawn = np.zeros(w * h, bool)
        drawn[: len(pixels)] = pixels != clear if clear >= 0 else True
        index = np.zeros(w * h, np.uint8)
        index[: len(pixels)] = pixels
        index, drawn = index.reshape(h, w), drawn.reshape(h, w)
        if local & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.argsort(order)  # stored row k is shown in row order[k]
            index, drawn = index[rows], drawn[rows]
        before = canvas.copy() if disposal == 3 else None
        spot = canvas[y : y + h, x : x + w]
        ih, iw = spot.shape[:2]
        spot[drawn[:ih, :iw]] = colours[index[:ih, :iw]][drawn[:ih, :iw]]
        yield Frame(number, delay, (x, y, iw, ih), canvas, drawn[:ih, :iw].copy())
        if disposal == 2:
            spot[:] = ground
        elif before is not None:
            canvas = before
        number, delay, disposal, clear = number + 1, 0, 0, -1


def write(payload: bytes) -> bytes:
    """A GIF whose shown pixels are the payload, a positive multiple of WIDTH bytes."""
    step = WIDTH * ROWS
    high = min(len(payload) // WIDTH, ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, high, 0xF7, 0, 0), _GREY]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        body = pack(lzw_codes(part))
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        full = len(body) // 255 * 255
        if full:
            rows = np.frombuffer(body, np.uint8, full).reshape(-1, 255)
            out.append(np.concatenate([np.full((len(rows), 1), 255, np.uint8), rows], 1).tobytes())
        if len(body) > full:
            out.append(bytes([len(body) - full]) + body[full:])
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def read(gif: bytes) -> tuple[bytes, str]:
    """(payload, feature): the grey of every frame's box in order, and what the frames look like."""
    parts, hist, shown, n = [], np.zeros(64, np.int64), 0, 0
    for f in frames_of(gif):
        x, y, w, h = f.box
        parts.append(f.canvas[y : y + h, x : x + w, 0].tobytes())
        hist += f.histogram()
        shown, n = shown + f.delay_ms, n + 1
    bins = " ".join(f"{k}:{v}" for k, v in enumerate(hist.tolist()) if v)
    return b"".join(parts), f"frames={n} ms={shown} hist={bins}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in blocks(b.column(1)):
                o = offsets.tolist()
                media = [write(padded(data[a:e].tobytes())) for a, e in zip(o[:-1], o[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, frame, delay_ms, left, top, width, height, histogram, error: one row per frame; a file that
    cannot be read ends with one row of null frame and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "frame", "delay_ms", "left", "top", "width", "height", "histogram", "error"]
        types = [pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int64()), pa.string()]
        for b in batches:
            for id_, gif in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    rows += [(id_, f.number, f.delay_ms, *f.box, f.histogram().tolist(), None) for f in frames_of(gif or b"")]
                except GifError as e:
                    rows.append((id_, None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, frame int, delay_ms int, left int, top int, width int, height int, histogram array<long>, error string"
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: what
    is read back from the stored form of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, n, gif in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload, feature = read(gif)
                rows.append((id_, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored_texts(docs).mapInArrow(run, schema)
