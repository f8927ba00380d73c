import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm import gif


def slow_codes(data, size):
    """Bit by bit, as the format's text describes it."""
    clear, end = 1 << size, (1 << size) + 1
    bits = "".join(format(b, "08b")[::-1] for b in data)
    table, width, at, out, prev = {}, size + 1, 0, [], None
    while at + width <= len(bits):
        c = int(bits[at : at + width][::-1], 2)
        at += width
        if c == clear:
            table, width, prev = {i: bytes([i]) for i in range(clear)}, size + 1, None
            nxt = end + 1
            continue
        if c == end:
            break
        if prev is None:
            entry = table[c]
        else:
            entry = table[c] if c in table else prev + prev[:1]
            if nxt < 4096:
                table[nxt] = prev + entry[:1]
                nxt += 1
                if nxt == 1 << width and width < 12:
                    width += 1
        out.append(entry)
        prev = entry
    return b"".join(out)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 40))
def test_code_streams(data, times):
    data *= times
    packed = gif.pack(gif.lzw_codes(data))
    assert gif.lzw_samples(packed, 8, len(data)) == data
    assert slow_codes(packed, 8) == data


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 65_536, 65_537, 300_000])
def test_payload_round_trip(size):
    text = random.Random(size).randbytes(size) if size < 1000 else (b"many words of text, " * (size // 20 + 1))[:size]
    payload = gif.padded(text)
    assert len(payload) % 64 == 0 and len(payload) > 0
    back, feature = gif.read(gif.write(payload))
    assert back == payload
    assert feature.startswith(f"frames={-(-len(payload) // 65536)} ")


def deferred(pixels, size):
    """Every pixel as a literal, the table never cleared: widths stay at 12 once it is full."""
    clear, end = 1 << size, (1 << size) + 1
    bits, width, nxt = format(clear, f"0{size + 1}b")[::-1], size + 1, end + 1
    for k, p in enumerate([*pixels, end]):
        bits += format(p, f"0{width}b")[::-1]
        if k and nxt < 4096:
            nxt += 1
            if nxt == 1 << width and width < 12:
                width += 1
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("size", [2, 4, 8])
def test_deferred_clear(size):
    pixels = [random.Random(size).randrange(1 << size) for _ in range(9000)]
    assert gif.lzw_samples(deferred(pixels, size), size, 9000) == bytes(pixels)


def image(pixels, x, y, w, h, size=2, flags=0, palette=b"", control=None):
    body = deferred(pixels, size)
    out = b"" if control is None else b"\x21\xf9\x04" + struct.pack("<BHB", *control) + b"\0"
    out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + palette + bytes([size])
    return out + b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"


COLOURS = bytes([10, 10, 10, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def movie(*images, w=2, h=2):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + COLOURS + b"".join(images) + b"\x3b"


def canvases(data):
    return [(f.delay_ms, f.canvas.reshape(-1, 3).tolist()) for f in gif.frames_of(data)]


R, G, B, K = [255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 10, 10]


def test_transparency_and_disposal():
    full = image([1, 1, 1, 1], 0, 0, 2, 2, control=(1 << 2, 5, 0))
    hole = image([2, 3], 0, 0, 2, 1, control=(2 << 2 | 1, 7, 3))  # 3 shows through, then the box is cleared
    back = image([2, 2, 2, 2], 0, 0, 2, 2, control=(3 << 2, 1, 0))  # and is taken back
    last = image([3], 1, 1, 1, 1)
    assert canvases(movie(full, hole, back, last)) == [(50, [R, R, R, R]), (70, [G, R, R, R]), (10, [G, G, G, G]), (0, [K, K, R, B])]


def test_local_palette_and_histogram():
    own = bytes([0, 0, 0, 200, 200, 200, 0, 0, 0, 0, 0, 0])
    (f,) = gif.frames_of(movie(image([1, 1, 0, 1], 0, 0, 2, 2, flags=0x81, palette=own)))
    assert f.canvas[0, 0].tolist() == [200] * 3
    assert f.histogram()[63] == 3 and f.histogram()[0] == 1


def test_interlaced_rows():
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = movie(image([r % 4 for r in order], 0, 0, 1, 9, flags=0x40), w=1, h=9)
    (f,) = gif.frames_of(data)
    names = [K, R, G, B]
    assert f.canvas[:, 0].tolist() == [names[r % 4] for r in range(9)]


@pytest.mark.parametrize("data", [b"", b"GIF", b"PNG...........", movie(b"\x99"), movie()[:10]])
def test_broken(data):
    with pytest.raises(gif.GifError):
        list(gif.frames_of(data))


def test_query(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (4, "word " * 30_000)]
    got = {r["doc_id"]: r for r in gif.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = gif.padded(raw)
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(payload)
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-64:])
        assert got[i]["media_sha256"] == hashlib.sha256(gif.write(payload)).hexdigest()
    assert gif.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frames_table(spark):
    media = spark.createDataFrame([(1, bytearray(gif.write(bytes(64 * 1100)))), (2, bytearray(b"no"))], "doc_id long, media binary")
    rows = gif.frames(media).orderBy("doc_id", "frame").collect()
    assert [(r["doc_id"], r["frame"], r["height"]) for r in rows if r["doc_id"] == 1] == [(1, 0, 1024), (1, 1, 76)]
    assert rows[-1]["error"]


def test_hostile_headers(spark):
    """A canvas or an image that only its header makes large is an error, not an allocation."""
    wide = b"GIF89a" + b"\xff\xff\xff\xff" + b"\x80\0\0" + bytes(6)
    image = b"GIF89a" + b"\1\0\1\0" + b"\x80\0\0" + bytes(6) + b"\x2c" + bytes(4) + b"\xff\xff\xff\xff" + b"\0\x02\0\x3b"
    for data in (wide, image):
        with pytest.raises(gif.GifError, match="pixels"):
            list(gif.frames_of(data))
    got = gif.frames(spark.createDataFrame([(1, wide), (None, b"")], "doc_id long, media binary")).collect()
    assert len(got) == 2 and all(r["error"] and r["frame"] is None for r in got)
