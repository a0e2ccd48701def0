import hashlib
import struct
import zlib

import numpy as np
import pytest

from evisite.llm import gif

#: The well-known 10 x 10 sample image of the GIF literature, four colours (fixed values).
SAMPLE = bytes.fromhex("4749463839610a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a00000216 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b".replace(" ", ""))


def test_known_image():
    (canvas, _), = gif.read_gifs([SAMPLE])[0]
    top = [1, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    a, b = [1, 1, 1, 0, 0, 0, 0, 2, 2, 2], [2, 2, 2, 0, 0, 0, 0, 1, 1, 1]
    index = np.array([top] * 3 + [a] * 2 + [b] * 2 + [top[::-1]] * 3)
    colours = np.array([[255, 255, 255], [255, 0, 0], [0, 0, 255], [0, 0, 0]])
    assert (canvas[:, :, :3] == colours[index]).all()


@pytest.mark.parametrize("size", [1, 2, 576, 3800])
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    px = np.concatenate([rng.integers(0, k, (9, size)) for k in (1, 2, 7, 256)]).astype(np.uint8)
    streams = gif.lzw_encode(px)
    back = gif.lzw_decode(streams, [8] * len(px), [size] * len(px))
    assert (np.stack(back) == px).all()


def plain_codes(px, bits):
    """A plain LZW coder with clear codes when the table is full."""
    clear, out, table = 1 << bits, [], {}
    table = {(k,): k for k in range(clear)}
    out.append((clear, bits + 1))
    free, width, w = clear + 2, bits + 1, ()
    for k in px:
        if (*w, k) in table:
            w = (*w, k)
            continue
        out.append((table[w], width))
        if free < 4096:
            table[(*w, k)] = free
            free += 1
            if free > (1 << width) and width < 12:
                width += 1
        else:
            out.append((clear, width))
            table, free, width = {(j,): j for j in range(clear)}, clear + 2, bits + 1
        w = (k,)
    out.append((table[w], width))
    if free == 1 << width and width < 12:
        width += 1
    out.append((clear + 1, width))
    value, at = 0, 0
    for code, n in out:
        value |= code << at
        at += n
    return value.to_bytes(-(-at // 8), "little")


def test_large_image_with_clear_codes():
    px = np.random.default_rng(3).integers(0, 16, 40_000).astype(np.uint8)
    back = gif.lzw_decode([plain_codes(px.tolist(), 4)], [4], [len(px)])[0]
    assert (back == px).all()


def image(box, px, disposal, delay, clear, rows=False, palette=None):
    bits = (disposal << 2) | (clear is not None)
    local = b"" if palette is None else palette
    flags = (0x40 if rows else 0) | (0x80 | 0 if palette else 0)
    return b"\x21\xf9\x04" + struct.pack("<BHB", bits, delay, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", *box, flags) + local + b"\x02" + gif.blocks(plain_codes(px, 2))


def test_disposal_transparency_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 3, 3, 0x81, 0, 0) + palette
    data = head + image((0, 0, 3, 3), [1] * 9, 1, 5, None)
    data += image((0, 0, 2, 1), [2, 0], 3, 7, 0)
    data += image((1, 1, 1, 1), [3], 2, 1, None)
    data += image((0, 0, 1, 3), [1, 2, 3], 0, 2, None, rows=True) + b"\x3b"
    shown = gif.read_gifs([data])[0]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    f = [np.array(c).tolist() for c, _ in shown]
    assert f[0] == [[red] * 3] * 3
    assert f[1] == [[green, red, red], [red] * 3, [red] * 3]
    assert f[2] == [[red] * 3, [red, blue, red], [red] * 3]
    assert f[3] == [[red, red, red], [blue, [0] * 4, red], [green, red, red]]
    assert [d for _, d in shown] == [5, 7, 1, 2]


def test_text_media(spark):
    texts = {0: "", 1: None, 2: "word " * 200, 3: "é" * 288, 4: "x" * 576, 5: "word " * 200, 6: "日本" * 4000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as media", "2 as frame")
    stored = gif.store_texts(docs)
    for r in gif.digest(stored).collect():
        p = (texts[r.doc_id] or "").encode()
        n = len(p)
        p += b"\xff" * (max(576, -(-n // 576) * 576) - n)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.feature.startswith(f"frames={len(p) // 576};cs={10 * (len(p) // 576)};r=")
    shown = gif.frames(stored.withColumnRenamed("doc_id", "id")).filter("id = 2").orderBy("frame").collect()
    assert [(r.start_cs, r.delay_cs, r.width, sum(r.hist_g)) for r in shown] == [(0, 10, 24, 576), (10, 10, 24, 576)]
    bad = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, b"")], "id long, media binary")
    assert {r.id for r in gif.frames(bad).collect() if r.error} == {1, 3}
    assert gif.digest(gif.store_texts(docs.limit(0))).count() == 0


def test_very_long_text(spark):
    text = "".join(f"line {k} of a long text é\n" for k in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    r = {r.doc_id: r for r in gif.digest(gif.store_texts(docs)).collect()}[1]
    p = text.encode()
    p += b"\xff" * (-len(p) % 576)
    assert (r.payload_bytes, r.payload_sha256) == (len(p), hashlib.sha256(p).hexdigest()) and r.feature.startswith(f"frames={len(p) // 576};")
