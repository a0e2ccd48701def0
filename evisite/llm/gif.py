"""Operator 7: GIF media columns.

Reads GIF 87a/89a byte columns into timed frames: variable-width LZW code streams are decoded, global and local
palettes, interlacing, transparency and the disposal rules (keep, clear, restore) applied; every frame is a full RGBA
canvas with its start and duration in hundredths of a second and 16-bin colour histograms. A writer stores 8-bit
samples losslessly as square frames under an identity grey palette.

LZW is sequential within a frame, so the coder and the decoder step through many frames at once with numpy. The
decoder notes for each code where its string stands already in the output, and resolves these places at the end.

Memory of a task: the frames of one media value and one batch of code streams.

Cases: a null medium gives no frames; a broken one raises ValueError in ``read_gifs`` and gives no frames but an
``error`` text in ``frames``. A null text is the empty payload. Long texts become many frames, coded
some at once. Repeated rows give equal values; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisite.llm.common import settle

TOGETHER = 2048  # frames whose codes are stepped through together
SIDE = 24
UNIT = SIDE * SIDE
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def lzw_encode(pixels: np.ndarray, min_bits: int = 8) -> list[bytes]:
    """LZW streams of frames of at most 3800 samples, one a row of ``pixels``; codes never fill the table."""
    if pixels.shape[1] > 3800:
        raise ValueError("a frame may have 3800 samples at most")
    out = []
    for at in range(0, len(pixels), TOGETHER):
        out += _encode_some(np.ascontiguousarray(pixels[at : at + TOGETHER].T), min_bits)
    return out


def _encode_some(px: np.ndarray, min_bits: int) -> list[bytes]:
    n, frames = px.shape
    clear = 1 << min_bits
    slots = 1 << max(8, int(2 * n - 1).bit_length())
    table = np.full(frames * slots, 0xFFFFFFFF, np.uint32)  # key << 12 | code; key = prefix code << 8 | next sample
    base = np.arange(frames, dtype=np.int64) * slots
    codes = np.zeros((n + 3, frames), np.uint16)
    codes[0] = clear
    count, free = np.ones(frames, np.int64), np.full(frames, clear + 2, np.uint32)
    w, every = px[0].astype(np.uint32), np.arange(frames)
    for t in range(1, n):
        k = px[t]
        key = (w << np.uint32(8)) | k
        slot = (key * np.uint32(2654435769)) >> np.uint32(7)
        left, w_next = every, np.empty_like(w)
        key_l, slot_l = key, slot
        while len(left):
            place = base[left] + (slot_l & np.uint32(slots - 1))
            seen = table[place]
            hit, empty = (seen >> np.uint32(12)) == key_l, seen == 0xFFFFFFFF
            hit &= ~empty
            w_next[left[hit]] = seen[hit] & np.uint32(4095)
            if empty.any():
                new = left[empty]
                table[place[empty]] = (key_l[empty] << np.uint32(12)) | free[new]
                codes[count[new], new] = w[new]
                count[new] += 1
                free[new] += np.uint32(1)
                w_next[new] = k[new]
            more = ~(hit | empty)
            left, key_l, slot_l = left[more], key_l[more], slot_l[more] + np.uint32(1)
        w = w_next
    codes[count, every] = w
    codes[count + 1, every] = clear + 1
    count += 2
    # The width of a code depends on its number only: entries start with the second code after the clear code.
    filled = clear + 2 + np.maximum(0, np.arange(n + 3) - 2)
    width = np.array([min_bits + 1, *[max(min_bits + 1, int(f).bit_length()) for f in filled[1:]]])
    off = np.concatenate([[0], np.cumsum(width)])
    room = np.zeros((off[-1] // 8 + 4, frames), np.uint8)
    for j in range(int(count.max())):
        v = codes[j].astype(np.uint32) << np.uint32(off[j] & 7)
        b = off[j] >> 3
        room[b] |= (v & 255).astype(np.uint8)
        room[b + 1] |= ((v >> 8) & 255).astype(np.uint8)
        room[b + 2] |= (v >> 16).astype(np.uint8)
    rows, size = np.ascontiguousarray(room.T), (off[count] + 7) // 8
    return [rows[f, : size[f]].tobytes() for f in range(frames)]


def lzw_decode(streams: list[bytes], min_bits: list[int], sizes: list[int]) -> list[np.ndarray]:
    """The samples of LZW streams: ``sizes`` of each, zeros where a stream ends early."""
    out = []
    for at in range(0, len(streams), TOGETHER):
        out += _decode_some(streams[at : at + TOGETHER], np.array(min_bits[at : at + TOGETHER]), np.array(sizes[at : at + TOGETHER], np.int64))
    return out


def _decode_some(streams: list[bytes], min_bits: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    frames = len(streams)
    data = np.frombuffer(b"".join(s + b"\0\0\0" for s in streams), np.uint8)
    length = np.array([len(s) for s in streams], np.int64)
    first = (np.cumsum(length + 3) - length - 3) * 8
    base = np.cumsum(sizes) - sizes  # of each frame's samples in the common output
    entries = int(min(4096, (sizes.max() if frames else 0) + (1 << min_bits.max(initial=2)) + 3))
    start, span = np.empty(frames * entries, np.int64), np.empty(frames * entries, np.int32)
    f = np.arange(frames)
    bit, stop, done = first.copy(), first + 8 * length, np.zeros(frames, np.int64)
    clear = (1 << min_bits).astype(np.int64)
    width, free = min_bits + 1, clear + 2
    last_at, last_len = np.zeros(frames, np.int64), np.zeros(frames, np.int64)  # the previous code's string; length 0: none
    ev_to, ev_from, ev_len, ev_val = [], [], [], []
    while len(f):
        b = bit >> 3
        word = data[b].astype(np.int64) | (data[b + 1].astype(np.int64) << 8) | (data[b + 2].astype(np.int64) << 16)
        code = (word >> (bit & 7)) & ((np.int64(1) << width) - 1)
        bit = bit + width
        fits = bit <= stop
        is_clear, is_end = code == clear, (code == clear + 1) | ~fits
        text = ~(is_clear | is_end)
        literal = code < clear
        row = f * entries
        known = text & ~literal & (code < free)
        own = text & ~literal & ~known  # the string being defined by this very code
        if (own & ((code > free) | (last_len == 0))).any():
            raise ValueError("broken LZW stream")
        look = np.where(known, row + code, 0)
        n = np.where(literal, 1, np.where(known, span[look] if known.any() else 0, last_len + 1))
        src = np.where(known, start[look] if known.any() else 0, last_at)
        to = base[f] + done
        n = np.minimum(n, sizes[f] - done)
        if text.all():
            ev_to.append(to), ev_from.append(np.where(literal, to, src)), ev_len.append(n), ev_val.append(np.where(literal, code, 0))
        else:
            ev_to.append(to[text]), ev_from.append(np.where(literal, to, src)[text]), ev_len.append(n[text]), ev_val.append(np.where(literal, code, 0)[text])
        add = text & (last_len > 0) & (free < np.minimum(4096, entries))
        if add.any():
            at = (row + free)[add]
            start[at], span[at] = last_at[add], last_len[add] + 1
        free = np.where(is_clear, clear + 2, free + (text & (last_len > 0) & (free < 4096)))
        width = np.where(is_clear, min_bits[f] + 1, np.minimum(12, width + ((free >= (np.int64(1) << width)) & (width < 12))))
        last_at, last_len = np.where(text, to, last_at), np.where(is_clear, 0, np.where(text, n, last_len))
        done = done + np.where(text, n, 0)
        go = ~is_end & (done < sizes[f])
        if not go.all():
            f, bit, stop, done, clear, width, free, last_at, last_len = (x[go] for x in (f, bit, stop, done, clear, width, free, last_at, last_len))
    total = int(sizes.sum())
    value, link = np.zeros(total, np.uint8), np.arange(total)
    if ev_to:
        to, src, n, val = (np.concatenate(x) for x in (ev_to, ev_from, ev_len, ev_val))
        value[to[n > 0]] = val[n > 0]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        link[np.repeat(to, n) + step] = np.repeat(src, n) + step
    open_ = np.flatnonzero(link != np.arange(total))
    while len(open_):  # follow the places until each stands at a literal
        onward = link[link[open_]]
        moved = onward != link[open_]
        link[open_] = onward
        open_ = open_[moved]
    value = value[link]
    return [value[a : a + s] for a, s in zip(base, sizes)]


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def write_gifs(payloads: list[bytes], delay: int = 10) -> list[bytes]:
    """Each payload (a positive multiple of 576 bytes) as 24 x 24 frames of a grey GIF."""
    frames = [len(p) // UNIT for p in payloads]
    streams = iter(lzw_encode(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)))
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + GREY
    intro = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    return [head + b"".join([intro + blocks(next(streams)) for _ in range(n)]) + b"\x3b" for n in frames]


def _parse(data: bytes) -> tuple[int, int, list[dict]]:
    """Canvas size and the images of a GIF with their palettes, places, timing and code streams."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    if len(data) < 13:
        raise ValueError("the GIF is cut off")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + size], at + size
    images, control = [], (0, 0, None)
    try:
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                label, at = data[at + 1], at + 2
                if label == 0xF9:
                    bits, delay, clear = struct.unpack_from("<BHB", data, at + 1)
                    control = ((bits >> 2) & 7, delay, clear if bits & 1 else None)
                while data[at]:
                    at += data[at] + 1
                at += 1
            elif kind == 0x2C:
                left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
                at, colours = at + 10, palette
                if bits & 0x80:
                    size = 3 << ((bits & 7) + 1)
                    colours, at = data[at : at + size], at + size
                if colours is None:
                    raise ValueError("an image without a palette")
                min_bits, at, parts = data[at], at + 1, []
                while data[at]:
                    parts.append(data[at + 1 : at + 1 + data[at]])
                    at += data[at] + 1
                at += 1
                images.append({"box": (left, top, w, h), "palette": colours, "rows": bool(bits & 0x40), "min_bits": min_bits, "stream": b"".join(parts), "disposal": control[0], "delay": control[1], "clear": control[2]})
                control = (0, 0, None)
            else:
                raise ValueError(f"unknown block {kind:#x}")
    except (IndexError, struct.error):
        raise ValueError("the GIF is cut off") from None
    return wide, high, images


def _canvases(wide: int, high: int, images: list[dict]):
    """RGBA canvases as shown, one a frame."""
    shown = np.zeros((high, wide, 4), np.uint8)
    for im in images:
        left, top, w, h = im["box"]
        index = im["pixels"].reshape(h, w)
        if im["rows"]:  # four passes: every 8th row from 0 and 4, every 4th from 2, every 2nd from 1
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            plain = np.empty_like(index)
            plain[order] = index
            index = plain
        colours = np.zeros((256, 4), np.uint8)
        n = len(im["palette"]) // 3
        colours[:n, :3] = np.frombuffer(im["palette"], np.uint8).reshape(n, 3)
        colours[:, 3] = 255
        before = shown.copy() if im["disposal"] == 3 else None
        index = index[: max(0, high - top), : max(0, wide - left)]
        part = shown[top : top + h, left : left + w]
        if im["clear"] is None:
            part[...] = colours[index]
        else:
            seen = index != im["clear"]
            part[seen] = colours[index[seen]]
        yield shown.copy(), im["delay"]
        if im["disposal"] == 2:
            part[...] = 0
        elif im["disposal"] == 3:
            shown = before


def read_gifs(media: list[bytes]) -> list[list[tuple[np.ndarray, int]]]:
    """(RGBA canvas, delay) of each frame of each GIF; all code streams are decoded together."""
    parsed = [_parse(m) for m in media]
    images = [im for _, _, ims in parsed for im in ims]
    pixels = lzw_decode([i["stream"] for i in images], [i["min_bits"] for i in images], [i["box"][2] * i["box"][3] for i in images])
    for im, p in zip(images, pixels):
        im["pixels"] = p
    return [list(_canvases(*p)) for p in parsed]


def histogram(channel: np.ndarray) -> np.ndarray:
    return np.bincount(channel.reshape(-1) >> 4, minlength=16)


FRAME_SCHEMA = "id long, frame int, start_cs long, delay_cs int, width int, height int, rgba binary, hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"


def frames(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row per frame of every GIF, or one row with ``error``."""

    def decoded(batches):
        for pdf in batches:
            for key, m in zip(pdf["id"], pdf["media"]):
                if m is None:
                    continue
                rows, start = [], 0
                try:
                    for k, (canvas, delay) in enumerate(read_gifs([bytes(m)])[0]):
                        rows.append((key, k, start, delay, canvas.shape[1], canvas.shape[0], canvas.tobytes(), *[histogram(canvas[:, :, c]).tolist() for c in range(3)], None))
                        start += delay
                except ValueError as e:
                    rows = [(key, None, None, None, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in FRAME_SCHEMA.split(", ")], dtype=object)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInPandas(decoded, FRAME_SCHEMA)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes filled with 255 up to a positive multiple of the frame size."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _slices(values, sizes, most: int = 8 << 20):
    """Runs of rows of about ``most`` bytes."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(values):
        yield slice(start, len(values))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a stored GIF (written to the shared folder)."""

    def stored(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for s in _slices(texts, [len(t or "") for t in texts]):
                raw = [payload(t) for t in texts[s]]
                size = [len((t or "").encode()) for t in texts[s]]
                yield pa.RecordBatch.from_arrays([ids[s], pa.array(size, pa.int64()), pa.array(write_gifs(raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(stored, "doc_id long, n_bytes long, media binary"), compression="zstd")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(stored: DataFrame) -> DataFrame:
    """Reads stored GIFs back: digests of payload and medium, and a feature text of timing and colour histograms."""

    def read(batches):
        for batch in batches:
            ids, size, media = (batch.column(k) for k in range(3))
            media = media.to_pylist()
            for s in _slices(media, [len(m) for m in media]):
                rows = []
                for m, shown in zip(media[s], read_gifs(media[s])):
                    all_ = np.stack([c for c, _ in shown])
                    back = np.ascontiguousarray(all_[..., 0]).tobytes()
                    h = ";".join(f"{name}={','.join(map(str, histogram(all_[..., c])))}" for c, name in enumerate("rgb"))
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"frames={len(shown)};cs={sum(d for _, d in shown)};{h}"))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids[s], size[s], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.mapInArrow(read, DIGEST)
