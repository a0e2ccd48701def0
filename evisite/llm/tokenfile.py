"""Operator 3: token ids in patched frame-of-reference files.

A file part is a run of documents in ascending id order. It is stored as segments; a segment is a byte string:

    "PFR1", block length, documents, ids, blocks (little-endian unsigned 32/64 bit, see HEAD)
    per document: id (int64), null flag (uint8), number of ids (uint32)
    per block: start of its payload (uint64), minimum (uint32), width (uint8), exceptions (uint16)
    payload of a block: differences to the minimum packed at ``width`` bits, then exceptions as
    positions (uint16) and full differences (uint32)

The width is that which the given percentile of a block's differences fits; larger differences are exceptions. The
last block is filled up with its minimum. Blocks can be read alone through their starts.

Segments are written as rows (part, segment, ids, documents, bytes) by Spark's own committer, so a lost executor or a
repeated task leaves no half-written or double file, on any store that Spark can write.

Cases: a null text is empty and holds the end id only. Null ids come first. Rows with one id are ordered by a hash of their text, then by it.
An empty table gives no segment. Very long texts make a longer segment. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import settle
from evisite.llm.tokens import encoder

HEAD = struct.Struct("<4sIIQI")
MAGIC = b"PFR1"
BLOCK = 256
SEGMENT_IDS = 1 << 20
FILE_SCHEMA = "part int, segment int, first long, n_docs long, n_ids long, body binary"


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned number needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9, block: int = BLOCK) -> tuple[bytes, bytes]:
    """Block index and payload of a run of unsigned 32-bit ids."""
    n = -(-len(ids) // block)
    grid = np.full(n * block, ids[-1] if len(ids) else 0, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, block)
    low = grid.min(axis=1) if n else np.zeros(0, np.uint32)
    if len(ids) % block:
        grid[-1, len(ids) % block :] = grid[-1, : len(ids) % block].min()
        low[-1] = grid[-1].min()
    rest = grid - low[:, None]
    bits = bit_lengths(rest)
    width = np.sort(bits, axis=1)[:, min(block - 1, int(percentile * block))] if n else np.zeros(0, np.uint8)
    out = bits > width[:, None]
    spare = out.sum(axis=1)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        kept = np.where(out[of], 0, rest[of]).astype("<u4")
        raw = np.unpackbits(kept.view(np.uint8).reshape(len(of), block, 4), axis=2, bitorder="little")[:, :, :w]
        rows = np.packbits(raw.reshape(len(of), block * int(w)), axis=1, bitorder="little")
        for k, row in zip(of, rows):
            packed[k] = row.tobytes()
    at = np.concatenate([[0], np.cumsum(spare)])
    place, value = np.nonzero(out)[1].astype("<u2"), rest[out].astype("<u4")
    parts, starts, size = [], np.zeros(n, "<u8"), 0
    for k in range(n):
        starts[k] = size
        p = packed[k]
        if spare[k]:
            p += place[at[k] : at[k + 1]].tobytes() + value[at[k] : at[k + 1]].tobytes()
        parts.append(p)
        size += len(p)
    index = starts.tobytes() + low.astype("<u4").tobytes() + width.tobytes() + spare.astype("<u2").tobytes()
    return index, b"".join(parts)


def unpack_blocks(index: bytes, payload: bytes, n_ids: int, n_blocks: int, block: int = BLOCK) -> np.ndarray:
    """The ids that ``pack_blocks`` stored."""
    starts = np.frombuffer(index, "<u8", n_blocks)
    low = np.frombuffer(index, "<u4", n_blocks, 8 * n_blocks)
    width = np.frombuffer(index, np.uint8, n_blocks, 12 * n_blocks)
    spare = np.frombuffer(index, "<u2", n_blocks, 13 * n_blocks)
    data = np.frombuffer(payload, np.uint8)
    grid = np.zeros((n_blocks, block), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        of, size = np.flatnonzero(width == w), block * int(w) // 8
        rows = data[starts[of].astype(np.int64)[:, None] + np.arange(size)]
        bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(of), block, int(w))
        room = np.zeros((len(of), block, 16 if w <= 16 else 32), np.uint8)
        room[:, :, : int(w)] = bits
        grid[of] = np.packbits(room, axis=2, bitorder="little").reshape(len(of), -1).view("<u2" if w <= 16 else "<u4")
    for k in np.flatnonzero(spare):
        at, m = int(starts[k]) + block * int(width[k]) // 8, int(spare[k])
        place = np.frombuffer(payload, "<u2", m, at)
        grid[k, place] = np.frombuffer(payload, "<u4", m, at + 2 * m)
    return (grid + low[:, None]).reshape(-1)[:n_ids]


def write_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> bytes:
    index, payload = pack_blocks(ids, percentile)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), -(-len(ids) // BLOCK))
    return b"".join([head, keys.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), index, payload])


def read_segment(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a segment."""
    magic, block, n_docs, n_ids, n_blocks = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEAD.size
    keys = np.frombuffer(body, "<i8", n_docs, at).tolist()
    null = np.frombuffer(body, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(body, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    index = body[at : at + 15 * n_blocks]
    ids = unpack_blocks(index, body[at + 15 * n_blocks :], n_ids, n_blocks, block)
    return [None if z else k for k, z in zip(keys, null)], counts, ids


def read_block(body: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` of a segment alone: its index entry leads to its bytes, no other block is unpacked."""
    _, block, n_docs, n_ids, n_blocks = HEAD.unpack_from(body)
    at = HEAD.size + 13 * n_docs
    start = int.from_bytes(body[at + 8 * k : at + 8 * k + 8], "little")
    low = body[at + 8 * n_blocks + 4 * k :][:4]
    width = body[at + 12 * n_blocks + k]
    spare = body[at + 13 * n_blocks + 2 * k :][:2]
    start += at + 15 * n_blocks
    payload = body[start : start + block * width // 8 + 6 * int.from_bytes(spare, "little")]
    return unpack_blocks(bytes(8) + low + bytes([width]) + spare, payload, min(block, n_ids - block * k), 1, block)


def write_files(docs: DataFrame, vocabulary: str, lower: bool = True, end_id: int = 1, percentile: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes their segments in ascending id order; returns the table of segments."""

    def encoded(batches):
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        keys, counts, flats, held = [], [], [], 0

        def flush():
            nonlocal segment, first, keys, counts, flats, held
            n, ids = np.concatenate(counts), np.concatenate(flats)
            body = write_segment(keys, n, ids, percentile)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first]), pa.array([len(keys)]), pa.array([len(ids)]), pa.array([body], pa.binary())],
                names=["part", "segment", "first", "n_docs", "n_ids", "body"],
            )
            segment, first = segment + 1, first + len(ids)
            keys, counts, flats, held = [], [], [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                flat, n = encoder(vocabulary, lower).encode(some.column(1))
                flat = np.insert(flat, np.cumsum(n), end_id)
                n = n + 1
                keys += some.column(0).to_pylist()
                counts.append(n)
                flats.append(flat)
                held += len(flat)
                if held >= SEGMENT_IDS:
                    yield flush()
        if keys:
            yield flush()

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = text.withColumn("h", F.xxhash64("text"))  # rows without an id, or with one id, may be many: they split by it
    ordered = hashed.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    return settle(ordered.mapInArrow(encoded, FILE_SCHEMA), compression="none")


def read_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the segments."""
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # one row a file part: as many as tasks wrote

    def decoded(batches):
        for batch in batches:
            for body, start in zip(batch.column(0), batch.column(1)):
                keys, counts, ids = read_segment(body.as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start.as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(base), "part").select("body", (F.col("first") + F.col("base")).alias("start"))
    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")
