"""Operator 8: sum-of-squares online packing of documents into fixed-length sequences.

A document longer than a sequence fills whole sequences first; what remains is placed online. A level array counts the
open sequences at each fill; a remainder goes to the fill (or a new sequence) that leaves the sum of squared counts
least, ties to the fuller one. Each input partition is packed on its own in one pass, without a shuffle, and its
open sequences are merged at its end by cutting the emptiest into the fullest, so a partition pads one sequence at
most. Sequence ids hold the partition number in their upper bits and are the same when a task runs again.

Memory of a task: one batch, and the ids of the open sequences.

Cases: a null or empty text is a document of the end id alone. Repeated rows are packed each. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisite.llm.common import tidy
from evisite.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
STEP_ROWS = 1000


class Packer:
    """Sum-of-squares packer; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int = 0):
        self.capacity, self.next_id = capacity, first_id
        self.counts = np.zeros(capacity + 1, np.int64)  # open sequences at each fill; at capacity always 0
        self.open: dict[int, list[tuple[int, list]]] = {}
        self.rows: list[tuple] = []

    def _close(self, seq: int, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, offset))
            offset += len(ids)

    def level_for(self, size: int) -> int:
        """The fill to place ``size`` ids at; 0: a new sequence."""
        after = self.counts[size:].copy()  # counts at fill h + size, for h = 0 ..
        cost = 2 * after + 2 - 2 * self.counts[: len(after)]
        cost[-1] = 1 - 2 * self.counts[self.capacity - size]  # a full sequence counts no more
        allowed = self.counts[: len(after)] > 0
        allowed[0] = True
        cost[0] = 2 * self.counts[size] + 1 if size < self.capacity else 0
        cost = np.where(allowed, cost, np.iinfo(np.int64).max)
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._close(self.next_id, [(doc, at, ids[at : at + self.capacity], total)])
            self.next_id += 1
            at += self.capacity
        if at == total:
            return
        size = total - at
        level = self.level_for(size)
        if level:
            seq, pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            seq, pieces = self.next_id, []
            self.next_id += 1
        pieces.append((doc, at, ids[at:], total))
        if level + size == self.capacity:
            self._close(seq, pieces)
        else:
            self.open.setdefault(level + size, []).append((seq, pieces))
            self.counts[level + size] += 1

    def finish(self) -> None:
        """Cuts the emptiest open sequences into the gaps of the fullest."""
        left = [(fill, seq, pieces) for fill in sorted(self.open) for seq, pieces in self.open[fill]]
        low = 0
        while low < len(left):
            fill, seq, pieces = left.pop()
            while fill < self.capacity and low < len(left):
                have, other, donor = left[low]
                doc, start, ids, total = donor.pop()
                n = min(self.capacity - fill, len(ids))
                if n < len(ids):
                    donor.append((doc, start, ids[:-n], total))
                pieces.append((doc, start + len(ids) - n, ids[len(ids) - n :], total))
                fill, left[low] = fill + n, (have - n, other, donor)
                if not donor:
                    low += 1
            self._close(seq, pieces)
        self.open, self.counts[:] = {}, 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=NAMES)


def pack(docs: DataFrame, vocabulary: str, lower: bool = False, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""

    def packed(batches):
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                some = batch.slice(at, STEP_ROWS)
                flat, counts = encoder(vocabulary, lower).encode(some.column(1))
                flat = np.insert(flat, np.cumsum(counts), end_id)
                ends = np.cumsum(counts + 1)
                for doc, a, b in zip(some.column(0).to_pylist(), ends - counts - 1, ends):
                    packer.add(doc, flat[a:b].copy())
                if len(packer.rows) > 20_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(packed), SCHEMA)
