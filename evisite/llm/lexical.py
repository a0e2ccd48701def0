"""Operator 12: ranked lexical search by dense blocked matrix products.

1. Every document is cut into terms once and kept as a compact row: its number of terms, and the numbers and counts of those
   terms that items hold. The rows are written to the shared folder; all later passes read them, not the texts.
2. The number of documents N, of terms L, and each term's number of documents are summed over all rows. A term's weight and a
   document's impact of a term are whole numbers.
3. Items are dealt into tiles, each with a compact vocabulary of its own. In each task, tiles of document impacts are multiplied
   with tiles of item weights by BLAS in float64. A product sums at most ``WIDTH`` terms, or fewer, so that the sum of their
   largest values stays below 2**53: every partial sum is exact; products of further terms are added as 64-bit integers.
4. A task keeps, of each item, all scores that reach its k-th best so far, ties included, and in the end its first k by
   score, then id. The first k of all tasks are found in two steps, so that no item's rows meet in one task at once.

What is broadcast holds the items of one group: at most ``GROUP_ITEMS`` items and about ``GROUP_BYTES`` bytes of text (checked by
a sum); more items are searched in further groups, each one pass over the documents.

Cases: null and empty texts have no terms and are counted nowhere. Items without terms, or whose terms no document holds, get no
rows. Rows of documents or items that share an id each count. A null document id comes last among equal scores. Empty tables
give empty results. Extra columns are ignored. Whole texts are searched.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import byte_slices, settle

TILE_ITEMS, TILE_DOCS, WIDTH = 256, 512, 4096
GROUP_ITEMS, GROUP_BYTES = 20_000, 8_000_000
POSTINGS = 2_000_000  # terms of documents unfolded at once
IMPACT = 10**6  # above every impact

#: Letters A-Z to lower case; other ASCII characters that are no digit or letter part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeats kept."""
    return text.translate(_FOLD).split()


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks)


def _lists(values: list, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values, pa.int32()))


def compact(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` of every document with a term: its number of terms, and the vocabulary's terms with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        known = shared.value.get
        for batch in batches:
            for some in byte_slices(batch, 1):
                keep, ns, ids, tfs, sizes = [], [], [], [], []
                for row, text in enumerate(_bytes(some.column(1))):
                    found = terms(text)
                    if not found:
                        continue
                    own = [(t, tf) for w, tf in Counter(found).items() if (t := known(w)) is not None]
                    keep.append(row)
                    ns.append(len(found))
                    ids += [t for t, _ in own]
                    tfs += [tf for _, tf in own]
                    sizes.append(len(own))
                doc_ids = some.column(0).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ns, pa.int64()), _lists(ids, sizes), _lists(tfs, sizes)], names=["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(counted, "doc_id long, n long, term array<int>, tf array<int>")


def _document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Of each term the number of documents: counted within the tasks, one row a term and task."""

    def counted(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["t", "df"])

    df = np.zeros(size, np.int64)
    for r in rows.select("term").mapInArrow(counted, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # bounded by the vocabulary of a group
        df[r.t] = r.df
    return df


def tiles(items: list[list[int]], weight: np.ndarray) -> list[tuple]:
    """Tiles of items ``(first item, number of items, vocabulary, row, column)``; the last two place the weights."""
    out = []
    for at in range(0, len(items), TILE_ITEMS):
        own = [[t for t in item if weight[t] > 0] for item in items[at : at + TILE_ITEMS]]
        words = np.unique(np.array([t for item in own for t in item], np.int64))
        if len(words):
            rows = np.searchsorted(words, np.array([t for item in own for t in item], np.int64))
            out.append((at, len(own), words, rows, np.repeat(np.arange(len(own)), [len(item) for item in own])))
    return out


def width(weight: np.ndarray) -> int:
    """How many terms may be summed in float64 with every partial sum exact."""
    top = max(1, int(weight.max(initial=0)))
    return max(1, min(WIDTH, (2**53 - 1) // (top * IMPACT)))


def scores(batch: tuple, tile: tuple, weight: np.ndarray) -> np.ndarray:
    """Exact scores of documents ``(starts, terms, impacts)`` for the items of a tile, int64[documents, items]."""
    starts, term, impact = batch
    _, n_items, words, rows, cols = tile
    n_docs = len(starts) - 1
    place = np.searchsorted(words, term)
    place[place == len(words)] = 0
    hit = words[place] == term
    doc = np.repeat(np.arange(n_docs), np.diff(starts))[hit]
    place, value = place[hit], impact[hit]
    total, step = np.zeros((n_docs, n_items), np.int64), width(weight[words])
    for low in range(0, len(words), step):
        w = min(step, len(words) - low)
        left, right = np.zeros((n_docs, w)), np.zeros((w, n_items))
        own, theirs = (place >= low) & (place < low + w), (rows >= low) & (rows < low + w)
        left[doc[own], place[own] - low] = value[own]
        right[rows[theirs] - low, cols[theirs]] = weight[words[rows[theirs]]]
        total += (left @ right).astype(np.int64)
    return total


class Best:
    """The first k documents of each item by score, then id (nulls last), kept while tiles of scores come in."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)  # a score of 0 is none
        self.rows, self.loose = np.zeros((4, 0), np.int64), []  # item, score, null id, id
        self.n_loose = 0

    def add(self, first: int, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        r, i = np.nonzero(score >= self.least[first : first + score.shape[1]])
        self.loose.append(np.stack([i + first, score[r, i], no_id[r], ids[r]]))
        self.n_loose += len(r)
        if self.n_loose > max(200_000, 2 * self.rows.shape[1]):
            self.settle()

    def settle(self) -> np.ndarray:
        both = np.concatenate([self.rows, *self.loose], axis=1)
        both = both[:, np.lexsort((both[3], both[2], -both[1], both[0]))]
        at = np.arange(both.shape[1])
        new = np.ones(both.shape[1], bool)
        new[1:] = both[0, 1:] != both[0, :-1]
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        full = place == self.k - 1
        self.least[both[0, full]] = both[1, full]
        self.rows, self.loose, self.n_loose = both[:, place < self.k], [], 0
        return self.rows


def _search(rows: DataFrame, ids: pa.Array, copies: pa.Array, items: list[list[int]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, item_type: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, copies, tiles(items, weight), weight))

    def found(batches):
        names, copies, tiled, weight = shared.value
        best = Best(len(names), k)
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:], dtype=np.int64), POSTINGS, "right")))
                part = batch.slice(at, to - at)
                starts = np.concatenate([[0], np.cumsum(size[at:to], dtype=np.int64)])
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                m = np.array([50 + 50 * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                impact = (10**9 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(starts)))
                no_id = part.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc_id = part.column(0).fill_null(0).to_numpy()
                for tile in tiled:
                    for low in range(0, part.num_rows, TILE_DOCS):
                        high = min(low + TILE_DOCS, part.num_rows)
                        a, b = starts[low], starts[high]
                        score = scores((starts[low : high + 1] - a, term[a:b], impact[a:b]), tile, weight)
                        best.add(tile[0], score, no_id[low:high], doc_id[low:high])
                at = to
        item, score, no_id, doc_id = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), names.take(pa.array(item)), pa.array(doc_id, mask=no_id > 0), pa.array(score), copies.take(pa.array(item))], names=["item_no", "item_id", "doc_id", "score", "copies"])

    return rows.mapInArrow(found, f"item_no long, item_id {item_type}, doc_id long, score long, copies long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, scores above 0 only."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null")
    asked = asked.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))  # repeated items are searched once
    item_type = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    groups = max(-(-size.n // GROUP_ITEMS), -(-(size.b or 0) // GROUP_BYTES), 1)
    parts = []
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).toArrow()  # about GROUP_BYTES
        words = [list(dict.fromkeys(terms(t))) for t in _bytes(_whole(own.column("text")))]
        vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for item in words for w in item))}
        if not vocabulary:
            continue
        rows = settle(compact(texts, vocabulary))
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not total.n:
            continue
        df = _document_counts(rows, len(vocabulary))
        weight = np.floor(1000 * np.log((2 * total.n + 2) / (2 * df + 1))).astype(np.int64)
        ids, copies = (_whole(own.column(c)) for c in ("item_id", "copies"))
        parts.append(_search(rows, ids, copies, [[vocabulary[w] for w in item] for item in words], weight, total.n, total.l, k, item_type).withColumn("group", F.lit(g)))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = reduce(DataFrame.unionByName, parts).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("group", "item_no", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("group", "item_no").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
