"""Operator 13: hard negatives by an inverted multi-index with certified windows.

1. Components become whole numbers; a row's score for an anchor is their inner product, exact in float64 while its largest sum
   stays below 2**53 (beyond that it is summed in Python's integers).
2. The vector is cut into two halves. Two codebooks (k-means on at most ``SAMPLE`` rows of a vector length, chosen by hash) give each row a pair of centres: its cell.
3. Rows are dealt into units of at most ``ROWS`` rows: neighbouring cells together, larger cells split by hash; anchors come in
   blocks of at most ``ANCHORS``. A unit and a block meet in one task.
4. In a unit, for each centre, the largest distance of its rows is the radius of that half. An anchor's bound of a half is its
   product with the centre plus its length times the radius; a cell's bound is the sum of two. A heap over the two sorted lists
   (multi-sequence) visits cells by falling bound, until every window is certified: no unvisited cell can hold a row that would
   enter it, equal scores included.
5. First pass: the positives, among the rows of the anchor's label. Second pass: for each positive, the window of scores
   that its negatives may have, among rows of other labels. Every row is indexed and none is skipped without a bound, so the
   result is that of brute force. The first rows of all units are merged by a ranked window.

Cases: rows with a null id, null label, null or empty vector, or any null or non-finite component take no part. Vectors of another length than
the anchor's have no score. A component that 256 times makes infinite counts as non-finite; scores beyond a long become the largest or smallest one.
Ties go to the smaller id. Rows that share an id count each, except as anchors, where the first of an id by label and vector
stands; a row is no positive or negative of an anchor with its id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import settle

SAMPLE, TURNS = 4096, 8
CENTRES = 16  # of a half
ROWS, ANCHORS = 32_768, 2048
STEP = 1024  # rows scored at once


def codebook(x: np.ndarray, k: int = CENTRES, seed: int = 1) -> np.ndarray:
    """Centres of rows by k-means; at most as many as there are different rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(TURNS):
        to = nearest(x, c)
        n = np.bincount(to, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, to, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


class Unit:
    """An inverted multi-index of some rows: lists by cell, centres and radii."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, first: np.ndarray, second: np.ndarray, cells: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((ids, cells[1], cells[0]))  # sorts are stable: rows of an id keep their order
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.half = first.shape[1]
        i, j = cells[0][order], cells[1][order]
        cell, start, size = np.unique(i * len(second) + j, return_index=True, return_counts=True)
        self.lists = {(int(c) // len(second), int(c) % len(second)): (int(s), int(s + n)) for c, s, n in zip(cell, start, size)}
        self.first, self.second = first, second
        self.radii = tuple(self._radius(part, c, at) for part, c, at in ((self.x[:, : self.half], first, i), (self.x[:, self.half :], second, j)))
        self.top = float(np.abs(self.x).max(initial=0))
        self.exact = np.array([[int(v) for v in row] for row in self.x], object) if self.top * self.top * self.x.shape[1] >= 2**53 else None

    @staticmethod
    def _radius(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = np.full(len(c), -1.0)  # no rows
        far = np.sqrt(((x - c[at]) ** 2).sum(axis=1))
        np.maximum.at(r, at, np.where(np.isfinite(far), far, np.inf))
        return r

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the centres with rows and the bounds of their products, falling."""
        out = []
        for part, c, r in ((q[: self.half], self.first, self.radii[0]), (q[self.half :], self.second, self.radii[1])):
            used = np.flatnonzero(r >= 0)
            high = c[used] @ part + np.sqrt(part @ part) * r[used]
            high += 1e-9 * (np.abs(c[used]) @ np.abs(part) + np.sqrt(part @ part) * r[used]) + 1e-6  # rounding
            high = np.where(np.isfinite(high), high, np.inf)  # no bound at all
            order = np.argsort(-high, kind="stable")
            out.append((used[order], high[order]))
        return out

    def visits(self, q: np.ndarray):
        """Places of rows by falling bound of their cells, ``STEP`` rows or more at once: ``(places, bound of all that follow)``."""
        (a, u), (b, v) = self.bounds(q)
        heap, seen, rows, n = ([(-(u[0] + v[0]), 0, 0)] if len(a) and len(b) else []), {(0, 0)}, [], 0
        while heap:
            _, s, t = heapq.heappop(heap)
            span = self.lists.get((int(a[s]), int(b[t])))
            for s2, t2 in ((s + 1, t), (s, t + 1)):
                if s2 < len(a) and t2 < len(b) and (s2, t2) not in seen:
                    seen.add((s2, t2))
                    heapq.heappush(heap, (-(u[s2] + v[t2]), s2, t2))
            if span:
                rows.append(np.arange(*span))
                n += span[1] - span[0]
            if n >= STEP or n and not heap:
                yield np.concatenate(rows), -heap[0][0] if heap else -np.inf
                rows, n = [], 0

    def scores(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact is None and float(np.abs(q).max(initial=0)) * self.top * len(q) < 2**53:
            return self.x[places] @ q
        rows = self.exact[places] if self.exact is not None else np.array([[int(v) for v in row] for row in self.x[places]], object)
        return rows @ np.array([int(v) for v in q], object)


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The first k by falling score, then id."""
    return np.lexsort((ids, -score))[:k]


def positives(unit: Unit, anchor: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the first k other rows of a unit that holds the anchor's label only."""
    ids, score = np.zeros(0, np.int64), np.zeros(0, object if unit.exact is not None else float)
    for places, rest in unit.visits(q):
        own = unit.ids[places]
        other = own != anchor
        ids = np.concatenate([ids, own[other]])
        score = np.concatenate([score, unit.scores(places[other], q)])
        best = _first(ids, score, k)
        ids, score = ids[best], score[best]
        if len(ids) == k and score[-1] > rest:
            break
    return ids, score


def negatives(unit: Unit, anchor: int, label, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window ``(low, high)`` of scores ids and scores of the first k rows of other labels in it."""
    out = [(np.zeros(0, np.int64), np.zeros(0, float)) for _ in windows]
    open_ = [n for n, (low, high) in enumerate(windows) if low <= high]
    for places, rest in unit.visits(q) if open_ else ():
        places = places[(unit.labels[places] != label) & (unit.ids[places] != anchor)]
        score, own = unit.scores(places, q), unit.ids[places]
        for n in open_:
            low, high = windows[n]
            fits = (score >= low) & (score <= high)
            if fits.any():
                ids, s = np.concatenate([out[n][0], own[fits]]), np.concatenate([out[n][1], score[fits]])
                best = _first(ids, s, k)
                out[n] = ids[best], s[best]
        # Certified: nothing that follows reaches the window, or its k-th row.
        open_ = [n for n in open_ if rest >= windows[n][0] and not (len(out[n][0]) == k and out[n][1][-1] > rest)]
        if not open_:
            break
    return out


def window(score: int, low: int = 50, high: int = 95) -> tuple[int, int]:
    """The least and largest whole negative score that a positive score allows: ``low * p <= 100 * n <= high * p``."""
    return -(-low * score // 100), high * score // 100


def sound_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """``vec_id, label, x, dim`` of the rows that take part, components as whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.coalesce(fine, F.lit(False)))
    whole = F.transform("vec", lambda v: F.when(F.abs(v) < 2.0**50, F.floor(v * float(scale)).cast("double")).otherwise(v * float(scale)))  # large doubles are whole
    rows = rows.select("vec_id", "label", whole.alias("x"), F.size("vec").alias("dim"))
    return rows.filter(F.forall("x", lambda v: F.abs(v) < F.lit(float("inf"))))


def celled(rows: DataFrame) -> DataFrame:
    """Rows with the numbers of their two centres and the centres of their vector length."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    hashed = rows.join(sizes, "dim").withColumn("h", F.xxhash64("vec_id", "x"))
    # About twice the sample passes the first test, whatever the number of tasks.
    some = hashed.filter(F.pmod("h", F.lit(1_000_003)) <= F.lit(2 * SAMPLE * 1_000_003.0) / F.col("n"))
    sample = some.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy("h", "vec_id"))).filter(F.col("rank") <= SAMPLE)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("rank")["x"].to_list()).astype(float)
        first, second = codebook(x[:, : x.shape[1] // 2]), codebook(x[:, x.shape[1] // 2 :])
        return pd.DataFrame({"dim": [x.shape[1]], "first": [first.reshape(-1)], "second": [second.reshape(-1)], "n_first": [len(first)]})

    books = settle(sample.groupBy("dim").applyInPandas(fitted, "dim int, first array<double>, second array<double>, n_first int"))  # one row a vector length

    def placed(batches):
        for pdf in batches:
            for _, own in pdf.groupby("dim", sort=False):
                own = own.copy()
                first, second = _books(own)
                x = np.stack(own["x"].to_list()).astype(float)
                half = first.shape[1]
                own["i"], own["j"] = nearest(x[:, :half], first), nearest(x[:, half:], second)
                yield own[["vec_id", "label", "x", "dim", "i", "j"]]

    kinds = dict(rows.dtypes)
    return rows.join(books, "dim").mapInPandas(placed, f"vec_id long, label {kinds['label']}, x array<double>, dim int, i int, j int"), books


def _books(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    r = pdf.iloc[0]
    half = int(r["dim"]) // 2
    first = np.asarray(r["first"], float).reshape(int(r["n_first"]), half)
    second = np.asarray(r["second"], float)
    return first, second.reshape(-1, int(r["dim"]) - half)


def dealt(cells: DataFrame, keys: list[str], size: int = ROWS) -> DataFrame:
    """Rows with the number of their unit within ``keys``: neighbouring cells together, larger ones split by hash."""
    counts = cells.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))  # at most CENTRES**2 rows a key
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1))
    plan = counts.withColumn("gone", F.coalesce(before, F.lit(0))).withColumn("blocks", F.ceil(F.col("n") / size))
    # The number of whole units before the cell; a cell of several blocks gets numbers of its own.
    plan = plan.select(*keys, "i", "j", F.floor(F.col("gone") / size).alias("unit"), "blocks")
    rows = cells.join(plan, [*keys, "i", "j"])
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("vec_id", "x", F.lit(5)), F.col("blocks")) + 1).otherwise(0)
    return rows.withColumn("block", block.cast("long")).drop("blocks")


def _meet(units: DataFrame, anchors: DataFrame, books: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Runs ``work(unit, anchors)`` for each unit of rows and each block of the anchors that share ``keys`` with it."""
    blocks = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("long").alias("n_parts"))
    parted = anchors.join(blocks, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(6)), F.col("n_parts"))).drop("n_parts")
    parts = blocks.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"))
    pairs = settle(units.select(*keys, "unit", "block").distinct().join(parts, keys))  # a row for thousands of rows on either side
    left = units.join(pairs, [*keys, "unit", "block"])
    right = parted.join(pairs, [*keys, "part"]).join(books, "dim")

    def both(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        first, second = _books(asked)
        x = np.stack(rows["x"].to_list()).astype(float)
        return work(Unit(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), x, first, second, (rows["i"].to_numpy(), rows["j"].to_numpy())), asked)

    group = [*keys, "unit", "block", "part"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(both, schema)


def _longs(values) -> np.ndarray:
    """Whole numbers as longs; what no long holds becomes the largest or smallest."""
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in values], np.int64)


def mine(vectors: DataFrame, anchor_every: int = 50, relabel=None, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    ``relabel(id, label)`` gives another label to rows before the search. Anchors are the rows whose id ``anchor_every`` divides.
    """
    rows = sound_rows(vectors, id_col, vec_col, label_col)
    if relabel is not None:
        rows = rows.withColumn("label", relabel(F.col("vec_id"), F.col("label")))
    rows = settle(rows)
    cells, books = celled(rows)
    cells = settle(cells)
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "x"))
    anchors = settle(rows.filter(F.col("vec_id") % anchor_every == 0).withColumn("k", first).filter("k = 1").select("vec_id", "label", "x", "dim"))

    def near(unit: Unit, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in asked.itertuples():
            ids, score = positives(unit, r.vec_id, np.asarray(r.x, float), n_positives)
            out.append(pd.DataFrame({"vec_id": r.vec_id, "positive_id": ids, "positive_score": _longs(score)}))
        return pd.concat(out)

    found = _meet(dealt(cells, ["dim", "label"]), anchors, books, ["dim", "label"], near, "vec_id long, positive_id long, positive_score long")
    order = Window.partitionBy("vec_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = found.withColumn("positive_rank", F.row_number().over(order)).filter(F.col("positive_rank") <= n_positives)
    listed = chosen.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives"))  # n_positives at most
    asked = settle(anchors.join(listed, "vec_id"))

    def hard(unit: Unit, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in asked.itertuples():
            windows = [window(int(p["positive_score"]), low, high) for p in r.positives]
            for p, (ids, score) in zip(r.positives, negatives(unit, r.vec_id, r.label, np.asarray(r.x, float), windows, n_negatives)):
                out.append(pd.DataFrame({"anchor_id": r.vec_id, "positive_id": p["positive_id"], "positive_score": p["positive_score"], "positive_rank": p["positive_rank"], "negative_id": ids, "negative_score": _longs(score)}))
        return pd.concat(out)

    found = _meet(dealt(cells, ["dim"]), asked, books, ["dim"], hard, "anchor_id long, positive_id long, positive_score long, positive_rank int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
