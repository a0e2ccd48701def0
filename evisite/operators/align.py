"""Alignment as batch jobs: distinct pairs, Arrow batches of dynamic programming, and positions from gapped rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisite.dims import COUNTED
from evisite.tables import bounded_batches, tidy

NEVER = -(2**28)


def read_matrix(spark: SparkSession, path: str) -> dict[str, int]:
    """A substitution matrix in the usual text layout (letters as head row and first column): pair to score."""
    rows = [r.value.split() for r in spark.read.text(path).collect() if r.value.strip() and not r.value.startswith("#")]  # about 25 rows
    head = rows[0]
    return {a[0] + b: int(v) for a in rows[1:] for b, v in zip(head, a[1:])}


def simple_matrix(match: int = 4, mismatch: int = -2, letters: str = COUNTED) -> dict[str, int]:
    return {a + b: match if a == b else mismatch for a in letters for b in letters}


def _lookup(matrix: dict[str, int]) -> np.ndarray:
    table = np.full((128, 128), min(matrix.values()), np.int32)
    for pair, v in matrix.items():
        table[ord(pair[0]), ord(pair[1])] = v
    return table


CELLS = 500_000  # target letters stepped together
KEPT = 1_500_000  # score cells kept at once for a traceback; more are made again from every few rows
_PAD = 128  # a letter beyond a text; it matches nothing


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, 88).astype(np.int32)


class _Steps:
    """Score rows of local alignments, one query letter after another, of several pairs at once.

    A row is made along the whole target at once: a gap in the query is a running maximum. ``best`` is the score of an
    alignment that ends at a cell, ``up`` and ``left`` of one that ends in a gap of the target or the query.
    """

    def __init__(self, table: np.ndarray, gap_open: int, gap_extend: int):
        self.wide = np.full((128, 129), NEVER, np.int32)
        self.wide[:, :128] = table
        self.open, self.gap = gap_open, gap_extend
        self.extend = max(gap_open, gap_extend)  # opening anew may be cheaper than extending

    def start(self, pairs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((pairs, n + 1), np.int32), np.full((pairs, n + 1), NEVER, np.int32)

    def step(self, best: np.ndarray, up: np.ndarray, letter: np.ndarray, t: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up = np.maximum(best + self.open, up + self.gap)
        up[:, 0] = NEVER
        here = np.zeros_like(best)
        np.maximum(best[:, :-1] + self.wide.ravel()[(letter * 129)[:, None] + t], up[:, 1:], out=here[:, 1:])
        np.maximum(here, 0, out=here)
        left = np.full_like(best, NEVER)
        left[:, 1:] = np.maximum.accumulate(here - slope, axis=1)[:, :-1] + slope[:-1] + self.open
        return np.maximum(here, left), up, left

    def slope(self, n: int) -> np.ndarray:
        return self.extend * np.arange(n + 1, dtype=np.int32)

    def ends(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair the best score and where it ends: in the target first, then in the query; memory of a few rows."""
        (best, up), slope, pair = self.start(*t.shape), self.slope(t.shape[1]), np.arange(len(t))
        top, at_j, at_i = (np.zeros(len(t), np.int64) for _ in range(3))
        for i in range(1, q.shape[1] + 1):
            best, up, _ = self.step(best, up, q[:, i - 1], t, slope)
            j = best.argmax(axis=1)
            b = best[pair, j]
            better = (b > 0) & ((b > top) | (b == top) & ((j < at_j) | (j == at_j) & (i < at_i)))
            top[better], at_j[better], at_i[better] = b[better], j[better], i
        return top, at_j, at_i

    def span(self, j: int, n_query: int) -> int:
        """How far before its end in the target an alignment of a positive score can begin."""
        return j if self.extend >= 0 else min(j, 2 * n_query + 2 + n_query * max(0, int(self.wide[:, :128].max())) // -self.extend)


class _Kept:
    """All score rows of several pairs."""

    def __init__(self, steps: _Steps, q: np.ndarray, t: np.ndarray):
        best, up = steps.start(*t.shape)
        slope, self.rows = steps.slope(t.shape[1]), [(best, up, up)]
        for i in range(q.shape[1]):
            self.rows.append(steps.step(*self.rows[-1][:2], q[:, i], t, slope))

    def at(self, i: int, k: int, pair: int):
        """Rows i and i - 1 of a pair."""
        return tuple(r[pair] for r in self.rows[i]), self.rows[i - 1][0][pair]


class _Remade:
    """Score rows of one pair of long texts: every ``every``-th row is kept, the rows between are made again when they are wanted,
    no further along the target than the traceback has come. Two texts of n letters take memory of about 6 n sqrt(n) scores."""

    def __init__(self, steps: _Steps, q: np.ndarray, t: np.ndarray):
        self.steps, self.q, self.t = steps, q, t
        self.every = max(2, round((2 * q.shape[1] / 3) ** 0.5))
        (best, up), slope, self.marks = steps.start(*t.shape), steps.slope(t.shape[1]), []
        for i in range(q.shape[1]):
            if i % self.every == 0:
                self.marks.append((best, up))
            best, up, _ = steps.step(best, up, q[:, i], t, slope)
        self.block, self.rows = -1, []

    def at(self, i: int, k: int, pair: int):
        block = (i - 1) // self.every
        if block != self.block:
            best, up = (row[:, : k + 1] for row in self.marks[block])
            self.block, self.rows = block, [(best, up, up)]
            del self.marks[block + 1 :]
            slope = self.steps.slope(k)
            for letter in range(block * self.every, min(i, (block + 1) * self.every)):
                self.rows.append(self.steps.step(*self.rows[-1][:2], self.q[:, letter], self.t[:, :k], slope))
        i -= block * self.every
        return tuple(r[0] for r in self.rows[i]), self.rows[i - 1][0][0]


def _trace(rows: _Kept | _Remade, pair: int, steps: _Steps, query: str, target: str, end_i: int, end_j: int, k: int) -> tuple[str, str]:
    """The gapped rows of the alignment that ends at query letter ``end_i`` and target letter ``end_j``, column ``k`` of the score rows."""
    q, t = _letters(query[:end_i]), _letters(target[end_j - min(k, end_j) : end_j])
    lead = k - len(t)  # columns before the target
    top, low, i, state = [], [], end_i, "m"
    while i > 0 and k > lead:
        (best, up, left), before = rows.at(i, k, pair)
        if state == "m" and best[k] == 0:
            break
        if state == "m":
            if best[k] == before[k - 1] + steps.wide[q[i - 1], t[k - lead - 1]]:
                i, k = i - 1, k - 1
                top.append(target[end_j - len(t) + k - lead])
                low.append(query[i])
                continue
            state = "u" if best[k] == up[k] else "l"
        if state == "u":
            state = "m" if up[k] == before[k] + steps.open else "u"
            i -= 1
            top.append("-")
            low.append(query[i])
        else:
            state = "m" if left[k] == best[k - 1] + steps.open else "l"
            k -= 1
            top.append(target[end_j - len(t) + k - lead])
            low.append("-")
    j = end_j - len(t) + k - lead
    top_row = target[:j] + "-" * i + "".join(top[::-1]) + "-" * (len(query) - end_i) + target[end_j:]
    low_row = "-" * j + query[:i] + "".join(low[::-1]) + query[end_i:] + "-" * (len(target) - end_j)
    return top_row, low_row


def _padded(texts: list[np.ndarray], front: bool = False) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), _PAD, np.int32)
    for row, x in zip(out, texts):
        row[len(row) - len(x) if front else 0 :][: len(x)] = x
    return out


def align_batch(queries: list[str], targets: list[str], table: np.ndarray, gap_open: int, gap_extend: int) -> list[tuple[int, str, str]]:
    """Best local alignment of each pair with free ends: (score, gapped target, gapped query).

    Affine gaps. Of equal scores the one that ends first in the target, then in the query, is taken; letters outside it
    stand against gaps. Texts may be of any length: pairs of like length are stepped together, whole targets in memory of
    a few rows. What lies before the end of the best alignment is scored again for the traceback, as far back as an alignment of
    a positive score can reach, all rows at once where they are few, else block by block.
    """
    steps, out = _Steps(table, gap_open, gap_extend), [None] * len(queries)
    order = sorted(range(len(queries)), key=lambda k: (len(queries[k]), len(targets[k])))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(queries[order[to]]) == len(queries[order[at]]) and (to + 1 - at) * len(targets[order[to]]) <= CELLS:
            to += 1
        some = order[at:to]
        at = to
        q = _padded([_letters(queries[k]) for k in some])
        score, j, i = steps.ends(q, _padded([_letters(targets[k]) for k in some]))
        spans = [steps.span(int(b), q.shape[1]) for b in j]
        small = [n for n in range(len(some)) if (q.shape[1] + 1) * (spans[n] + 1) * 3 <= KEPT]
        while small:
            n_columns, part = 0, []
            while small and (not part or (len(part) + 1) * 3 * (q.shape[1] + 1) * (max(n_columns, spans[small[-1]]) + 1) <= KEPT):
                part.append(small.pop())
                n_columns = max(n_columns, spans[part[-1]])
            tails = _padded([_letters(targets[some[n]][j[n] - spans[n] : j[n]]) for n in part], front=True)
            rows = _Kept(steps, q[part], tails)
            for pair, n in enumerate(part):
                out[some[n]] = (int(score[n]), *_trace(rows, pair, steps, queries[some[n]], targets[some[n]], int(i[n]), int(j[n]), tails.shape[1]))
        for n in range(len(some)):
            if out[some[n]] is None:
                query, target = queries[some[n]], targets[some[n]]
                rows = _Remade(steps, q[n : n + 1, : i[n]], _letters(target[j[n] - spans[n] : j[n]])[None])
                out[some[n]] = (int(score[n]), *_trace(rows, 0, steps, query, target, int(i[n]), int(j[n]), spans[n]))
    return out


def align_pairs(pairs: DataFrame, query: str, target: str, matrix: dict[str, int] | None = None, gap_open: int = -10, gap_extend: int = -2, batch: int = 2048, letters: int = 1_000_000, measures: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """``pairs`` with ``score, target_row, query_row``; each distinct (query, target) is aligned once.

    A batch ends at ``batch`` pairs or ``letters`` target letters, however many rows Spark hands over. ``measures``: columns
    computed of (target row, query row), which then take the place of the rows, so that long rows are not shuffled.
    """
    bounded_batches(pairs.sparkSession)
    table = _lookup(matrix or simple_matrix())

    def aligned(batches):
        for some in batches:
            ends, at = np.cumsum(pc.utf8_length(some.column(2)).to_numpy(), dtype=np.int64), 0
            while at < some.num_rows:
                to = min(at + batch, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right"))))
                keys, a, b = some.slice(at, to - at).columns
                rows = align_batch(a.to_pylist(), b.to_pylist(), table, gap_open, gap_extend)
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["key_", "score", "target_row", "query_row"])
                at = to

    key = F.unhex(F.sha2(F.encode(F.concat(F.length(query).cast("string"), F.lit("/"), query, target), "utf-8"), 256))
    keyed = pairs.filter(F.col(query).isNotNull() & F.col(target).isNotNull()).withColumn("key_", key)
    distinct = keyed.select("key_", F.col(query).alias("q_"), F.col(target).alias("t_")).dropDuplicates(["key_"])
    done = distinct.mapInArrow(tidy(aligned), "key_ binary, score int, target_row string, query_row string")
    if measures is not None:
        done = done.select("key_", "score", *[f(F.col("target_row"), F.col("query_row")).alias(name) for name, f in measures.items()])
    return keyed.join(done, "key_").drop("key_")


def gapless(query: Column, target: Column, match: int = 4, mismatch: int = -2) -> Column:
    """struct(score, offset) of the best placing of the whole query in the target without gaps; ties: first offset."""
    spare = F.length(target) - F.length(query)
    letters = F.split(query, "")

    def at(k: Column) -> Column:
        part = F.split(F.substring(target, k + 1, F.length(query)), "")
        return F.aggregate(F.zip_with(letters, part, lambda a, b: F.when(a == "", 0).when(a == b, match).otherwise(mismatch)), F.lit(0), lambda s, x: s + x)

    tried = F.transform(F.when(spare >= 0, F.sequence(F.lit(0), spare)), lambda k: F.struct(at(k).alias("score"), (-k).alias("neg")))
    best = F.array_max(tried)
    return F.struct(best["score"].alias("score"), (-best["neg"]).alias("offset"))


def gapless_whole(df: DataFrame, key: str, query: str, target: str, match: int = 4, mismatch: int = -2) -> DataFrame:
    """``key, score, offset`` as by ``gapless``, with targets of any length: all offsets of a text are scored at once.

    A query longer than its target, and null texts, have null score and offset; an empty query scores 0 at offset 0.
    """

    def placed(batches):
        for some in batches:
            out = [best_place(q, t, match, mismatch) for q, t in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32())], names=[key, "score", "offset"])

    bounded_batches(df.sparkSession)
    return df.select(key, query, target).mapInArrow(tidy(placed), f"`{key}` {dict(df.dtypes)[key]}, score int, offset int")


def best_place(query: str | None, target: str | None, match: int, mismatch: int) -> tuple[int | None, int | None]:
    if query is None or target is None or len(query) > len(target):
        return None, None
    q, t = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (query, target))
    n = len(t) - len(q) + 1
    same = np.zeros(n, np.int32)
    for k, c in enumerate(q):
        same += t[k : k + n] == c
    at = int((same if match >= mismatch else -same).argmax())
    return int(same[at]) * match + (len(q) - int(same[at])) * mismatch, at


def site_in_target(target_row: Column, query_row: Column, place: Column, positions: int = 0) -> Column:
    """struct(position, letter, context) of a site in the target: ``place`` is its letter's number in the query.

    ``position`` counts target letters before the site's column; a gap at the site (or after it, for a site between two
    residues) gives null. ``context`` is five target letters up to the site, a mark, five after it.
    """
    n = F.length(query_row)
    is_letter = lambda row, k: F.substring(row, k, F.lit(1)).rlike(f"[{COUNTED}]")
    columns = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: is_letter(query_row, k))
    col = F.try_element_at(columns, place)
    before = F.length(F.regexp_replace(F.substring(target_row, F.lit(1), col - 1), f"[^{COUNTED}]", ""))
    letter = F.upper(F.substring(target_row, col, F.lit(1)))
    gap = (letter == "-") | (letter == "")
    if positions == 0:
        after = F.substring(target_row, col + 1, F.lit(1))
        gap = gap | (after == "-") | (after == "")
    left = F.lpad(F.substring(target_row, F.greatest(col - 4, F.lit(1)), F.least(col, F.lit(5))), 5, "-")
    right = F.rpad(F.substring(target_row, col + 1, F.lit(5)), 5, "-")
    return F.when(~gap, F.struct(before.alias("position"), letter.alias("letter"), F.upper(F.concat(left, F.lit("*"), right)).alias("context")))


def surroundings(row: Column, column: Column, n: int = 5) -> Column:
    """``n`` letters before and after a column of a gapped row, gaps skipped, padded."""
    left = F.regexp_replace(F.substring(row, F.lit(1), column), "-", "")
    right = F.regexp_replace(F.substring(row, column + 1, F.length(row)), "-", "")
    return F.concat(F.lpad(F.substring(left, F.greatest(F.length(left) - n + 1, F.lit(1)), F.lit(n)), n, "-"), F.lit("*"), F.rpad(F.substring(right, F.lit(1), F.lit(n)), n, "-"))
