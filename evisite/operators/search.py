"""Hit search: an index of words, seeds on diagonals, ungapped extension and scores with their statistics.

Both sides become tables of words (``word, id, place``). What the queries hold is first marked in a bit table of fixed size, so
that of the targets only words that may match are written out; that table of postings is hash-partitioned by word in the join.
A word with many rows on either side is split there by salt on both sides. Nothing passes the driver but the bit table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisite.operators.pairs import first_of, rank_hits, top_k
from evisite.tables import settled

CHUNK = 1_000_000  # letters hashed at once
BITS = 24  # of a word's hash that the bit table holds: 2 MB
HOT = 10_000  # rows of a word that one task joins, on either side


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every whole k-letter word its hash, its text's number and its place there."""
    codes, sizes = _codes("".join(texts)), np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(codes) - k + 1)
    first = np.flatnonzero(of[:n] == of[k - 1 :][:n]) if n else np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9))[first], of[first], first - (np.cumsum(sizes) - sizes)[of[first]]


def _slices(texts: list[str]):
    """Ranges of texts of about ``CHUNK`` letters."""
    at = 0
    while at < len(texts):
        to, total = at + 1, len(texts[at])
        while to < len(texts) and total + len(texts[to]) <= CHUNK:
            total += len(texts[to])
            to += 1
        yield at, to
        at = to


def marked_words(df: DataFrame, seq: str, k: int) -> np.ndarray:
    """A bit for each value of the first ``BITS`` bits of a word's hash: whether a text of ``df`` has such a word."""

    def marked(batches):
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts):
                seen[_hashes(texts[a:b], k)[0] >> np.uint64(64 - BITS)] = True
        longs = np.packbits(seen, bitorder="little").view("<i8")
        at = np.flatnonzero(longs)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(longs[at])], names=["at", "bits"])

    rows = df.filter(F.col(seq).isNotNull()).select(seq).mapInArrow(marked, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    longs = np.zeros((1 << BITS) // 64, np.int64)
    for r in rows.collect():  # at most 2 ** BITS / 64 rows, whatever the input
        longs[r.at] = r.bits
    return np.unpackbits(longs.view(np.uint8), bitorder="little").view(bool)


def words(df: DataFrame, key: str, seq: str, k: int, only: np.ndarray | None = None) -> DataFrame:
    """``word, id, place`` of every whole k-letter word (place from 0); with ``only``, of words whose bit is set there."""
    shared = None if only is None else df.sparkSession.sparkContext.broadcast(np.packbits(only))

    def listed(batches):
        wanted = None if shared is None else np.unpackbits(shared.value).view(bool)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                h, of, place = _hashes(texts[a:b], k)
                if wanted is not None:
                    hit = wanted[h >> np.uint64(64 - BITS)]
                    of, place = of[hit], place[hit]
                found = [texts[a + t][p : p + k] for t, p in zip(of.tolist(), place.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(of + a)), pa.array(place.astype(np.int32))], names=["word", "id", "place"])

    return df.filter(F.col(seq).isNotNull()).select(key, seq).mapInArrow(listed, f"word string, id {dict(df.dtypes)[key]}, place int")


def _hot(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("word", F.ceil(F.col("n") / HOT).cast("int").alias(name))


def common_words(q_words: DataFrame, t_words: DataFrame) -> DataFrame:
    """``q_, q_place, t_, t_place`` of all common words; a word of many rows is joined in many parts."""
    hot = _hot(q_words, "q_parts").join(_hot(t_words, "t_parts"), "word", "full")
    hot = hot.select("word", F.coalesce("q_parts", F.lit(1)).alias("q_parts"), F.coalesce("t_parts", F.lit(1)).alias("t_parts"))

    def split(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(hot, "word", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
        mine = F.pmod(F.xxhash64("id", "place"), F.col(own)).cast("int")
        return rows.select("word", "id", "place", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    q, t = split(q_words, "q_parts", "t_parts"), split(t_words, "t_parts", "q_parts")
    q = q.select("word", "q_parts", "t_parts", F.col("id").alias("q_"), F.col("place").alias("q_place"))
    t = t.select("word", "q_parts", "t_parts", F.col("id").alias("t_"), F.col("place").alias("t_place"))
    return q.join(t, ["word", "q_parts", "t_parts"]).select("q_", "q_place", "t_", "t_place")


def seed_search(queries: DataFrame, targets: DataFrame, query: str, target: str, q_seq: str, t_seq: str, k: int = 5, least: int = 2, most: int = 500) -> DataFrame:
    """Homologous pairs by common words on one diagonal: ``query, target, diagonal, seeds, start``.

    Whole texts on both sides. The best diagonal of each pair with ``least`` seeds stays (of equal ones the smallest), and
    ``most`` pairs of each query; ``start`` is the place in the query of the diagonal's first seed. Null texts have no words.
    """
    mine = settled(words(queries, query, q_seq, k))
    theirs = settled(words(targets, target, t_seq, k, marked_words(queries, q_seq, k)))
    diagonal = (F.col("t_place") - F.col("q_place")).alias("diagonal")
    hits = common_words(mine, theirs).groupBy(F.col("q_").alias(query), F.col("t_").alias(target), diagonal).agg(F.count(F.lit(1)).alias("seeds"), F.min("q_place").alias("start"))
    best = first_of(hits.filter(F.col("seeds") >= least), [query, target], [F.col("seeds").desc(), F.col("diagonal")])
    return top_k(best, [query], [F.col("seeds").desc(), F.col(target)], most)


def karlin(chances: dict[int, float]) -> tuple[float, float]:
    """The parameters lambda and K of scores of unrelated letters, from the probability of each score (Karlin and Altschul 1990).

    The mean score is negative and a positive score possible, else a local score has no such statistics.
    """
    low, high = min(chances), max(chances)
    if high <= 0 or sum(s * p for s, p in chances.items()) >= 0:
        raise ValueError("scores need a negative mean and a positive value")
    step = math.gcd(*[s for s, p in chances.items() if s and p])
    at = {s // step: p for s, p in chances.items()}
    low, high = low // step, high // step
    total = lambda x: sum(p * math.exp(x * s) for s, p in at.items())
    top = 1.0
    while total(top) < 1:
        top *= 2
    a, b = min((k / 1000 * top for k in range(1, 1000)), key=total), top  # below one, then above
    for _ in range(200):
        middle = (a + b) / 2
        a, b = (middle, b) if total(middle) < 1 else (a, middle)
    lam = (a + b) / 2
    one = np.zeros(high - low + 1)
    for s, p in at.items():
        one[s - low] += p
    entropy = lam * sum(s * p * math.exp(lam * s) for s, p in at.items())
    walk, sigma = np.ones(1), 0.0  # distribution of the sum of k scores, from k * low on
    for k in range(1, 200):
        walk = np.convolve(walk, one)
        sums = np.arange(len(walk)) + k * low
        part = float((walk[sums >= 0]).sum() + (walk[sums < 0] * np.exp(lam * sums[sums < 0])).sum()) / k
        sigma += part
        if part < 1e-12:
            break
    return lam / step, lam * math.exp(-2 * sigma) / (entropy * -math.expm1(-lam))


def extension(query: np.ndarray, target: np.ndarray, start: int, diagonal: int, match: int, mismatch: int, drop: int) -> tuple[int, int, int, int]:
    """``score, first, last, same``: the best ungapped stretch of a diagonal around a place of the query, letters ``first`` to ``last``
    from 0. Each way ends where the score falls more than ``drop`` below its best."""

    def reach(same: np.ndarray) -> tuple[int, int]:
        s = np.cumsum(np.where(same, match, mismatch))
        fallen = np.flatnonzero(np.maximum(np.maximum.accumulate(s), 0) - s > drop) if len(s) else []
        s = s[: fallen[0]] if len(fallen) else s
        best = int(s.argmax()) if len(s) else 0
        return (int(s[best]), best + 1) if len(s) and s[best] > 0 else (0, 0)

    begin, end = max(0, -diagonal), min(len(query), len(target) - diagonal)
    same = query[begin:end] == target[begin + diagonal : end + diagonal]
    right, n_right = reach(same[start - begin :])
    left, n_left = reach(same[: start - begin][::-1])
    first, last = start - n_left, start + n_right - 1
    return left + right, first, last, int(same[first - begin : last + 1 - begin].sum())


def extend(seeds: DataFrame, queries: DataFrame, targets: DataFrame, query: str, target: str, q_seq: str, t_seq: str, match: int = 1, mismatch: int = -3, drop: int = 20, letters: int = 20, letters_total: int | None = None) -> DataFrame:
    """Hits of ``seed_search`` as rows of a hit table, columns as read by ``sources.fasta.hits``: ``query_id, subject_id, identity,
    alignment_length, mismatches, gap_opens, q_start, q_end, s_start, s_end, evalue, bitscore, rank``, and ``score``.

    The seed of each pair is extended without gaps. Bit score and e-value follow from the statistics of ``letters`` equally
    frequent letters, the query's length, and ``letters_total`` (all target letters, summed here if not given).
    """
    lam, k = karlin({match: 1 / letters, mismatch: 1 - 1 / letters})
    total = letters_total if letters_total is not None else targets.agg(F.coalesce(F.sum(F.length(t_seq)), F.lit(0))).first()[0]
    q = queries.select(F.col(query).alias("query_id"), F.col(q_seq).alias("q_"))
    t = targets.select(F.col(target).alias("subject_id"), F.col(t_seq).alias("t_"))
    pairs = seeds.select(F.col(query).alias("query_id"), F.col(target).alias("subject_id"), "diagonal", "start").join(q, "query_id").join(t, "subject_id")
    kinds = dict(pairs.dtypes)
    out = "score long, alignment_length int, same int, q_start int, q_end int, s_start int, s_end int, q_length int"

    def extended(batches):
        for batch in batches:
            rows = []
            for diagonal, start, a, b in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                score, first, last, same = extension(_codes(a), _codes(b), start, diagonal, match, mismatch, drop)
                rows.append((score, last - first + 1, same, first + 1, last + 1, first + 1 + diagonal, last + 1 + diagonal, len(a)))
            values = [pa.array([r[n] for r in rows], pa.int64() if n == 0 else pa.int32()) for n in range(8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *values], names=["query_id", "subject_id", *[c.split()[0] for c in out.split(", ")]])

    found = pairs.select("query_id", "subject_id", "diagonal", "start", "q_", "t_").mapInArrow(extended, f"query_id {kinds['query_id']}, subject_id {kinds['subject_id']}, {out}")
    bits = (F.col("score") * lam - math.log(k)) / math.log(2)
    rows = found.select(
        "query_id", "subject_id", (F.col("same") * 100.0 / F.col("alignment_length")).alias("identity"), "alignment_length", (F.col("alignment_length") - F.col("same")).alias("mismatches"), F.lit(0).alias("gap_opens"),
        "q_start", "q_end", "s_start", "s_end", F.format_string("%.2e", F.col("q_length") * F.lit(float(total)) * F.pow(F.lit(2.0), -bits)).alias("evalue"), bits.alias("bitscore"), "score",
    )
    return rank_hits(rows, "query_id", [F.col("bitscore").desc(), F.col("subject_id")])
