"""Hit search: seeds against brute force with hot words, extension, statistics, and hits that the score filter takes."""

import random
from collections import Counter

import numpy as np
import pytest

from evisite.operators import pairs as P
from evisite.operators import search as W


def plain_seeds(queries, targets, k, least, most):
    found, first = Counter(), {}
    for q, a in queries:
        for t, b in targets:
            for i in range(len(a or "") - k + 1):
                for j in range(len(b or "") - k + 1):
                    if a[i : i + k] == b[j : j + k]:
                        found[q, t, j - i] += 1
                        first[q, t, j - i] = min(i, first.get((q, t, j - i), i))
    best = {}
    for (q, t, d), n in found.items():
        if n >= least:
            best[q, t] = min(best.get((q, t), (0, 0)), (-n, d))
    out = []
    for q in {q for q, _ in best}:
        out += [(q, t, d, -n, first[q, t, d]) for n, t, d in sorted((n, t, d) for (p, t), (n, d) in best.items() if p == q)[:most]]
    return sorted(out)


@pytest.mark.parametrize("chunk, bits, hot", [(1_000_000, 24, 10_000), (70, 6, 3)])
def test_seeds_equal_brute_force(spark, monkeypatch, chunk, bits, hot):
    """Few letters, so that most words are hot and are joined in many parts; a bit table that is full."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("aé😀") for _ in range(n))
    q = [(f"q{k}", text(rng.randint(0, 25))) for k in range(8)] + [("q0", text(9)), ("none", None)]
    t = [(k, text(rng.randint(0, 60))) for k in range(20)] + [(3, text(30)), (50, None), (51, "")]
    frames = spark.createDataFrame(q, "q string, qs string"), spark.createDataFrame(t, "t long, ts string")
    for name, value in (("CHUNK", chunk), ("BITS", bits), ("HOT", hot)):
        monkeypatch.setattr(W, name, value)
    got = W.seed_search(*frames, "q", "t", "qs", "ts", k=5, least=2, most=4).collect()
    want = plain_seeds(q, t, 5, 2, 4)
    assert sorted((r.q, r.t, r.diagonal, r.seeds, r.start) for r in got) == want and want
    assert W.seed_search(frames[0].limit(0), frames[1], "q", "t", "qs", "ts").count() == 0


def plain_extension(a, b, start, diagonal, match, mismatch, drop):
    def way(places):
        best = score = n = 0
        for k, i in enumerate(places):
            if not (0 <= i < len(a) and 0 <= i + diagonal < len(b)):
                break
            score += match if a[i] == b[i + diagonal] else mismatch
            if max(best, 0) - score > drop:
                break
            if score > best:
                best, n = score, k + 1
        return best, n

    (right, n), (left, m) = way(range(start, len(a) + 1)), way(range(start - 1, -2, -1))
    same = sum(a[i] == b[i + diagonal] for i in range(start - m, start + n))
    return right + left, start - m, start + n - 1, same


def test_extension():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(5, 40))) for _ in range(2))
        diagonal = rng.randint(-3, 3)
        low, high = max(0, -diagonal), min(len(a), len(b) - diagonal)
        options = rng.choice([(1, -3, 20), (2, -1, 3), (1, -1, 2)])
        if low < high:
            start = rng.randrange(low, high)
            assert W.extension(W._codes(a), W._codes(b), start, diagonal, *options) == plain_extension(a, b, start, diagonal, *options)


@pytest.mark.parametrize("scores, lam, k", [((1, -2), 1.33, 0.621), ((1, -3), 1.37, 0.711), ((1, -1), 1.10, 0.333)])
def test_published_statistics(scores, lam, k):
    """The values in print for equally frequent nucleotides."""
    got = W.karlin({scores[0]: 0.25, scores[1]: 0.75})
    assert got == (pytest.approx(lam, abs=0.005), pytest.approx(k, abs=0.0005))
    assert W.karlin({2 * scores[0]: 0.25, 2 * scores[1]: 0.75}) == (pytest.approx(got[0] / 2), pytest.approx(got[1]))
    with pytest.raises(ValueError):
        W.karlin({2: 0.5, -1: 0.5})


def test_planted_hits_pass_the_score_filter(spark, monkeypatch):
    """Planted copies with a few other letters are hits of high scores; a shared head, hot on both sides, is a weak one."""
    monkeypatch.setattr(W, "HOT", 20)
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n))
    head = text(9)
    queries = [(f"q{k}", head + text(80)) for k in range(30)]
    targets = [(f"{k:04d}_A", head + text(60) + queries[k][1][20:50] + "W" + queries[k][1][51:80] + text(50)) for k in range(30)] + [(f"{k:04d}_B", head + text(90)) for k in range(40)]
    q, t = spark.createDataFrame(queries, "query_id string, seq string"), spark.createDataFrame(targets, "subject_id string, seq string")
    seeds = W.seed_search(q, t, "query_id", "subject_id", "seq", "seq", k=5, least=2)
    assert seeds.count() >= 30 * 69
    hits = P.bitscore_filter(W.extend(seeds, q, t, "query_id", "subject_id", "seq", "seq", match=1, mismatch=-1, drop=10)).collect()
    assert sorted((r.query_id, r.subject_id) for r in hits) == sorted((f"q{k}", f"{k:04d}_A") for k in range(30))
    for r in hits:
        assert r.rank == 1 and r.gap_opens == 0 and r.alignment_length - r.mismatches == round(r.identity * r.alignment_length / 100) and float(r.evalue) < 1e-5
        assert r.q_end - r.q_start == r.s_end - r.s_start == r.alignment_length - 1 and r.q_start <= 21 and r.q_end >= 80


def test_plan_does_not_grow_with_the_queries(spark):
    """One join of postings, whatever the number of query letters."""
    size = []
    for n in (3, 300):
        q = spark.createDataFrame([(k, "abcdefghij" * 50) for k in range(n)], "q long, s string")
        plan = W.seed_search(q, q.withColumnRenamed("q", "t"), "q", "t", "s", "s", k=12)._jdf.queryExecution().optimizedPlan().toString()
        size.append(plan.count("Join"))
    assert size[0] == size[1] <= 6
