"""Ranked lexical search: a plain scorer, exact partial sums, ties, odd tables, several groups."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from evisite.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counted = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counted:
            m = 50 + 50 * n * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words(text)) if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


VOCAB = ["The", "the", "river", "Été", "été", "x1", "日本", "a", "of", "zebra", "it's", "\x85nel", "ÄB"]


def table(seed, n, most):
    rng = np.random.default_rng(seed)
    return [(int(k), " ".join(rng.choice(VOCAB, rng.integers(0, most)))) for k in range(n)]


def test_terms():
    for text in ["", "It's A-b_c", "ÀÉ x\x80y \x7f{z}", "日本,語 1.5e", " nbsp em"]:
        assert [t.decode() for t in lexical.terms(text.encode())] == words(text)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_against_plain(spark, k, monkeypatch):
    """Many ties: short texts of few words; tiles and products of odd sizes."""
    docs = table(1, 90, 9) + [(5, "the river"), (None, "the river"), (None, None), (91, ""), (92, "zebra " * 3000)]
    items = table(2, 7, 6) + [(7, None), (8, "absent words"), (9, "the the RIVER"), (9, "zebra"), (9, "zebra"), (None, "zebra")]
    monkeypatch.setattr(lexical, "TILE_ITEMS", 4)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as score").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id", "3 as rank")
    assert told(lexical.rank(d, i, k=k)) == plain(docs, items, k)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 3)  # several passes
    assert told(lexical.rank(d, i, k=k)) == plain(docs, items, k)


def test_scores_in_parts(monkeypatch):
    """Products over few terms at once add up to the same whole numbers, and the width keeps sums below 2**53."""
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 30_000, 300)
    items = [list(rng.choice(300, 40, replace=False)) for _ in range(5)]
    starts = np.array([0, 0, 60, 200])
    term = np.concatenate([rng.choice(300, n, replace=False) for n in (60, 140)])
    impact = rng.integers(1, lexical.IMPACT, 200)
    want = [[sum(int(weight[t]) * int(v) for t, v in zip(term[a:b], impact[a:b]) if t in item) for item in items] for a, b in zip(starts, starts[1:])]
    for wide in (4096, 7, 1):
        monkeypatch.setattr(lexical, "WIDTH", wide)
        (tile,) = lexical.tiles(items, weight)
        assert lexical.scores((starts, term, impact), tile, weight).tolist() == want
    monkeypatch.undo()
    assert lexical.width(np.array([2**20])) == 4096 and lexical.width(np.array([2**31])) * lexical.IMPACT * 2**31 < 2**53


def test_best_keeps_ties():
    best = lexical.Best(1, 3)
    for ids in ([9, 8, 7], [1, 2], [5]):
        best.add(0, np.full((len(ids), 1), 4), np.zeros(len(ids), np.int64), np.array(ids))
        best.settle()
    assert best.rows[3].tolist() == [1, 2, 5]


def test_empty(spark):
    docs, items = spark.createDataFrame(table(4, 5, 4), "doc_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.selectExpr("doc_id", "cast(null as string) as text"), items)):
        got = lexical.rank(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
