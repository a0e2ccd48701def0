"""Hard negatives: brute force, certified bounds, ties, odd vectors, small units and blocks."""

import math

import numpy as np
import pytest
from evisite.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=3, n_pos=5, n_neg=3):
    used = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    anchors = {}
    for i, v, lab in sorted(used, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (v, lab))
    out = []
    for a, (v, lab) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, w, other in used if i != a and len(w) == len(v)]
        for k, (p, pos, _) in enumerate(sorted(s for s in scored if s[2])[:n_pos]):
            fits = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:n_neg]
            out += [(a, pos, r + 1, neg, -p, -s, k + 1) for r, (s, neg, _) in enumerate(fits)]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.collect()))


def clusters(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(k, (centres[k % 6] + spread * rng.normal(size=d)).round(3).tolist(), int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("spread, rows, anchors", [(0.05, 50, 7), (1.0, 40, 1000), (0.3, 100_000, 5)])
def test_against_brute_force(spark, monkeypatch, spread, rows, anchors):
    monkeypatch.setattr(hardneg, "ROWS", rows)
    monkeypatch.setattr(hardneg, "ANCHORS", anchors)
    data = clusters(1, 240, 8, spread)
    assert told(hardneg.mine(spark.createDataFrame(data, SCHEMA), anchor_every=3)) == brute(data)


def test_ties_and_odd_rows(spark):
    """Equal vectors and scores, ids that repeat, other lengths, nulls and huge components; extra columns."""
    data = [(k, [1.0, 0.5 * (k % 2), 0.0], k % 3) for k in range(40)] + [(3, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (9, [0.25, 1.0, 0.0], 0)]
    data += [(60 + k, [0.5 + k % 2], k % 2) for k in range(6)] + [(75, [], 1), (78, None, 1), (81, [1.0, None, 0.0], 1), (84, [math.nan, 0.0, 1.0], 1), (87, [math.inf, 0.0, 0.0], 0), (90, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 1)]
    data += [(99, [-1.0, -1.0, 0.0], 1), (102, [0.0, 0.0, 0.0], 1), (105, [1e308, 0.0, 0.0], 1)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' as x", "1 as dim", "2 as rank")
    assert told(hardneg.mine(df, anchor_every=3)) == brute(data)
    huge = [(k, [1e8 + k, 3e9 * (k % 3)], k % 2) for k in range(12)]  # sums beyond 2**53
    assert told(hardneg.mine(spark.createDataFrame(huge, SCHEMA), anchor_every=3)) == [r for r in brute(huge) if r[4] < 2**63]
    assert hardneg.mine(df.limit(0), anchor_every=3).count() == 0


def test_bounds_hold_and_stop_early():
    """No row outscores the bound of what follows; in clear clusters only a part of the rows is visited."""
    data = clusters(5, 6000, 16, 0.02)
    x = np.floor(256 * np.array([v for _, v, _ in data]))
    first, second = hardneg.codebook(x[:, :8]), hardneg.codebook(x[:, 8:])
    ids, labels = np.arange(len(x)), np.array([lab for _, _, lab in data])
    unit = hardneg.Unit(ids, labels, x, first, second, (hardneg.nearest(x[:, :8], first), hardneg.nearest(x[:, 8:], second)))
    for q in x[::1500]:
        seen, score = np.zeros(len(x), bool), unit.x @ q
        for places, rest in unit.visits(q):
            seen[places] = True
            assert (score[~seen] <= rest).all()
        assert seen.all()
    visited, old = [], unit.scores
    unit.scores = lambda places, q: (visited.append(len(places)), old(places, q))[1]
    hardneg.positives(unit, -1, x[0], 5)
    assert sum(visited) < len(x) / 2


def test_window():
    for p in range(-300, 300):
        low, high = hardneg.window(p)
        assert [n for n in range(-400, 400) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))
