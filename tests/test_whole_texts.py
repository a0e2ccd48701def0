"""Queries that read whole texts, against brute force on small fixtures."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from evisite.operators import align as A
from evisite.operators import spatial as X
from evisite.plans import registry


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_seed_search_reads_past_400_letters_and_documents(spark, tmp_path):
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefghij ") for _ in range(900))
    docs = [(1, "x" * 3000 + item[600:640] + "y" * 50), (2, item[100:130]), (3, "z" * 99)]
    d = put(spark, tmp_path, benchmark=([(7, item)], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    got = sorted((r.item_id, r.doc_id, r.diagonal, r.seeds) for r in registry.queries()["seed_search_documents"](spark, d).collect())
    assert got == [(7, 1, 2400, 29), (7, 2, -100, 19)]


def dense_batch(queries, targets, table, gap_open, gap_extend):
    """Score and gapped rows by whole tables of plain cells."""
    low, out = A.NEVER, []
    for q, t in zip(queries, targets):
        m, u, w = ([[v] * (len(t) + 1) for _ in range(len(q) + 1)] for v in (0, low, low))
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                u[i][j] = max(m[i - 1][j] + gap_open, u[i - 1][j] + gap_extend)
                w[i][j] = max(m[i][j - 1] + gap_open, w[i][j - 1] + gap_extend)
                m[i][j] = max(0, m[i - 1][j - 1] + int(table[ord(q[i - 1]), ord(t[j - 1])]), u[i][j], w[i][j])
        score, j, i = min((-m[i][j], j, i) for i in range(len(q) + 1) for j in range(len(t) + 1))
        top, under, end_i, end_j, state = [], [], i, j, "m"
        while i and j and not (state == "m" and m[i][j] == 0):
            if state == "m" and m[i][j] == m[i - 1][j - 1] + table[ord(q[i - 1]), ord(t[j - 1])]:
                i, j = i - 1, j - 1
                top.append(t[j])
                under.append(q[i])
            elif state == "u" or state == "m" and m[i][j] == u[i][j]:
                state = "m" if u[i][j] == m[i - 1][j] + gap_open else "u"
                i -= 1
                top.append("-")
                under.append(q[i])
            else:
                state = "m" if w[i][j] == m[i][j - 1] + gap_open else "l"
                j -= 1
                top.append(t[j])
                under.append("-")
        rows = t[:j] + "-" * i + "".join(top[::-1]) + "-" * (len(q) - end_i) + t[end_j:], "-" * j + q[:i] + "".join(under[::-1]) + q[end_i:] + "-" * (len(t) - end_j)
        out.append((-score, *rows))
    return out


def test_alignment_with_long_targets_equals_brute_force():
    rng, table = random.Random(5), A._lookup(A.simple_matrix())
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for gap_open, gap_extend in ((-10, -2), (-3, -1), (-1, -4), (-2, -2)):
        q = [text(rng.randint(0, 12), "ACD") for _ in range(40)]
        t = [text(rng.randint(0, 120), rng.choice(["ACD", "ACDEFGH"])) for _ in range(40)]
        got, want = A.align_batch(q, t, table, gap_open, gap_extend), dense_batch(q, t, table, gap_open, gap_extend)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert got == want


def test_rows_made_again_equal_rows_kept(monkeypatch):
    """Traceback from every few rows, with both texts long, and pairs of odd lengths side by side."""
    rng, table = random.Random(7), A._lookup(A.simple_matrix())
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    monkeypatch.setattr(A, "KEPT", 60)
    monkeypatch.setattr(A, "CELLS", 200)
    for gap_open, gap_extend in ((-10, -2), (-3, -1), (-1, -4), (-2, -2)):
        q = [text(rng.choice([0, 1, 7, 30, 31, 61]), "ACD") for _ in range(25)]
        t = [text(rng.randint(0, 90), rng.choice(["ACD", "ACDEFGH"])) for _ in range(25)]
        assert A.align_batch(q, t, table, gap_open, gap_extend) == dense_batch(q, t, table, gap_open, gap_extend)


def test_long_pair_in_bounded_memory():
    """Two texts of 20,000 letters: full tables would take gigabytes; the gapped rows spell both texts and add up to the score."""
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), 20_000))
    b = "".join(a[k : k + 190] + "WWWW"[: k % 3] for k in range(0, 20_000, 200))
    tracemalloc.start()
    ((score, top, low),) = A.align_batch([a], [b], A._lookup(A.simple_matrix()), -10, -2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and top.replace("-", "") == b and low.replace("-", "") == a
    columns = list(zip(top, low))
    inner = columns[next(k for k, c in enumerate(columns) if "-" not in c) : len(columns) - next(k for k, c in enumerate(columns[::-1]) if "-" not in c)]
    total, gap = 0, None
    for x, y in inner:
        here = "t" if x == "-" else "q" if y == "-" else None
        total += (4 if x == y else -2) if here is None else -2 if here == gap else -10
        gap = here
    assert total == score


def test_local_align_reads_whole_and_short_texts(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    docs = [(1, text(5000)), (2, "abcdef"), (3, ""), (4, None), (5, text(25)), (6, "X" * 20 + "no1t2f3o4u5n" + "z" * 300), (7, text(40)), (7, text(40))]
    d = put(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    got = sorted((r.doc_id, r.score, r.identity) for r in registry.queries()["local_align"](spark, d).collect())
    window = lambda k, s: s[max(0, min(1 + k * 37 % max(len(s), 1) - 6, len(s) - 12)) :][:12]
    table = A._lookup(A.simple_matrix(letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,"))
    want = sorted((k, dense_batch([window(k, s)], [s], table, -10, -2)[0][0]) for k, s in docs if s is not None)
    assert [g[:2] for g in got] == want
    assert (2, 24, 100) in got and (3, 0, 0) in got and len(got) == 7
    far = A.align_pairs(spark.createDataFrame([("ACDEFG", "H" * 9000 + "ACDEFG" + "H" * 70)], "q string, t string"), "q", "t").first()
    assert far.score == 24 and far.query_row.index("A") == 9000


def test_gapless_reads_whole_and_short_texts(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    docs = [(k, text(n)) for k, n in enumerate([0, 5, 10, 11, 15, 39, 40, 700, 3000])] + [(20, None), (7, text(60))]
    d = put(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    got = Counter((r.doc_id, r.score, r.offset) for r in registry.queries()["gapless_align_documents"](spark, d).collect())
    want = Counter()
    for k, s in docs:
        q = s[max(0, 1 + k * 37 % max(len(s), 1) - 5) :][:10] if s is not None else None
        places = [(-sum(4 if a == b else -2 for a, b in zip(q, s[o:])), o) for o in range(len(s) - len(q) + 1)] if s is not None else []
        want[(k, -min(places)[0], min(places)[1]) if places else (k, None, None)] += 1
    assert got == want
    rows = [("XXXX", "Q" * 5000 + "XXYX" + "Q" * 9), ("abc", "ab")]
    assert A.best_place(*rows[0], 4, -2) == (10, 5000) and A.best_place(*rows[1], 4, -2) == (None, None)


def test_identity_of_whole_alignments(spark, tmp_path):
    docs = [(1, "abc"), (2, "q" * 20 + "bcdefghijkla" + "w" * 900), (3, "-" * 50)]
    d = put(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.score) for r in registry.queries()["identity_score_documents"](spark, d).collect()) == [(1, 100), (2, 100), (3, 0)]


def test_areas_on_642_points(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, [rng.uniform(0, 0.06) for _ in range(3)], k % 2) for k in range(30)]
    d = put(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.sa, r.asa) for r in registry.queries()["accessible_area_642"](spark, d).collect()}
    sphere = X.icosahedron_sphere(4)
    assert len(sphere) == 642 and len(got) == 30
    for k, v, label in rows:
        full, sa, asa = 1.2 + k % 5 * 0.2 + 1.4, 0, 0
        for p in sphere:
            at = [100 * a + u * full for a, u in zip(v, p)]
            own = [n // 8 == k // 8 for n, w, l in rows if l == label and n != k and sum((a - 100 * b) ** 2 for a, b in zip(at, w)) < (1.2 + n % 5 * 0.2 + 1.4) ** 2]
            sa, asa = sa + (not any(own)), asa + (not own)
        scale = 4 * 3.141592653589793 * full * full / 642
        assert abs(got[k][0] - scale * sa) < 1e-3 and abs(got[k][1] - scale * asa) < 1e-3


def test_nearest_among_copies_and_crowds(spark, monkeypatch):
    """Equal places, ties, ids at two places and lone points against brute force; copies make no pairs among themselves."""
    rng = random.Random(12)
    rows = [(k, k % 2, *(float(rng.choice([0, 1, 2, 3, 40, 55.5])) for _ in "xyz")) for k in range(60)] + [(100 + k, 0, 7.0, 7.0, 7.0) for k in range(300)]
    rows += [(k, 0, 90.0 + rng.random(), rng.random(), rng.random()) for k in range(500, 560)] + [(3, 1, 90.0, 90.0, 90.0), (900, 1, 95.0, 90.0, 90.0), (901, 1, 500.0, 0.0, 0.0), (None, 1, 500.0, 0.0, 0.0), (902, None, 1.0, 1.0, 1.0)]
    made, pairs = [], X.neighbours
    monkeypatch.setattr(X, "neighbours", lambda *a, **b: made.append(pairs(*a, **b)) or made[-1])
    p = spark.createDataFrame(rows, "id int, label int, x double, y double, z double")
    got = sorted((r.label, r.id, r.near, round(r.d2, 9)) for r in X.nearest(p, p, ["label"], 15.0).collect())
    want = {}
    for i, a, *u in rows:
        for j, b, *v in rows:
            d = sum((s - t) ** 2 for s, t in zip(u, v))
            if i is not None and j is not None and a is not None and a == b and i != j and d <= 225:
                want[a, i] = min(want.get((a, i), (d, j)), (d, j))
    assert got == sorted((a, i, j, round(d, 9)) for (a, i), (d, j) in want.items())
    assert sum(m.count() for m in made) < 20 * len(rows)  # all pairs in reach: about 100,000


def test_alignment_batches_are_bounded(spark):
    """Spark hands a few megabytes of text to Python at once, not 10,000 rows however long; small steps give the same rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 90)))) for k in range(40)] + [(40, "A/", "D"), (41, "A", "/D"), (42, None, "D")]
    df = spark.createDataFrame(rows, "k int, q string, t string")
    spark.conf.unset(name)
    try:
        whole = A.align_pairs(df, "q", "t")
        assert int(spark.conf.get(name).rstrip("bB")) <= 4 << 20
        spark.conf.unset(name)
        A.gapless_whole(df, "k", "q", "t")
        assert int(spark.conf.get(name).rstrip("bB")) <= 4 << 20
        some = A.align_pairs(df, "q", "t", letters=70, batch=3)
        got, want = (sorted(map(tuple, d.collect())) for d in (some, whole))
    finally:
        spark.conf.set(name, before)
    table = A._lookup(A.simple_matrix())
    assert got == want == sorted((k, q, t, *dense_batch([q], [t], table, -10, -2)[0]) for k, q, t in rows if q is not None)
