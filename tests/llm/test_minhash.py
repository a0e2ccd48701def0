import numpy as np
import pyarrow as pa
import pytest

from evisite.llm import minhash


def words(t):
    return (t or "").encode().lower().split()


def plain_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, least=80):
    sets = [plain_set(t, k) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j, s, t = rows[a][0], rows[b][0], sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= least * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [(i, len(s), find(i) if i is not None and s else i) for (i, _), s in zip(rows, sets)]


def test_sets_and_signatures():
    texts = ["", None, " \t", "One two", "one\x0bTWO three four", "a b c d e f a b c d", "é É ß x y z " * 9]
    for k in (4, 5):
        got = minhash.shingle_sets(pa.array(["pad"] + texts).slice(1), k)
        assert [len(s) for s in got] == [len(plain_set(t, k)) for t in texts]
    assert not set(minhash.shingle_sets(pa.array(["a b"]), 4)[0]) & set(minhash.shingle_sets(pa.array(["b a"]), 4)[0])


def test_signature_equals_plain_and_has_lower_variance():
    rng = np.random.default_rng(0)
    m = minhash.SLOTS

    def plain(s):
        sig = [2**64 - 1] * m
        for x in s:
            p = list(range(m))
            for j in range(m):
                u = int(minhash.mix64(np.array([int(x) + 0xD1B54A32D192ED03 * (j + 1) & (2**64 - 1)], np.uint64))[0])
                k = j + ((u & 0xFFFF) * (m - j) >> 16)
                p[j], p[k] = p[k], p[j]
                sig[p[j]] = min(sig[p[j]], (u >> 16) | (j << 48))
        return sig

    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 60, 300)]
    assert minhash.superminhash(sets).tolist() == [plain(s) for s in sets]
    errors = []
    for _ in range(120):
        u = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = minhash.superminhash([np.sort(u[:300]), np.sort(u[100:])])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < (0.25 / m) ** 0.5


@pytest.mark.parametrize("k", [4, 5])
def test_groups_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{n}" for n in range(400)]

    def text(n):
        return list(rng.choice(vocabulary, n))

    rows, bases = [], [text(int(rng.integers(30, 90))) for _ in range(12)]
    for base in bases:
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, len(t)))] = "edit"
            rows.append(" ".join(t))
    chain = text(120)
    rows += [" ".join(chain[i : i + 60]) for i in range(0, 40, 2)]  # a chain whose ends are not alike
    rows += [" ".join(bases[0])] * 5 + ["", None, "one", "one", "ONE", "one two three", "\n \t"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)) + 5, rows)] + [(None, "one"), (7_000, "one"), (7_000, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as component_id")
    got = minhash.group(docs, k=k)
    want = brute(rows, k)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())


def test_shared_ids(spark):
    t = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, t[0]), (7, t[0]), (7, t[1]), (9, t[1] + " end"), (11, t[2]), (11, t[2])]
    got = minhash.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (7, 5), (7, 5), (9, 5), (11, 11), (11, 11)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.group(none).count() == 0


def test_links_equal_set_arithmetic():
    rng = np.random.default_rng(1)
    base = rng.choice(3000, 90, replace=False)
    sets = []
    for n in range(150):  # a cloud around one base, and strangers that share a passage
        own = rng.integers(3000, 2**40, int(rng.integers(0, 30)))
        sets.append(np.unique(np.concatenate([rng.permutation(base)[: 90 - len(own)] if n % 5 else base[:20], own])).astype(np.uint64))
    for least in (50, 80):
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * len(np.intersect1d(sets[a], sets[b])) >= least * len(np.union1d(sets[a], sets[b]))}
        assert {(a, b) for x, y in minhash.linked(sets, least) for a, b in zip(x.tolist(), y.tolist())} == want and want


def test_large_clouds_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{n}" for n in rng.integers(0, 500, 60)]
    rows = []
    for n in range(60):
        t = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 4))):
            t[at] = f"own{n}"
        rows.append((n, " ".join(t)))
    rows += [(3, rows[3][1])] * 5 + [(100 + n, "shared passage of six plain words " * 3 + " ".join(f"x{n}y{k}" for k in range(40))) for n in range(20)]
    want = sorted(brute(rows[:60] + rows[65:], 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, wide in ((7, 10**6), (1000, 300)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "WIDE", wide)
        got = minhash.group(docs)
        assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()}) == want


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"w{n}" for n in rng.integers(0, 10**6, 60_000))
    rows = [(1, long), (2, long + " end"), (3, "some other words that are few"), (4, long[: len(long) // 2])]
    got = minhash.group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute(rows, 5))
