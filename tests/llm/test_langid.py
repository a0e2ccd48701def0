import zlib

import numpy as np

from evisite.llm import langid

WORDS = {"aa": ["bal", "dor", "kim", "lo", "tas"], "bb": ["schü", "wöx", "zyq", "ße", "ürg"], "cc": ["éne", "quou", "çav", "ji", "èle"]}


def corpus(n, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[lang], rng.integers(3, 60))), lang))
    return rows


def test_gradients():
    m = langid.BiGru(["a", "b", "c"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = langid.windows([b"abcabc", b"bc", b"cabb"], 6, [0, 0, 1])
    y, mask = np.array([0, 1, 2]), mask.astype(np.float64)
    _, grads = m.gradients(x, y, mask)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for e in (1e-5, -1e-5):
            m.p[k][at] += e
            ends.append(m.gradients(x, y, mask)[0])
            m.p[k][at] -= e
        assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-6


def test_documents_equal_plain_recurrence():
    m = langid.BiGru(["a", "b"], hidden=4)
    texts = [b"", b"x", b"hello world " * 30, b"q" * 128, b"z" * 129, b"ab" * 72, b"ab" * 71 + b"c", b"yz" * 136, b""]
    got = m.documents(texts)

    def states(d, w):
        s, out = np.zeros(4), []
        for b in w if d == "f" else w[::-1]:
            x, h = m.p["x" + d][b], s @ m.p["u" + d]
            z, r = (1 / (1 + np.exp(-(x[k : k + 4] + h[k : k + 4]))) for k in (0, 4))
            n = np.tanh(x[8:] + r * h[8:])
            s = (1 - z) * n + z * s
            out.append(s)
        return np.array(out if d == "f" else out[::-1])

    for t, p in zip(texts, got):
        total = np.zeros(2)
        for k in range(0, len(t), 128):  # windows with 16 bytes of lead on both sides
            low = max(0, k - 16)
            w = t[low : k + 128 + 16]
            e = np.exp(states("f", w) @ m.p["wf"] + states("b", w) @ m.p["wb"] + m.p["c"])
            total += (e / e.sum(axis=1, keepdims=True))[k - low : k - low + 128].sum(axis=0)
        assert np.allclose(p, total / max(1, len(t)), atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(450)
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "bal dor kim lo", None), (None, "bal dor", "aa"), (1004, "schü wöx " * 5000, None), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as Score")
    model = langid.fit(docs, per_language=60)
    got = langid.classify(docs, model).select("doc_id", "lang_pred", "score", langid.held_out("doc_id").alias("held_out")).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    assert (by[1003].lang_pred, by[1004].lang_pred, by[None].lang_pred) == ("aa", "bb", "aa")
    test = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)
    assert sum(by[k].lang_pred == lang for k, lang in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got)
    none = docs.limit(0)
    assert langid.classify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.classify(docs.drop("lang_pred"), None).collect()} == {"und"}


def test_ties_and_very_long_texts(spark):
    tied = langid.BiGru(["aa", "bb"], hidden=2)
    tied.p = {k: np.zeros_like(v) for k, v in tied.p.items()}
    rows = [(1, "any words"), (2, "schü wöx " * 60_000), (3, "9 " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in langid.classify(docs, tied).collect()}
    assert got == {1: ("aa", 0.5), 2: ("aa", 0.5), 3: ("und", 0.0)}
    model = langid.fit(spark.createDataFrame(corpus(150), "doc_id long, text string, lang string"), per_language=40)
    assert {r.doc_id: r.lang_pred for r in langid.classify(docs, model).collect()}[2] == "bb"
