from collections import Counter

import numpy as np

import corpus_pipeline
from evisite.llm.common import settle


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = {"aa": ["bal", "dor", "kim", "lo", "tas"], "bb": ["schü", "wöx", "zyq", "ße", "ürg"]}
    rows = []
    for k in range(120):
        lang = "ab"[k % 2] * 2
        text = " ".join(f"{w}{rng.integers(0, 30)}x" for w in rng.choice(words[lang], 50))
        rows.append([k, text, lang, f"s{k % 4}", len(text)])
    for k in range(30):  # copies and near copies
        text = rows[k][1] if k % 2 else rows[k][1] + " end"
        rows.append([200 + k, text, rows[k][2], "s9", len(text)])
    rows.append([300, "mail a.b@mail.example.com or +1 (415) 555-0199 " + rows[7][1][::-1], "aa", "s1", 1])
    rows += [[301, "12 34 !!", "aa", "s1", 8], [302, None, "aa", "s1", None], [303, "", None, None, 0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, "unused"))
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["language"]}
    assert kept == {r[0] for r in rows} - {301, 302, 303}
    assert {r.doc_id for r in seen["near_dedup"]} == kept - set(range(200, 230))
    clean = {r.doc_id: r.text for r in seen["personal_data"]}
    assert "@" not in clean[300] and "555-0199" not in clean[300] and "<EMAIL>" in clean[300]
    assert all(clean[r[0]] == r[1] for r in rows[:120])
    size, taken = Counter(), Counter()
    for r in seen["personal_data"]:
        size[r.source] += len(r.text.split())
    for r in seen["mix"]:
        taken[r.source] += len(r.text.split())
    names = sorted(size)
    share = {s: sum(size.values()) * (k % 3 + 1) / sum(j % 3 + 1 for j in range(len(names))) for k, s in enumerate(names)}
    assert all(abs(taken[s] - share[s]) <= 1 for s in names if share[s] < 3 * size[s])
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["mix"]}
    ids = Counter()
    for r in seen["pack"]:
        ids[r.doc_id] += r.length
    rows_of = Counter(r.doc_id for r in seen["mix"])
    whole = Counter(r.doc_id for r in seen["mix"] if r.text == clean[r.doc_id])
    for d in rows_of:  # every repetition is packed whole
        totals = [r.doc_tokens for r in seen["pack"] if r.doc_id == d and r.start == 0]
        assert len(totals) == rows_of[d] and sum(totals) == ids[d] and whole[d] >= rows_of[d] - 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, "unused"))
    assert docs.count() == 0


def test_odd_tables(spark):
    """A very long text, repeated rows, null ids, null texts and extra columns named like those of the stages."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    rows = [[k, f"some plain words of row {k} " * 6, "aa", "s", 1] for k in range(40)] + [[k, rows_text, "bb", None, None] for k, rows_text in ((100, long), (101, long + " end"), (102, None), (None, "no id here but words"), (100, long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as Score", "'x' as lang_pred", "2 as start", "'k' as key", "3 as u", "4 as row_", "5 as kept_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, "unused"))
        assert [c.lower() for c in docs.columns[:5]] == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id for r in docs.select("doc_id").collect()} >= {100} and 101 not in {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "unused").collect()
    assert sum(r.length for r in pieces if r.doc_id == 100) > 30_000


def test_batches_are_bounded_below_the_limit_of_spark(spark):
    """Spark has a limit of its own, which is higher; one that a session sets lower stays."""
    from evisite.llm.common import bounded_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        bounded_batches(spark)
        assert int(spark.conf.get(name).rstrip("bB")) == 4 << 20
        spark.conf.set(name, "1000")
        bounded_batches(spark)
        assert spark.conf.get(name).rstrip("bB") == "1000"
    finally:
        spark.conf.set(name, before)
