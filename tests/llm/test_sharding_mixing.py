import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np

from evisite.llm import mixing, sharding


def test_deal_equals_plain_greedy():
    rng = np.random.default_rng(0)
    runs = sorted(((float(s), int(n)) for s, n in zip(rng.integers(9, 5000, 40), rng.integers(1, 400, 40))), reverse=True)
    loads = [0.0] * 24
    for (size, _), quota in zip(runs, sharding.deal(runs, 24)):
        for k, n in quota:
            loads[k] += size * n
    heap = [(0.0, k) for k in range(24)]
    for size, n in runs:
        for _ in range(n):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
    assert np.allclose(sorted(loads), sorted(load for load, _ in heap))
    assert [sum(n for _, n in q) for q in sharding.deal(runs, 24)] == [n for _, n in runs]


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "x" * int(rng.integers(0, 3000))) for k in range(600)]
    rows += [(1000 + k, "copy of one text") for k in range(300)] + [(2000, None), (2001, None), (2001, None), (None, "no id"), (5, rows[5][1]), (3000, "é" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as key", "3 as shard")
    got = sharding.shard(docs, 24, run_rows=7, slot_rows=1).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    text = {i: t for i, t in rows}
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[text[r.doc_id] if text[r.doc_id] is not None else r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    rest = sorted(load[k] for k in range(24))[:-1]  # one shard holds the very long text
    assert rest[-1] - rest[0] < 3100
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shards_equal_plain_lpt(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [int(n) for n in rng.integers(70_000, 90_000, 90)] + [int(n) for n in rng.integers(0, 60, 400)]
    rows = [(k, f"{k:04}" + "x" * n) for k, n in enumerate(sizes)]
    rows += [(1000 + k, rows[k % 50][1]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t) + 8
    heap, want = [(0, k) for k in range(24)], Counter()
    for size in sorted(groups.values(), reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        want[size, k] += 1
    for step in (sharding.STEP, 50):
        monkeypatch.setattr(sharding, "STEP", step)
        home = {rows[0][1]: None} | {dict(rows)[r.doc_id]: r.shard for r in sharding.shard(docs, 24).collect()}
        assert Counter((groups[t], k) for t, k in home.items()) == want


def plain_fill(sizes, weights, most=3):
    total, caps, held = sum(sizes), [most * s for s in sizes], set()
    while True:
        level = (total - sum(caps[k] for k in held)) / max(1e-9, sum(w for k, w in enumerate(weights) if k not in held))
        more = {k for k, w in enumerate(weights) if k not in held and w * level >= caps[k]}
        if not more:
            return [caps[k] if k in held else w * level for k, w in enumerate(weights)]
        held |= more


def test_mix(spark):
    rng = np.random.default_rng(2)
    names = [None, "a", "B", "é", "b", "tiny", "Z"]
    rows = []
    for k in range(700):
        s = names[int(rng.choice(7, p=[0.1, 0.4, 0.1, 0.1, 0.1, 0.01, 0.19]))]
        rows.append((k, " ".join(["w"] * int(rng.integers(0, 60))), s))
    rows += [(800, None, "a"), (801, "", "none"), (802, "\t\n ", "none"), (803, "x\x0by z", "B"), (5, rows[5][1], rows[5][2]), (None, "no id here", "a"), (804, "long " * 20_000, "Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as u")
    got = mixing.mix(docs, rows_per_bucket=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), rows_per_bucket=50).collect()))
    size = {s: 0 for _, _, s in rows}
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_fill([size[s] for s in order], [k % 3 + 1 for k in range(len(order))])))
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 for s in order)
    again = mixing.repeat(docs)
    assert again.columns == docs.columns
    words = Counter()
    for r in again.collect():
        words[r.source] += len(r.text.encode().split())
    assert all(words[s] == taken[s] for s in order)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeat(docs.limit(0)).count() == 0
