import numpy as np
import pytest

from evisite.llm import vectorgraph


def brute(rows, least):
    n = len(rows)
    x = [np.array(v, float) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) else None for _, v, _ in rows]
    link = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and x[a] is not None and x[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                link[a][b] = x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= least
    r = vectorgraph.roots(n, *np.nonzero(np.array(link))) if n else []
    low = {}
    for k in range(n):
        low[r[k]] = min(low.get(r[k], 10**9), rows[k][0])
    return sorted((rows[k][0], sum(link[k]), low[r[k]], rows[k][0] == low[r[k]]) for k in range(n))


def cloud(rng, n, labels=3):
    rows, at = [], 0
    while len(rows) < n:
        base = rng.normal(size=24)
        label = int(rng.integers(0, labels))
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 60]))):
            rows.append((at, (base + rng.normal(size=24) * 0.1).astype(np.float32).tolist(), label))
            at += 1
    return rows


def test_search_equals_brute_force_in_a_shard():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(150, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectorgraph.robust_prune(x)
    assert (vectorgraph.range_search(x, lists, x, 0.9) == (x @ x.T >= 0.9)).mean() > 0.999
    assert max(map(len, lists)) < 120


def test_following_edges_by_a_product_changes_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 12)), rng.normal(size=(1, 12)) + 0.05 * rng.normal(size=(90, 12))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists, queries = vectorgraph.robust_prune(x), x[::2]
    one = vectorgraph.range_search(x, lists, queries, 0.9, lists[::2])
    monkeypatch.setattr(vectorgraph, "EDGES", 3)
    assert (vectorgraph.range_search(x, lists, queries, 0.9, lists[::2]) == one).all() and one.sum() > 2000


@pytest.mark.parametrize("limit", [40, 1000])
def test_whole_operator(spark, monkeypatch, limit):
    monkeypatch.setattr(vectorgraph, "LIMIT", limit)
    monkeypatch.setattr(vectorgraph, "CELL", max(10, limit // 4))
    rows = cloud(np.random.default_rng(limit), 300)
    n = len(rows)
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(60)]
    rows += [(n + 100, None, 1), (n + 101, [0.0] * 24, 1), (n + 102, [float("nan")] + [1.0] * 23, 1), (n + 103, rows[0][1], None), (n + 104, [1.0, None] + [1.0] * 22, 1), (n + 105, rows[0][1][:5], rows[0][2]), (n + 106, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as cell", "3 as vec")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectorgraph.near_duplicates(table).collect())
    want = brute(rows, 0.93)
    found = sum(min(g[1], w[1]) for g, w in zip(got, want))
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert found >= 0.97 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.98 * len(got)


def test_empty(spark):
    assert vectorgraph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_no_borderline_link_is_lost(spark, monkeypatch):
    """Pairs just within range, whose nodes often have different nearest centres, beside one dense, often copied group."""
    monkeypatch.setattr(vectorgraph, "LIMIT", 40)
    monkeypatch.setattr(vectorgraph, "CELL", 10)
    rng, rows = np.random.default_rng(5), []
    for k in range(120):
        a, b = rng.normal(size=(2, 8))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (0.932 * a + (1 - 0.932**2) ** 0.5 * b).tolist(), 1)]
    rows += [(1000 + k, (np.eye(8)[0] + 0.01 * rng.normal(size=8)).tolist(), 1) for k in range(60)]
    rows += [(2000 + k, rows[-1][1], 1) for k in range(60)]
    got = vectorgraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows, 0.93)


def test_recall_of_the_search_on_a_planted_table(spark, monkeypatch, capsys):
    """Thousands of links, all from the graph search: its recall against brute force, and the exact way beside it."""
    monkeypatch.setattr(vectorgraph, "LIMIT", 150)
    monkeypatch.setattr(vectorgraph, "CELL", 50)
    rows = cloud(np.random.default_rng(11), 900)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = {r[0]: r[1] for r in brute(rows, 0.93)}
    got = {r.vec_id: r.n_links for r in vectorgraph.near_duplicates(table, recall=0.0).collect()}  # the first search, whatever its audit
    found, links = sum(min(got[k], want[k]) for k in want), sum(want.values())
    with capsys.disabled():
        print(f"\nrecall of the graph search: {found / links:.4f} of {links} links")
    assert links > 5000 and found >= 0.95 * links and all(got[k] <= want[k] for k in want)
    exact = {r.vec_id: r.n_links for r in vectorgraph.near_duplicates(table, exact=True).collect()}
    assert exact == want


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_label_without_clusters_is_sent_once_and_searched_whole(spark):
    """5000 vectors of a label: each goes to one search, and the search alone finds what brute force finds."""
    rng = np.random.default_rng(12)
    x = unit(rng.normal(size=(5000, 24)))
    other = unit(rng.normal(size=(500, 24)))
    x[500:1000] = unit(x[:500] + 0.3 * other)
    nodes = spark.createDataFrame([(k, 1, v.tolist(), 1) for k, v in enumerate(x)], "node long, label int, vec array<double>, copies long")
    assert vectorgraph.meetings(nodes, 0.93).count() == 5000
    x4 = x.astype(np.float32)
    start, flat = vectorgraph.graph(x4, 4.0)
    links = 0
    for some, a, b, sim in vectorgraph.search(x4, start, flat, x4, 0.93, (start, flat)):
        good = vectorgraph.confirmed(x, x[some], a, b, sim, 0.93) & (some[a] != b)
        links += int(good.sum())
    want = int((x @ x.T >= 0.93).sum()) - 5000
    assert 1000 <= want and 0.999 * want <= links <= want


def test_split_labels_lose_no_link(spark, monkeypatch):
    """A label of clusters is split; each node finds all its links in its own cell."""
    monkeypatch.setattr(vectorgraph, "LIMIT", 100)
    monkeypatch.setattr(vectorgraph, "CELL", 20)
    rng = np.random.default_rng(13)
    centres = unit(rng.normal(size=(12, 32)))
    x = centres[rng.integers(0, 12, 400)] + rng.uniform(0.02, 0.09, (400, 1)) * rng.normal(size=(400, 32))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    nodes = spark.createDataFrame([(k, 1, v, 1) for k, v, _ in rows], "node long, label int, vec array<double>, copies long")
    cells, split = vectorgraph.shards(nodes, 0.93)
    assert split and cells.filter("own").groupBy("node").count().filter("count = 1").count() == 400
    got = vectorgraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows, 0.93)
