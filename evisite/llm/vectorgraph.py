"""Operator 5: embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors of a label become one node with a multiplicity.
2. The nodes of a label are a cell. Cells above ``LIMIT`` are split by spherical k-means centres (fitted on at most ``SAMPLE`` nodes of a
   cell, chosen by hash): a node goes to every centre that a vector within range of it may have as nearest, so that a node's own
   cell, its nearest centre's, holds all nodes in range of it. Where that would not halve the pairs to be looked at (vectors without clusters, one dense group; told
   by the sample, before any row is made), the cell is dealt by hash into blocks of ``LIMIT`` instead, and every block meets every other.
3. The nodes of a block, or of two that meet, get one graph: overlapping k-means regions of at most ``REGION`` nodes (each node in its
   nearest centre's and in those whose angle is at most ``margin`` degrees larger), robust pruning in each, united lists.
4. Every node searches that graph: greedy from its own list and from the medoids of clusters, widened as long as nodes within range,
   or among the nearest ``beam``, are unexpanded; so a search's work hardly grows with the block. Links are what the search finds, those
   near the limit confirmed in double precision. A node's links are counted in its own cell. Tasks return
   counts and union-find roots, never pairs, so a group of thousands of copies gives rows in proportion to its size.
5. An exact check follows: the cosines of the block in single precision, a few queries at a time, give the number of links that each
   node must have, and links that the search missed are counted as such and added. Below a mean ``recall`` of the search, ``beam`` and
   ``margin`` are doubled and the search repeated; where the widest falls short too, or with ``exact``, the check's links alone are taken.
   A ``recall`` of 0 asks for the search alone.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link
with nothing. Vectors of different lengths don't link. Rows that share an id each count. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisite.llm.common import components, low_hash, settle, tidy, unite

LIMIT = 32_768  # nodes of a block, of up to ``WIDTH`` components
WIDTH = 64
CELL = 250  # nodes that a centre is meant for
REGION = 2000  # nodes that are pruned together
SAMPLE, FIT = 2048, 8192
DEGREE, NEAR, ALPHA, BEAM, WIDE = 16, 48, 1.2, 16, 8
GATE = 48
QUERIES = 128  # searched together
EDGES = 500_000  # edges followed one by one
SINGLE = 1e-4  # above the error of a cosine in single precision


def kmeans(x: np.ndarray, k: int, turns: int = 6, seed: int = 1) -> np.ndarray:
    """Unit centres of unit rows."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(turns):
        to = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, to, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """For each row its pruned neighbours, made symmetric."""
    n = len(x)
    near = min(NEAR, n - 1)
    if near < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    cand = np.argpartition(sim, n - near, axis=1)[:, n - near :]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sim, cand, 1), axis=1), 1)
    own = 1 - np.take_along_axis(sim, cand, 1)
    alive, row, edges = np.ones(cand.shape, bool), np.arange(n), []
    for _ in range(min(DEGREE, near)):
        has = alive.any(axis=1)
        if not has.any():
            break
        best = cand[row, alive.argmax(axis=1)]
        edges.append(np.stack([row[has], best[has]]))
        between = 1 - sim[best[:, None], cand]
        alive &= ~((ALPHA * between <= own) | (cand == best[:, None]))
    a, b = np.concatenate(edges, axis=1)
    both = _distinct(np.concatenate([a * n + b, b * n + a]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted keys from 0, each once."""
    keys.sort()
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def _regions(x: np.ndarray, margin: float, most: int) -> list[np.ndarray]:
    """Overlapping k-means regions: each row in its nearest centre's and in up to ``most`` whose angle is at most ``margin`` degrees larger."""
    n = len(x)
    some = x if n <= FIT else x[np.random.default_rng(2).choice(n, FIT, replace=False)]
    c = kmeans(some, min(len(some), -(-n // CELL)))
    most, rows, to = min(most, len(c)), [], []
    for at in range(0, n, 4096):
        sim = x[at : at + 4096] @ c.T
        best = np.argpartition(sim, len(c) - most, axis=1)[:, len(c) - most :]
        angle = np.degrees(np.arccos(np.clip(np.take_along_axis(sim, best, 1), -1, 1)))
        r, k = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + margin)
        rows.append(at + r)
        to.append(best[r, k])
    rows, to = np.concatenate(rows), np.concatenate(to)
    order = np.argsort(to, kind="stable")
    return np.split(rows[order], np.flatnonzero(np.diff(to[order])) + 1)


def graph(x: np.ndarray, margin: float, most: int = BEAM // 2) -> tuple[np.ndarray, np.ndarray]:
    """``(start, flat)``: row ``k``'s neighbours are ``flat[start[k]:start[k + 1]]``, the united pruned lists of its regions."""
    n, todo, keys = len(x), [np.arange(len(x))], [np.zeros(0, np.int64)]
    while todo:
        part = todo.pop()
        if len(part) > REGION:
            for overlap in (most, 2):
                inner = _regions(x[part], margin, overlap)
                if max(map(len, inner)) <= len(part) / 2:
                    break
            else:  # one dense group
                inner = np.array_split(np.random.default_rng(3).permutation(len(part)), -(-len(part) // REGION))
            todo += [part[v] for v in inner]
            continue
        lists = robust_prune(x[part])
        keys.append(np.repeat(part, [len(v) for v in lists]) * n + part[np.concatenate(lists)])
    key = _distinct(np.concatenate(keys))
    return np.searchsorted(key, np.arange(n + 1) * n), (key % n).astype(np.int32)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of ``n`` nodes' components: minima pushed along the links, with path halving."""
    r = np.arange(n)
    while True:
        low = r.copy()
        np.minimum.at(low, a, r[b])
        np.minimum.at(low, b, r[a])
        low = np.minimum(low, low[low])
        if (low == r).all():
            return r
        r = low


def _cosines(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), x.dtype)
    for k in range(0, len(a), 100_000):
        some = slice(k, k + 100_000)
        out[some] = np.einsum("ij,ij->i", q[a[some]], x[b[some]])
    return out


def _slack(x: np.ndarray) -> float:
    """More than a cosine in single precision may be off."""
    return max(SINGLE, x.shape[1] * 2.0**-22)


def confirmed(x: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs ``q[a], x[b]`` with cosines ``sim`` of single precision have a cosine of ``least`` or more in double precision;
    those within the error of the limit are computed again, by one formula."""
    good, slack = sim >= least, _slack(x)
    close = np.flatnonzero(np.abs(sim.astype(np.float64) - least) <= slack)
    good[close] = _cosines(q, x, a[close], b[close]) >= least
    return good


def medoids(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where searches start: in each part of the graph the node nearest to each centre of its clusters, one for about ``GATE`` nodes."""
    order = np.argsort(part, kind="stable")
    out = []
    for of in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(of) > GATE:
            some = of if len(of) <= FIT else np.random.default_rng(4).choice(of, FIT, replace=False)
            c = kmeans(x[some], min(len(some), -(-len(of) // GATE)), turns=3)
        else:
            c = x[of].mean(axis=0, keepdims=True)
        near = [(x[of] @ c[k : k + 128].T).argmax(axis=0) for k in range(0, len(c), 128)]
        out.append(of[np.unique(np.concatenate(near))])
    return np.concatenate(out)


def _edges(start: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The neighbours of nodes ``at``, one node's after the other's."""
    step = start[at + 1] - start[at]
    return flat[np.repeat(start[at] - (np.cumsum(step) - step), step) + np.arange(int(step.sum()))]


def _followed(start: np.ndarray, flat: np.ndarray, known: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes not yet known that queries ``rows`` reach by the edges of nodes ``at``, each once; they are known then."""
    m, n = known.shape
    flags, step = known.reshape(-1), start[at + 1] - start[at]
    if int(step.sum()) <= EDGES:
        key = np.repeat(rows, step) * n + _edges(start, flat, at)
        r, to = np.divmod(_distinct(key[~flags[key]]), n)
    else:  # many nodes at once, as in a dense group: a node is reached by the queries of all its neighbours, one bit for each
        pick = np.zeros((-(-m // 64) * 64, n), bool)
        pick[rows, at] = True
        bits = np.ascontiguousarray(np.packbits(pick, axis=0, bitorder="little").T).view(np.uint64)
        cols = np.zeros(n, bool)
        cols[_edges(start, flat, np.flatnonzero(bits.any(axis=1)))] = True
        cols = np.flatnonzero(cols)
        got = np.bitwise_or.reduceat(bits[_edges(start, flat, cols)], np.concatenate([[0], np.cumsum(start[cols[:-1] + 1] - start[cols[:-1]])]), axis=0)
        new = np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, :m].T.astype(bool) & ~known[:, cols]
        r, to = np.nonzero(new)
        to = cols[to]
    flags[r * n + to] = True
    return r, to


def search(x: np.ndarray, start: np.ndarray, flat: np.ndarray, q: np.ndarray, least: float, own: tuple[np.ndarray, np.ndarray] | None = None, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time, near ones together, ``(queries, a, b, sim)``: which rows ``b`` of ``x`` query ``a`` of them finds at a cosine of about
    ``least`` or more, by greedy, range-expanding search over a symmetric graph. It starts from the medoids of the graph's clusters and,
    for queries that are nodes, from their ``own`` lists. In single precision, with a slack for its error."""
    n, near = len(x), np.float32(least - _slack(x))
    starts = medoids(x, roots(n, np.repeat(np.arange(n), np.diff(start)), flat.astype(np.int64)))
    guides = x[starts[::5]].T
    order = np.argsort(np.concatenate([np.zeros(0, np.int64), *((q[k : k + 1024] @ guides).argmax(axis=1) for k in range(0, len(q), 1024))]), kind="stable")
    for some in np.split(order, range(QUERIES, len(q), QUERIES)):
        y, m = q[some], len(some)
        known = np.zeros((m, n), bool)
        sim = y @ x[starts].T
        known[:, starts] = True
        front = sim >= near
        np.put_along_axis(front, np.argpartition(sim, -min(beam, len(starts)), axis=1)[:, -min(beam, len(starts)) :], True, axis=1)
        rows, to = np.nonzero(front)
        sim, to = sim[rows, to], starts[to]
        if own is not None:
            r, v = np.repeat(np.arange(m), own[0][some + 1] - own[0][some]), _edges(*own, some).astype(np.int64)
            new = ~known[r, v]
            r, v = r[new], v[new]
            known[r, v] = True
            rows, to, sim = np.concatenate([rows, r]), np.concatenate([to, v]), np.concatenate([sim, _cosines(y, x, r, v)])
        # The nearest ``beam`` of each query, best first, and which of them are to be expanded; nodes in range are at once.
        best, node, open_ = np.full((m, beam), -2, np.float32), np.zeros((m, beam), np.int64), np.zeros((m, beam), bool)
        inside, found = np.zeros(m, np.int64), []
        while True:
            hit = sim >= near
            found.append((rows[hit], to[hit], sim[hit]))
            inside += np.bincount(rows[hit], minlength=m)
            full = inside >= beam
            open_[full] = False
            new = (sim > best[rows, -1]) & ~full[rows]
            r, v, s, o = rows[new], to[new], sim[new], ~hit[new]
            by = np.lexsort((-s, r))
            r, v, s, o = r[by], v[by], s[by], o[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, v, s, o, rank = (k[rank < beam] for k in (r, v, s, o, rank))
            if len(r):
                which, at = np.unique(r, return_inverse=True)
                wide = [np.concatenate([k[which], np.full((len(which), beam), fill, k.dtype)], axis=1) for k, fill in ((best, -2), (node, 0), (open_, False))]
                for k, values in zip(wide, (s, v, o)):
                    k[at, beam + rank] = values
                by = np.argsort(-wide[0], axis=1, kind="stable")[:, :beam]
                best[which], node[which], open_[which] = (np.take_along_axis(k, by, 1) for k in wide)
            pick = open_ & (np.cumsum(open_, axis=1) <= WIDE)
            open_ &= ~pick
            r, c = np.nonzero(pick)
            rows, at = np.concatenate([rows[hit], r]), np.concatenate([to[hit], node[r, c]])
            if not len(rows):
                break
            rows, to = _followed(start, flat, known, rows, at)
            seen = np.zeros(n, bool)
            seen[to] = True
            if len(rows) * 8 > m * int(seen.sum()):
                sim = (y @ x[seen].T)[rows, (np.cumsum(seen) - 1)[to]]
            else:
                sim = _cosines(y, x, rows, to)
        yield some, *(np.concatenate(k) for k in zip(*found))


def range_search(x: np.ndarray, lists: list[np.ndarray], q: np.ndarray, least: float, own: list[np.ndarray] | None = None, beam: int = BEAM) -> np.ndarray:
    """Which rows of ``x`` each query finds at a cosine of ``least`` or more, from a graph and own lists given as lists."""
    flat_lists = lambda some: (np.concatenate([[0], np.cumsum([len(v) for v in some])]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *some]).astype(np.int32))
    out = np.zeros((len(q), len(x)), bool)
    for some, a, b, sim in search(x.astype(np.float32), *flat_lists(lists), q.astype(np.float32), least, own and flat_lists(own), beam):
        out[some[a], b] = confirmed(x, q[some], a, b, sim, least)
    return out


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _children(x: np.ndarray, c: np.ndarray, least: float) -> np.ndarray:
    """Which centres a vector in range of a row of ``x`` may have as nearest, by the planes between its own centre and the others."""
    reach = float(np.sqrt(1 - least * least)) if least > 0 else 2.0
    sim = x @ c.T
    apart = np.sqrt(np.maximum(0, ((c[:, None] - c[None]) ** 2).sum(axis=2)))[sim.argmax(axis=1)]
    return sim.max(axis=1, keepdims=True) - sim <= reach * apart + 1e-9


def _fitted(cells: DataFrame, sizes: DataFrame, depth: int, least: float) -> DataFrame:
    """``(cell, k, centres)`` for each cell of ``sizes``; ``k`` is 0 where the sample shows that splitting doesn't halve the pairs."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(depth)), "node")
    some = cells.join(sizes, "cell").filter(low_hash(F.xxhash64("node", F.lit(depth)), SAMPLE, F.col("n")))
    sample = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf.sort_values("rank")["vec"])
        k = int(min(len(x), 128, max(2, -(-int(pdf["n"].iloc[0]) // CELL))))
        c = kmeans(x, k)
        pays = (_children(x, c, least).mean(axis=0) ** 2).sum() <= 0.5
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "k": [k if pays else 0], "centres": [c.reshape(-1) if pays else []]})

    return settle(sample.groupBy("cell").applyInPandas(centres, "cell long, k int, centres array<double>"))


def _split(cells: DataFrame, centres: dict[int, np.ndarray], depth: int, least: float) -> DataFrame:
    """Members of oversize cells to child cells."""

    @tidy
    def assigned(batches):
        for pdf in batches:
            for cell, own in pdf.groupby("cell", sort=False):
                x = _unit(own["vec"])
                r, to = np.nonzero(_children(x, centres[cell], least))
                nearest = (x @ centres[cell].T).argmax(axis=1)[r] == to
                yield own.iloc[r].assign(child=to.astype(np.int32), own=own["own"].to_numpy()[r] & nearest)[["cell", "child", "node", "vec", "copies", "own"]]

    placed = cells.mapInPandas(assigned, T.StructType([T.StructField("cell", T.LongType()), T.StructField("child", T.IntegerType()), *(cells.schema[c] for c in ("node", "vec", "copies", "own"))]))
    return settle(placed.select(F.xxhash64("cell", "child", F.lit(depth)).alias("cell"), "node", "vec", "copies", "own"))


def shards(nodes: DataFrame, least: float) -> tuple[DataFrame, bool]:
    """``(cell, node, vec, copies, own)`` with each node in its own cell, where all in range of it are, and maybe in more; and whether a cell was split."""
    open_ = nodes.select(F.xxhash64("label", F.size("vec")).alias("cell"), "node", "vec", "copies", F.lit(True).alias("own"))
    closed = None
    for depth in range(6):
        sizes = open_.groupBy("cell").agg(F.count("*").alias("n"))
        large = settle(sizes.filter(F.col("n") > LIMIT))
        fit = open_.join(large, "cell", "left_anti")
        closed = fit if closed is None else closed.unionByName(fit)
        if large.isEmpty():
            return closed, depth > 0
        fitted = _fitted(open_, large, depth, least)
        closed = closed.unionByName(open_.join(fitted.filter("k = 0"), "cell", "left_semi"))
        models = {r.cell: np.array(r.centres).reshape(r.k, -1) for r in fitted.filter("k > 0").collect()}  # 2 bytes a node at most, at 64 components
        if not models:
            return closed, depth > 0
        open_ = _split(open_.join(fitted.filter("k > 0"), "cell", "left_semi"), models, depth, least)
    return closed.unionByName(open_), True


def meetings(nodes: DataFrame, least: float) -> DataFrame:
    """``(cell, i, j, first, node, vec, copies, own)``: the nodes of blocks ``i`` and ``j`` of a cell, those of ``i`` being ``first``."""
    cells, split = shards(nodes, least)
    cells = settle(cells) if split else cells
    most = F.greatest(F.first(F.size("vec")), F.lit(WIDTH)) * F.count("*") / (WIDTH * LIMIT)
    sizes = cells.groupBy("cell").agg(F.ceil(most).cast("int").alias("blocks"))
    members = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), "node", "vec", "copies", "own")


def links(nodes: DataFrame, least: float, margin: float, beam: int = BEAM, exact: bool = False, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Links: ``(node, n, missed)``, weighted by multiplicity, with those that only the check found, and union-find edges ``(a, b)``."""

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "node"], ascending=[False, True], ignore_index=True)
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        pdf = pdf.assign(query=pdf["first"] & (pdf["own"] | (not same))).sort_values(["query", "node"], ascending=[False, True], ignore_index=True)
        size, m = len(pdf), int(pdf["query"].sum())
        low = 0 if same else m  # targets begin here
        ids, copies, own = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
        if size < 2 or low == size or m == 0:
            return pd.DataFrame({"node": [], "n": [], "missed": [], "root": []})
        x = _unit(pdf["vec"])
        del pdf
        x4 = x.astype(np.float32)
        n, missed, parent = np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size)

        def counted(a: np.ndarray, b: np.ndarray, into: tuple) -> None:
            unite(parent, a, b)
            for total in into:
                np.add.at(total, a, copies[b])
                if low:  # the targets of other blocks don't ask back
                    np.add.at(total, b, copies[a])

        if exact:
            found = ((np.arange(k, min(k + QUERIES, m)), *(np.zeros(0, t) for t in (np.int64, np.int64, np.float32))) for k in range(0, m, QUERIES))
        else:
            start, flat = graph(x4, margin, beam // 2)
            found = search(x4, start, flat, x4[:m], least, (start, flat), beam)
        for some, a, b, sim in found:
            y = x[some]
            real = (b >= low) & (some[a] != b)
            a, b, sim = a[real], b[real], sim[real]
            good = confirmed(x, y, a, b, sim, least)
            a, b = a[good], b[good]
            counted(some[a], b, (n,))
            if exact or check:
                near = x4[some] @ x4[low:].T
                p, q = np.nonzero(near >= np.float32(least - _slack(x)))
                sim, q = near[p, q], q + low
                good = confirmed(x, y, p, q, sim, least) & (some[p] != q)
                if good.sum() > len(a):
                    rest = np.setdiff1d(p[good] * size + q[good], a * size + b, assume_unique=True)
                    counted(some[rest // size], rest % size, (n, missed))
        return pd.DataFrame({"node": ids, "n": n * own, "missed": missed * own, "root": ids[parent]})

    met = meetings(nodes, least)
    found = settle(met.groupBy("cell", "i", "j").applyInPandas(searched, "node long, n long, missed long, root long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed"))
    return counts, found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")


def near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = 0.99, margin: float = 4.0, exact: bool = False, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    single = vectors.select(vec_col).schema[0].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = settle(rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))))
    nodes = settle(rows.filter("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("label", "vec", "low")))
    beam = BEAM
    while True:
        counts, edges = links(nodes, least, margin, beam, exact, check=recall > 0)
        counts = settle(counts)
        if exact or recall <= 0:
            break
        reached = counts.filter("n > 0").agg(F.avg(1 - F.col("missed") / F.col("n"))).first()[0]
        if reached is None or reached >= recall:
            break
        exact = margin > 60
        margin, beam = (margin if exact else margin * 2), beam * 2
    ids = nodes.select("node", "low")
    # Components over ids: the least id of a node stands for it.
    named = edges.join(ids.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
    comps = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    per = nodes.join(counts, "node", "left").join(comps, F.col("low") == comps["node"], "left")
    per = per.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    linked = rows.filter("ok").join(per, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
