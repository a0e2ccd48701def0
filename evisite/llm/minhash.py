"""Operator 9: near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

Signature: each shingle is a random permutation of the slots; its place ``j`` in that permutation, plus a random
fraction, is its value at slot ``p(j)``, and a slot keeps the least value. The places of one shingle are correlated,
which lowers the variance against independent hashes. Places are gone through level by level for all documents of a
batch; a document is finished as soon as no slot holds more than the level reached (early stopping), after about
``m log m / n`` levels.

Grouping: documents with one shingle set are one class. Bands of a signature are bucket keys; with 25 bands of 5 slots a
pair of similarity 0.8 shares no bucket with probability 5e-5, less above. Then, from coarse to exact:

1. In each bucket the members are compared by set size and by sketches, with a bound five standard deviations below
   the threshold; union-find leaves at most one edge a member. The components of these edges are *clouds*: every link
   lies inside one.
2. The shingle sets of the documents in clouds, and of no others, are built once more and brought together by cloud.
   All intersections in a cloud are counted by an inverted index (dense products for frequent shingles), links are
   confirmed on these full sets, and union-find leaves one edge a member again.

No pair leaves a task in either step: the rows out are as many as the members in. Buckets and clouds of more than
``BLOCK`` documents (or ``WIDE`` shingles) are dealt into blocks and compared block against block, each two of them in a
task of its own; a member is then sent once per block, so the rows sent for one cloud of ``n`` documents are ``n`` squared by
``BLOCK``. That cost is left: the links inside such a cloud cannot be known without it.

Cases: texts that are null or without words have no shingle and link with nothing; texts shorter than a shingle have
one, their whole word sequence. A row without an id links with nothing and is kept. Rows that share an id are one
document. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import batches_of, components, own_texts, settle, tidy, unite, unsettle

BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
SKETCH = 8  # longs of 16 four-bit values
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D], np.uint64)
SALTS = 64  # parts of a class of equal sets while its least id is found
BLOCK, WIDE = 1000, 500_000  # documents, shingles of a block
SENT = 500_000  # ids up to which the list of documents in clouds is broadcast (12 MB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(own_texts(texts)))
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    w = hashes[words.indices.to_numpy()]
    mult = MULTIPLIERS[:k]
    n = len(w)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled += w[j : j + len(rolled)] * mult[j]
    rolled = mix64(rolled)
    out = []
    for a, b, none in zip(bounds[:-1], bounds[1:], empty):
        if none:
            out.append(np.zeros(0, np.uint64))
        elif b - a < k:
            short = (int((w[a:b] * mult[: b - a]).sum(dtype=np.uint64)) + 0x9E3779B97F4A7C15 * int(b - a)) % 2**64
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.unique(rolled[a : b - k + 1]))
    return out


def superminhash(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """Signatures (sets by slots) of non-empty sets, values as level << 48 | 48 random bits."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sig = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    place = None
    for j in range(m):
        u = mix64(x + np.uint64(0xD1B54A32D192ED03 * (j + 1) % 2**64))
        value = (u >> np.uint64(16)) | (np.uint64(j) << np.uint64(48))
        k = j + ((u & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        if place is None:
            slot = k
        else:  # Fisher-Yates: the element's permutation so far, one row each
            row = np.arange(len(x))
            slot = place[row, k].astype(np.int64)
            place[row, k] = place[:, j]
        np.minimum.at(sig, owner * m + slot, value)
        if j == m - 1:
            break
        unfinished = sig.reshape(-1, m).max(axis=1) >= (np.uint64(j + 1) << np.uint64(48))
        go = unfinished[owner]
        if not go.any():
            break
        if place is None:
            x, owner, k = x[go], owner[go], k[go]
            place = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
            place[np.arange(len(x)), k] = 0
        elif not go.all():
            x, owner, place = x[go], owner[go], place[go]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix64(out + sig[:, r::ROWS][:, :BANDS] * MULTIPLIERS[r])
    return mix64(out + np.arange(BANDS, dtype=np.uint64) * MULTIPLIERS[7])


def sketches(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, 16 slots a long."""
    four = np.zeros((len(sig), SKETCH * 16), np.uint64)
    four[:, : sig.shape[1]] = mix64(sig) >> np.uint64(60)
    return (four.reshape(len(sig), SKETCH, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


FEATURES = "doc_id long, n_shingles long, print array<long>, bands array<long>, sketch array<long>"


def features(docs: DataFrame, k: int) -> DataFrame:
    """Set size, set fingerprint, band keys and sketch of every row of ``(doc_id, text)``."""

    def made(batches):
        for batch in batches:
            size, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right")))
                some, at = batch.slice(at, to - at), to
                sets = shingle_sets(some.column(1), k)
                has = [n for n, s in enumerate(sets) if len(s)]
                bands, sketch, mark = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                sig = superminhash([sets[n] for n in has])
                for n, b, s in zip(has, band_keys(sig).view(np.int64).tolist(), sketches(sig).view(np.int64).tolist()):
                    h = xxhash.xxh3_128_digest(sets[n].tobytes())
                    bands[n], sketch[n], mark[n] = b, s, np.frombuffer(h, np.int64).tolist()
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(mark, longs), pa.array(bands, longs), pa.array(sketch, longs)],
                    names=[c.split()[0] for c in FEATURES.split(", ")],
                )

    return docs.mapInArrow(tidy(made), FEATURES)


def whole_groups(batches, keys: int, least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns, as tables of whole groups of at least ``least`` rows (the last: any)."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        new = group_starts([table.column(k).to_numpy() for k in range(keys)])
        ends, at = [], 0
        for start in new[1:]:
            if start - at >= least:
                ends.append(start)
                at = start
        for start, end in zip([0, *ends], ends):
            yield table.slice(start, end - start)
        held, rows = [table.slice(at)], table.num_rows - at
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the row before it; 0 first."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray, n: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs ``x < y`` of places in one run, runs beginning at ``starts``, in slices of about ``most`` pairs."""
    if not n:
        return
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    later = end - np.arange(n) - 1
    upto = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        count = later[at:to]
        x = np.repeat(np.arange(at, to), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        if len(x):
            yield x, y
        at = to


def alike(sizes: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Whether set sizes and sketches allow a similarity of ``least`` percent."""
    t = least / 100
    share = 1 / 16 + 15 / 16 * t
    most = SLOTS * (1 - share) + 5 * (SLOTS * share * (1 - share)) ** 0.5  # unequal slots, five deviations above the mean
    near = np.minimum(sizes[x], sizes[y]) * 100 >= np.maximum(sizes[x], sizes[y]) * least
    unequal = np.zeros(int(near.sum()), np.int64)
    for n in range(sketch.shape[1]):
        d = sketch[x[near], n] ^ sketch[y[near], n]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        unequal += np.bitwise_count(d & np.uint64(0x1111111111111111))
    near[near] = unequal <= most
    return near


def linked(sets: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of sets with ``100 * intersection >= least * union``, by counting shared shingles; in strips of sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((n, n), np.float32)  # the upper triangle counts
    x = np.concatenate(sets)
    order = np.argsort(x, kind="stable")
    owner = np.repeat(np.arange(n, dtype=np.int32), size)[order]
    starts = group_starts([x[order]])
    freq = np.diff(np.append(starts, len(x)))
    del x, order
    often = freq > max(32, n // 16)
    some = (freq > 1) & ~often
    light = owner[np.repeat(some, freq)]
    for p, q in pairs_within(np.cumsum(freq[some]) - freq[some], len(light)):
        np.add.at(both.reshape(-1), light[p].astype(np.int64) * n + light[q], np.float32(1))
    heavy = np.flatnonzero(often)
    for k in range(0, len(heavy), 1024):
        part = heavy[k : k + 1024]
        have = np.zeros((n, len(part)), np.float32)
        place = np.concatenate([np.arange(starts[h], starts[h] + freq[h]) for h in part])
        have[owner[place], np.repeat(np.arange(len(part)), freq[part])] = 1
        both += have @ have.T
    for k in range(0, n, 128):
        p, q = np.nonzero(both[k : k + 128])
        p, q = p[q > p + k] + k, q[q > p + k]
        c = both[p, q].astype(np.int64)
        good = 100 * c >= least * (size[p] + size[q] - c)
        yield p[good], q[good]


def blocks_of(count: F.Column, rep: F.Column) -> tuple[F.Column, F.Column]:
    """The block pairs ``(i, j)`` in which a document takes part, for a group of ``count`` blocks."""
    mine = F.pmod(F.xxhash64(rep), count).cast("int")
    others = F.when(count > 1, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array(F.lit(0)))
    return F.transform(others, lambda t: F.struct(F.least(t, mine).alias("i"), F.greatest(t, mine).alias("j")))


def clouds(reps: DataFrame, least: int) -> DataFrame | None:
    """``(node, component)`` of all documents that some bucket pairs with another by size and sketch; None without any."""
    members = reps.select(F.explode("bands").alias("key"), "rep")
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    members = members.join(shared.select("key", "n"), "key").distinct()
    sketch = reps.select("rep", "n_shingles", "sketch")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("key", "rep", F.explode(blocks_of(blocks, F.col("rep"))).alias("b")).select("key", "b.i", "b.j", "rep").join(sketch, "rep")
    dealt = dealt.select("key", "i", "j", "rep", "n_shingles", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def compared(batches):
        for table in whole_groups(batches, 3, 4096):
            starts = group_starts([table.column(k).to_numpy() for k in range(3)])
            rep, sizes = table.column(3).to_numpy(), table.column(4).to_numpy()
            sketch = table.column(5).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
            parent = np.arange(len(rep))
            for x, y in pairs_within(starts, len(rep)):
                apart = parent[x] != parent[y]
                x, y = x[apart], y[apart]
                near = alike(sizes, sketch, x, y, least)
                unite(parent, x[near], y[near])
            hung = np.flatnonzero(rep != rep[parent])
            yield pa.RecordBatch.from_arrays([pa.array(rep[hung]), pa.array(rep[parent[hung]])], names=["a", "b"])

    edges = settle(dealt.mapInArrow(tidy(compared), "a long, b long").distinct())
    found = None if edges.isEmpty() else components(edges)
    unsettle(edges)
    return found


def confirmed(docs: DataFrame, members: DataFrame, k: int, least: int, repeated: bool) -> tuple[DataFrame, bool]:
    """Edges ``(a, b)`` that join the linked documents of each cloud, and whether they are stars already."""
    weight = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / WIDE)).cast("int").alias("blocks"))
    large = settle(weight.filter("blocks > 1"))
    whole = large.isEmpty()
    placed = members.join(large, "component", "left").select(F.col("rep").alias("doc_id"), "component", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = F.broadcast(placed) if members.count() <= SENT else placed

    def built(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array([s.tobytes() for s in shingle_sets(some.column(3), k)], pa.binary())], names=["cloud", "blocks", "rep", "shingles"])

    sets = docs.join(placed, "doc_id").select("component", "blocks", "doc_id", "text").mapInArrow(tidy(built), "cloud long, blocks int, rep long, shingles binary")
    sets = sets.filter(F.octet_length("shingles") > 0)
    sets = sets.dropDuplicates(["rep", "shingles"]) if repeated else sets
    sets = settle(sets.select("cloud", "rep", "shingles", F.explode(blocks_of(F.col("blocks"), F.col("rep"))).alias("b")).select("cloud", "b.i", "b.j", "rep", "shingles"))

    def resolved(batches):
        small = (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500))
        for table in whole_groups(small, 3, 200):
            rep = table.column(3).to_numpy()
            held = table.column(4).combine_chunks()
            sets = [np.frombuffer(held[n].as_buffer(), np.uint64) for n in range(len(rep))]
            parent = np.arange(len(rep))
            again = np.flatnonzero(rep[1:] == rep[:-1])  # rows that share an id
            unite(parent, again, again + 1)
            starts = group_starts([table.column(k).to_numpy() for k in range(3)])
            group_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rep))))
            for x, y in linked(sets, least):
                own = group_of[x] == group_of[y]
                unite(parent, x[own], y[own])
            hung = np.flatnonzero(rep != rep[parent])
            yield pa.RecordBatch.from_arrays([pa.array(rep[hung]), pa.array(rep[parent[hung]])], names=["a", "b"])

    together = sets.repartition("cloud", "i", "j").sortWithinPartitions("cloud", "i", "j", "rep")
    edges = settle(together.mapInArrow(tidy(resolved), "a long, b long"))
    unsettle(sets, large)
    return edges, whole


def group(docs: DataFrame, k: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``."""
    with batches_of(docs.sparkSession, 1000):
        return _grouped(docs, k, least, id_col, text_col)


def _grouped(docs: DataFrame, k: int, least: int, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = settle(features(docs, k))
    usable = feats.filter("n_shingles > 0 and doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = usable.groupBy("print", "salt").agg(F.min("doc_id").alias("low"))
    classes = settle(parts.select("print", "salt", F.min("low").over(Window.partitionBy("print")).alias("rep")))
    homed = usable.join(classes, ["print", "salt"])
    ids = settle(homed.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "b"))
    repeated = not ids.isEmpty()
    reps = homed.filter("doc_id = rep").select("rep", "print", "n_shingles", "sketch", "bands")
    reps = settle(reps.dropDuplicates(["rep", "print"]) if repeated else reps)
    labels = settle(homed.join(ids, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()) if repeated else None  # of rows that share an id but not their text
    if (near := clouds(reps, least)) is not None:
        members = settle(near.join(reps.groupBy(F.col("rep").alias("node")).agg(F.sum("n_shingles").alias("n_shingles")), "node").select(F.col("node").alias("rep"), "component", "n_shingles"))
        edges, whole = confirmed(docs, members, k, least, repeated)
        labels = edges.withColumnsRenamed({"a": "node", "b": "component"}) if whole and labels is None else components(edges if labels is None else edges.union(labels))
        unsettle(members)
    elif labels is not None:
        labels = components(labels)
    out = feats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(_named(classes, labels), ["print", "salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The classes with the component of each in place of its least id."""
    if labels is None:
        return classes
    return classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("print", "salt", F.coalesce("component", "rep").alias("rep"))
