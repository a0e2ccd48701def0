"""Spatial operators on a uniform grid: neighbours, accessible area, assemblies.

Points are keyed by (structure, cell). One side is copied to its 27 neighbour cells, the other joins on the cell: an
equi-join that shuffles, splits when skewed, and never forms all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisite.operators.pairs import first_of
from evisite.tables import settled


def distance2(a: str, b: str) -> Column:
    """Squared Euclidean distance of two aliased points."""
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"), F.lit(0.0))


def cells(df: DataFrame, size) -> DataFrame:
    """Adds the grid cell ``cx, cy, cz``."""
    size = F.lit(size) if not isinstance(size, Column) else size
    return df.withColumns({f"c{c}": F.floor(F.col(c) / size) for c in "xyz"})


def around(df: DataFrame) -> DataFrame:
    """A row for each of the 27 cells around a point's cell."""
    step = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    out = df.withColumn("s_", F.explode(step))
    return out.withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"s_.{n}") for c, n in zip("xyz", "ijk")}).drop("s_")


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], radius: float, inclusive: bool = True) -> DataFrame:
    """Pairs within a radius in one structure, as aliases ``l`` and ``r``; the (smaller) left side is copied."""
    a, b = around(cells(left, radius)).alias("l"), cells(right, radius).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "cx", "cy", "cz"]]
    d2 = distance2("l", "r")
    return a.join(b, same).filter(d2 <= radius * radius if inclusive else d2 < radius * radius)


def chains_in_range(sites: DataFrame, residues: DataFrame, radius: float = 10.0) -> DataFrame:
    """Chains with a residue (by its alpha carbon) within the radius of a site: ``site_id, chains``.

    Residues without an alpha carbon are left out.
    """
    keep = [f"{c} is not null" for c in "xyz"]
    near = neighbours(sites.filter(" and ".join(keep)), residues.filter(" and ".join(keep)), ["pdb_id", "model"], radius)
    return near.groupBy(F.col("l.site_id").alias("site_id")).agg(F.array_sort(F.collect_set("r.chain")).alias("chains"))


def golden_sphere(n: int = 920) -> list[tuple[float, float, float]]:
    """Unit points on a golden spiral."""
    turn, out = math.pi * (3 - math.sqrt(5)), []
    for k in range(n):
        y = (2 * k + 1) / n - 1
        r = math.sqrt(max(0.0, 1 - y * y))
        out.append((math.cos(k * turn) * r, y, math.sin(k * turn) * r))
    return out


def icosahedron_sphere(level: int = 4) -> list[tuple[float, float, float]]:
    """Unit points of a subdivided icosahedron: 10 * 4 ** (level - 1) + 2."""
    g = (1 + math.sqrt(5)) / 2
    raw = [(s * 1.0, t * g, 0.0) for s in (-1, 1) for t in (-1, 1)]
    points = [p for x, y, z in raw for p in ((x, y, z), (z, x, y), (y, z, x))]
    unit = lambda p: tuple(c / math.sqrt(sum(d * d for d in p)) for c in p)
    points = [unit(p) for p in points]
    gap = min(math.dist(points[0], p) for p in points[1:]) * 1.01
    near = {i: {j for j in range(12) if j != i and math.dist(points[i], points[j]) < gap} for i in range(12)}
    faces = [(i, j, k) for i in range(12) for j in near[i] for k in near[i] & near[j] if i < j < k]
    for _ in range(level - 1):
        middle: dict[tuple[int, int], int] = {}

        def mid(i: int, j: int) -> int:
            key = (min(i, j), max(i, j))
            if key not in middle:
                points.append(unit(tuple((a + b) / 2 for a, b in zip(points[i], points[j]))))
                middle[key] = len(points) - 1
            return middle[key]

        split = []
        for a, b, c in faces:
            ab, bc, ca = mid(a, b), mid(b, c), mid(c, a)
            split += [(a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca)]
        faces = split
    return points


def _inside(points: np.ndarray, offset: np.ndarray, full: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """For each neighbour (``offset[n, 3]`` from an atom whose sphere has the radius ``full``) which points of the sphere it covers."""
    edge = (full * full + (offset * offset).sum(axis=1) - r2) / (2 * full)
    along = offset @ points.T
    covered = along > edge[:, None]
    n, p = np.nonzero(np.abs(along - edge[:, None]) <= 1e-9 * (1 + np.abs(edge[:, None])))  # at the edge of the cap: by the distance itself
    covered[n, p] = ((points[p] * full[n, None] - offset[n]) ** 2).sum(axis=1) < r2[n]
    return covered


def covered_points(pairs: DataFrame, keys: list[str], points: list) -> DataFrame:
    """``keys, own, m0, m1, ...`` of neighbours ``dx, dy, dz, full, r2, own``: a bit for each point that the neighbour covers."""
    unit, n_longs = np.array(points, float), -(-len(points) // 64)
    names = [f"m{k}" for k in range(n_longs)]

    def masked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                col = lambda c, some=some: some.column(c).to_numpy(zero_copy_only=False)
                bits = np.zeros((some.num_rows, n_longs * 64), bool)
                bits[:, : len(unit)] = _inside(unit, np.stack([col("dx"), col("dy"), col("dz")], axis=1), col("full"), col("r2"))
                longs = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([*[some.column(k) for k in keys], some.column("own"), *[pa.array(np.ascontiguousarray(longs[:, k])) for k in range(n_longs)]], names=[*keys, "own", *names])

    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(masked, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "own boolean", *[f"{m} long" for m in names]]))


def accessible_area(targets: DataFrame, occluders: DataFrame, keys: list[str], points: list, probe: float = 1.4, max_radius: float = 2.75, atom: str = "atom_id", residue: str = "res_id", carry: list[str] | None = None, allowed: str | None = None) -> DataFrame:
    """``keys, atom, residue, sa, asa`` of every target atom (``x, y, z, radius``).

    ``carry``: columns that tell targets with the same atom apart; ``allowed``: an array column of the targets with the
    chains whose atoms count.

    Sample points stand on the sphere of radius + probe. Those inside another atom of the residue are taken from both
    areas, those inside an atom of another residue from the accessible one. Occluders join on the grid cell of the target
    atom; each neighbour becomes a mask of the points that it covers, the masks of an atom are combined bit by bit before
    and after the shuffle, and the areas are counts of bits.
    """
    size = 2 * (max_radius + probe)
    t = around(cells(targets, size)).alias("t")
    o = cells(occluders, size).alias("o")
    same = [F.col(f"t.{k}") == F.col(f"o.{k}") for k in [*keys, "cx", "cy", "cz"]]
    reach, r_o = F.col("t.radius") + probe, F.col("o.radius") + probe
    pairs = t.join(o, same).filter((F.col(f"t.{atom}") != F.col(f"o.{atom}")) & (distance2("t", "o") < (reach + r_o) ** 2))
    if allowed:
        pairs = pairs.filter(F.array_contains(f"t.{allowed}", F.col("o.chain")))
    keys = [*keys, *(carry or [])]
    offsets = [(F.col(f"o.{c}") - F.col(f"t.{c}")).alias(f"d{c}") for c in "xyz"]
    own = F.coalesce(F.col(f"o.{residue}") == F.col(f"t.{residue}"), F.lit(False)).alias("own")
    near = pairs.select(*[F.col(f"t.{k}").alias(k) for k in [*keys, atom]], *offsets, reach.cast("double").alias("full"), (r_o * r_o).cast("double").alias("r2"), own)
    masks = covered_points(near, [*keys, atom], points)
    names = [c for c in masks.columns if c not in (*keys, atom, "own")]
    none = F.lit(0).cast("long")
    hidden = masks.groupBy(*keys, atom).agg(
        sum((F.bit_count(F.coalesce(F.bit_or(F.when(F.col("own"), F.col(m))), none)) for m in names), F.lit(0)).alias("n_own_"),
        sum((F.bit_count(F.bit_or(m)) for m in names), F.lit(0)).alias("n_all_"),
    )
    joined = targets.select(*keys, atom, residue, "radius").join(hidden, [*keys, atom], "left")
    scale = 4 * math.pi * (F.col("radius") + probe) ** 2 / len(points)
    left = lambda c: len(points) - F.coalesce(F.col(c), F.lit(0))
    return joined.select(*keys, atom, residue, (scale * left("n_own_")).alias("sa"), (scale * left("n_all_")).alias("asa"))


def residue_percent(areas: DataFrame, residues: DataFrame, keys: list[str]) -> DataFrame:
    """100 * accessible / surface area of each residue; no eligible atom: -1, no surface: 0."""
    sums = areas.groupBy(*keys).agg(F.sum("sa").alias("sa"), F.sum("asa").alias("asa"))
    pct = F.when(F.col("sa").isNull(), -1.0).when(F.col("sa") == 0, 0.0).otherwise(F.col("asa") * 100.0 / F.col("sa"))
    return residues.select(*keys).distinct().join(sums, keys, "left").select(*keys, pct.alias("area"))


def area_contexts(targets: DataFrame, contexts: dict[str, DataFrame], keys: list[str], points: list, **options) -> DataFrame:
    """Accessible areas in several surroundings (asymmetric unit, isolated chain, assembly), with ``context``."""
    out = None
    for name, atoms in contexts.items():
        one = accessible_area(targets, atoms, keys, points, **options).withColumn("context", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def assembly_copies(atoms: DataFrame, assemblies: DataFrame, sites: DataFrame | None = None, most: int = 100_000, keep: float = 150.0) -> DataFrame:
    """Atoms of all copies of an assembly: each 3 x 4 matrix applied to its chains; adds ``assembly, copy``.

    Structures above ``most`` atoms keep what is within ``keep`` of a site (``pdb_id, x, y, z``), where sites are given.
    """
    plan = assemblies.select("pdb_id", F.col("num").alias("assembly"), F.explode("chains").alias("chain"), "matrices")
    plan = plan.select("pdb_id", "assembly", "chain", F.posexplode("matrices").alias("copy", "m"))
    moved = atoms.join(plan, ["pdb_id", "chain"])
    at = lambda r: sum((F.col("m")[r][c] * F.col(n) for c, n in enumerate("xyz")), F.col("m")[r][3])
    moved = moved.withColumns({"x_": at(0), "y_": at(1), "z_": at(2)}).drop("x", "y", "z", "m").withColumnsRenamed({"x_": "x", "y_": "y", "z_": "z"})
    if sites is None:
        return moved
    large = moved.groupBy("pdb_id", "assembly").agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > most).select("pdb_id", "assembly")
    small = moved.join(large, ["pdb_id", "assembly"], "left_anti")
    return small.unionByName(within(moved.join(large, ["pdb_id", "assembly"], "left_semi"), sites, ["pdb_id"], keep))


def within(points: DataFrame, sites: DataFrame, keys: list[str], keep: float) -> DataFrame:
    """The points (all columns, each once) within ``keep`` of any site with the same ``keys``.

    Space is cut into cells of a quarter of ``keep``. A site names the cells that lie wholly inside its sphere, and those that its
    sphere cuts; points of the former stay untested, those of the latter are tested against the sites that name their cell.
    """
    size, slack = keep / 4, 1e-6 * keep
    named = sites.select(*keys, *[F.col(c).cast("double").alias(f"s{c}") for c in "xyz"]).filter("sx is not null and sy is not null and sz is not null").distinct()
    for c in "xyz":
        low, high = F.floor((F.col(f"s{c}") - keep) / size), F.floor((F.col(f"s{c}") + keep) / size)
        named = named.withColumn(f"k{c}", F.explode(F.sequence(low, high)))
    edge = lambda c, k: (F.col(f"k{c}") + k) * size - F.col(f"s{c}")
    far = sum((F.greatest(F.abs(edge(c, 0)), F.abs(edge(c, 1))) ** 2 for c in "xyz"), F.lit(0.0))
    near = sum((F.greatest(edge(c, 0), -edge(c, 1), F.lit(0.0)) ** 2 for c in "xyz"), F.lit(0.0))
    place = [*keys, *[f"k{c}" for c in "xyz"]]
    touched = named.withColumn("whole", far <= (keep - slack) ** 2).filter(near <= (keep + slack) ** 2)
    whole = touched.filter("whole").select(*place).distinct()
    cut = touched.filter("not whole").join(whole, place, "left_anti")
    spheres = whole.select(*place, *[F.lit(None).cast("double").alias(f"s{c}") for c in "xyz"]).unionByName(cut.select(*place, "sx", "sy", "sz"))
    p, s = points.alias("p"), spheres.alias("s")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.floor(F.col(f"p.{c}") / size) == F.col(f"s.k{c}") for c in "xyz"]
    d2 = sum(((F.col(f"p.{c}") - F.col(f"s.s{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return p.join(s, [*same, F.col("s.sx").isNull() | (d2 <= keep * keep)], "left_semi")


def first_assembly(pairs: DataFrame, assemblies: DataFrame, order: str = "num") -> DataFrame:
    """For each (structure, chain) pair the first assembly, in file order, that holds the chain."""
    plan = assemblies.select("pdb_id", F.explode("chains").alias("chain"), F.col(order).alias("assembly"))
    first = plan.groupBy("pdb_id", "chain").agg(F.min("assembly").alias("assembly"))
    return pairs.join(first, ["pdb_id", "chain"], "left")


def batch_areas(atoms: DataFrame, done: DataFrame | None, points: list, key: str = "file", residue_mode: bool = True, sidechain: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Areas over many structures at once, without those already done: rows by atom or residue, and totals by file."""
    todo = atoms if done is None else atoms.join(done.select(key).distinct(), key, "left_anti")
    todo = todo.filter(~F.col("atom_name").isin("N", "C", "O") if sidechain else F.lit(True))
    areas = accessible_area(todo, todo, [key, "model"], points, **options)
    totals = areas.groupBy(key).agg(F.sum("asa").alias("total_area"), F.count(F.lit(1)).alias("atoms"))
    rows = residue_percent(areas, todo.select(key, "model", "res_id"), [key, "model", "res_id"]) if residue_mode else areas
    return rows, totals


def twin_residues(residues: DataFrame) -> DataFrame:
    """The same number, insertion code and name in another chain of a structure."""
    k = ["pdb_id", "resnum", "icode", "resname"]
    a, b = residues.select(*k, "chain"), residues.select(*k, F.col("chain").alias("twin"))
    return a.join(b, k).filter("chain <> twin")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """The nearest right point of each left point within a radius; of equal distances the least id.

    Of the right points at one place two are enough, and a left point is searched in a wider radius only when a narrower one has none:
    so neither copies nor crowded places make pairs that grow with the square of their number.
    """
    order = F.row_number().over(Window.partitionBy(*keys, *"xyz").orderBy("id"))
    two = right.select(*keys, "id", *"xyz").filter("id is not null").distinct().withColumn("n_", order).filter("n_ <= 2")
    places = two.groupBy(*keys, *"xyz").agg(F.min("id").alias("one_"), F.max("id").alias("two_"))
    left, places, found = left.select(*keys, "id", *"xyz"), settled(places), []
    for share in (64, 8, 1):
        near = F.when(F.col("r.one_") != F.col("l.id"), F.col("r.one_")).otherwise(F.col("r.two_")).alias("near")
        pairs = neighbours(left, places, keys, radius / share).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.id").alias("id"), near, distance2("l", "r").alias("d2"))
        best = first_of(pairs.filter("id <> near"), [*keys, "id"], [F.col("d2"), F.col("near")])
        if share > 1:
            best = settled(best.filter(F.col("d2") < (0.99 * radius / share) ** 2))  # whatever rounding does at the edges of cells
            left = left.join(best.select(*keys, "id"), [*keys, "id"], "left_anti")
        found.append(best)
    return found[0].unionByName(found[1]).unionByName(found[2])
