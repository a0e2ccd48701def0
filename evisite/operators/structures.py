"""Atoms to residues: classes, radii, modified residues, numbering, locations, sequences, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisite.dims import AMINO, BACKBONE, EXPECTED_ATOMS, IONS, MODIFICATIONS, NUCLEIC, OTHER, PARENT, RADII, WATER, lookup

TYPE_CODES = {"amino": "A", "modified": "A", "nucleic": "D", "ion": "I", "unknown": "U", "other": "O"}


def atom_class(resname: Column, atom_name: Column) -> Column:
    """hydrogen, amino, modified, nucleic, ion, water, other or unknown."""
    c = F.when(F.startswith(atom_name, F.lit("H")), "hydrogen")
    for name, values in (("amino", list(AMINO)), ("modified", list(PARENT)), ("nucleic", list(NUCLEIC)), ("ion", IONS), ("water", WATER), ("other", OTHER)):
        c = c.when(resname.isin(values), name)
    return c.otherwise("unknown")


def is_backbone(atom_name: Column) -> Column:
    return atom_name.isin(BACKBONE)


def radius(resname: Column, atom_name: Column, element: Column) -> Column:
    """Radius: ions by name; others by element, atom name, its first letter, its letters, their first letter (no ion names)."""
    plain = {k: v for k, v in RADII.items() if k not in IONS}
    letters = F.regexp_replace(atom_name, "[^A-Za-z]", "")
    ion = F.when(atom_name.isin(IONS), lookup(RADII, atom_name))
    keys = [element, atom_name, F.substring(atom_name, 1, 1), letters, F.substring(letters, 1, 1)]
    return F.when(resname.isin(IONS), ion).otherwise(F.coalesce(*[lookup(plain, k) for k in keys]))


def classify(atoms: DataFrame) -> DataFrame:
    """Adds ``cls, backbone, radius, ptm, ptm_code``."""
    kind = {n: k for k, group in MODIFICATIONS.items() for n in group}
    ptm = lookup(kind, F.col("resname"))
    return atoms.withColumns({"cls": atom_class(F.col("resname"), F.col("atom_name")), "backbone": is_backbone(F.col("atom_name")), "radius": radius(F.col("resname"), F.col("atom_name"), F.col("element")), "ptm": F.coalesce(ptm, F.lit("")), "ptm_code": F.coalesce(F.substring(ptm, 1, 1), F.lit("N"))})


def accept(atoms: DataFrame, chains: list[str] | None = None, models: list[int] | None = None, first_model: bool = False) -> DataFrame:
    """Without hydrogens, water and atoms of unknown radius; wanted chains and models only."""
    kept = atoms.filter(~F.col("cls").isin("hydrogen", "water") & F.col("radius").isNotNull())
    kept = kept.filter(F.col("chain").isin(chains)) if chains else kept
    kept = kept.filter(F.col("model").isin(models)) if models else kept
    if first_model:
        kept = kept.withColumn("first_", F.min("model").over(Window.partitionBy("file"))).filter("model = first_").drop("first_")
    return kept


def of_types(df: DataFrame, codes: str) -> DataFrame:
    """Rows whose class letter is wanted: A(mino), D(NA), I(on), U(nknown), O(ther)."""
    return df.filter(F.col("cls").isin([c for c, letter in TYPE_CODES.items() if letter in codes]))


def convert_modified(atoms: DataFrame, mode: str = "C") -> DataFrame:
    """Modified residues to their parents: residue name, class and record type.

    ``mode``: C(onvert) also writes ``SE`` as ``SD`` and drops atoms that the parent lacks, A(ll atoms) keeps all of them as
    they are, N(one) changes nothing.
    """
    if mode == "N":
        return atoms
    parent = lookup(PARENT, F.col("resname"))
    if mode == "C":
        name = F.when(parent.isNotNull() & (F.col("atom_name") == "SE"), "SD").otherwise(F.col("atom_name"))
        expected = F.try_element_at(F.create_map(*[x for k, v in EXPECTED_ATOMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), parent)
        atoms = atoms.filter(parent.isNull() | F.array_contains(expected, name)).withColumn("atom_name", name)
        atoms = atoms.withColumn("element", F.when(parent.isNotNull() & (F.col("element") == "SE"), "S").otherwise(F.col("element")))
    return (
        atoms.withColumn("rec", F.when(parent.isNotNull(), "ATOM").otherwise(F.col("rec")))
        .withColumn("cls", F.when(parent.isNotNull() & (F.col("cls") == "modified"), "amino").otherwise(F.col("cls")))
        .withColumn("resname", F.coalesce(parent, "resname"))
    )


def number_residues(atoms: DataFrame, file: str = "file", order: str = "line_no", parts=("model", "chain", "resnum", "icode")) -> DataFrame:
    """Running residue index ``residx`` per file: new where chain, number or insertion code changes."""
    w = Window.partitionBy(file).orderBy(order)
    change = reduce(lambda a, b: a | b, [~F.col(p).eqNullSafe(F.lag(p).over(w)) for p in parts]) | (F.row_number().over(w) == 1)
    return atoms.withColumn("new_", change.cast("int")).withColumn("residx", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("new_")


def split_locations(atoms: DataFrame) -> DataFrame:
    """Residues with several locations once per location: own atoms and shared ones; adds ``location, primary``."""
    marked = atoms.filter("altloc <> ''").groupBy("file", "residx", F.col("altloc").alias("location")).agg(F.min("line_no").alias("first_"))
    first = marked.groupBy("file", "residx").agg(F.min_by("location", "first_").alias("main_"), F.count(F.lit(1)).alias("n_"))
    several = marked.join(first, ["file", "residx"]).filter("n_ > 1")
    copies = several.select("file", "residx", "location", (F.col("location") == F.col("main_")).alias("primary"))
    split = atoms.join(copies, ["file", "residx"], "left").filter("location is null or altloc = '' or altloc = location")
    return split.withColumn("primary", F.coalesce("primary", F.lit(True))).withColumn("location", F.coalesce("location", F.lit("")))


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue and location of ``number_residues``/``split_locations`` atoms."""
    ca = F.col("atom_name") == "CA"
    letter = F.coalesce(lookup({**AMINO, **NUCLEIC, **{k: AMINO[v] for k, v in PARENT.items()}}, F.first("resname")), F.lit("."))
    g = atoms.groupBy("pdb_id", "file", "model", "residx", "location").agg(
        F.first("chain").alias("chain"), F.first("resnum").alias("resnum"), F.first("icode").alias("icode"), F.first("resname").alias("resname"), F.first("cls").alias("cls"), F.min("rec").alias("rec"),
        letter.alias("aa1"), F.count(F.lit(1)).alias("n_atoms"), F.first("primary").alias("primary"), *[F.max(F.when(ca, F.col(c))).alias(f"ca_{c}") for c in "xyz"], F.avg("b").alias("b_avg"),
        F.count_if(F.col("backbone")).alias("n_backbone"), F.min("line_no").alias("line_no"),
    )
    return g.withColumn("res_id", F.concat_ws(":", "chain", F.concat(F.col("resnum").cast("string"), "icode")))


def nth_residue(res: DataFrame, out: str = "nth") -> DataFrame:
    """Number of each primary amino residue in its chain."""
    kept = res.filter("primary and cls in ('amino', 'modified')")
    return kept.withColumn(out, F.row_number().over(Window.partitionBy("file", "model", "chain").orderBy("residx")))


def neighbours_in_order(df: DataFrame, keys: list[str], order: str, positions: int, out: str) -> DataFrame:
    """The row's own and its next (``positions`` 0 or +1) or previous (-n: n - 1 before) values of ``out``, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    span = w.rowsBetween(positions + 1, 0) if positions < 0 else w.rowsBetween(0, max(1, positions))
    return df.withColumn(f"{out}_near", F.collect_list(out).over(span))


def gap_sequence(res: DataFrame, keys: list[str], number: str = "resnum", letter: str = "aa1", order: str = "residx", gaps: bool = True, initial: bool = False, most: int = 10_000, break_at: Column | None = None) -> DataFrame:
    """Sequence text of each chain: jumps in numbering filled with ``-``, none where ``break_at`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag(number).over(w) + 1, F.lit(1) if initial else F.col(number))
    jump = F.when(before > 0, F.greatest(F.lit(0), F.least(F.col(number) - before, F.lit(most)))).otherwise(0).cast("int")
    jump = F.when(break_at, 0).otherwise(jump) if break_at is not None else jump
    part = F.concat(F.repeat(F.lit("-"), jump) if gaps else F.lit(""), F.col(letter))
    rows = res.withColumn("part_", part).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("part_").alias("p")))).alias("all_"))
    return rows.select(*keys, F.array_join(F.transform("all_", lambda s: s["p"]), "").alias("seq"))


def chain_sequences(res: DataFrame, types: str = "ADI", gaps: bool = False, initial: bool = False) -> DataFrame:
    """Sequences per model and chain of primary residues; no gap around HETATM records or insertion-code changes.

    Residues of other types add no letter but keep the numbering.
    """
    w = Window.partitionBy("file", "model", "chain").orderBy("residx")
    kept = res.filter("primary")
    het, code = F.col("rec") == "HETATM", F.col("icode")
    stop = het | F.coalesce(F.lag(het).over(w), F.lit(False)) | (F.coalesce(F.lag(code).over(w), code) != code)
    wanted = F.col("cls").isin([c for c, letter in TYPE_CODES.items() if letter in types])
    kept = kept.withColumn("stop_", stop).withColumn("aa1", F.when(wanted, F.col("aa1")).otherwise(""))
    return gap_sequence(kept, ["file", "model", "chain"], gaps=gaps, initial=initial, break_at=F.col("stop_"))


def duplicate_chains(sequences: DataFrame, keys: list[str], threshold: float = 80.0) -> DataFrame:
    """Chain pairs of a structure whose letters agree, place by place over the shorter one, to ``threshold`` percent."""
    a, b = sequences.select(*keys, "chain", F.col("seq").alias("s1")), sequences.select(*keys, F.col("chain").alias("other"), F.col("seq").alias("s2"))
    pairs = a.join(b, keys).filter("chain <> other")
    n = F.least(F.length("s1"), F.length("s2"))
    cut = lambda s: F.split(F.substring(F.col(s), F.lit(1), n), "")
    both = F.filter(F.arrays_zip(cut("s1").alias("x"), cut("s2").alias("y")), lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.size(F.filter(both, lambda p: p["x"] == p["y"]))
    pct = F.coalesce(F.try_divide(same * 100.0, F.size(both)), F.lit(0.0))
    return pairs.withColumn("identity", pct).filter(F.col("identity") >= threshold - 1e-5).drop("s1", "s2")


def context_window(df: DataFrame, keys: list[str], order: str, code: str, window: int = 10, mark: str = "*", pad: str = "?") -> DataFrame:
    """``context``: half a window of codes up to each row, a mark, half a window after it, padded."""
    half = (window + 1) // 2
    w = Window.partitionBy(*keys).orderBy(order)
    left, right = F.collect_list(code).over(w.rowsBetween(1 - half, 0)), F.collect_list(code).over(w.rowsBetween(1, half))
    pads = lambda x: F.array_repeat(F.lit(pad), F.lit(half) - F.size(x))
    return df.withColumn("l_", left).withColumn("r_", right).withColumn("context", F.array_join(F.concat(pads(F.col("l_")), F.col("l_"), F.array(F.lit(mark)), F.col("r_"), pads(F.col("r_"))), "")).drop("l_", "r_")


def structure_stats(atoms: DataFrame, key: str = "pdb_id") -> DataFrame:
    """Counts by class, chain and element, locations, models, b range."""
    counted = [F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in ("amino", "modified", "nucleic", "ion", "water", "other", "unknown", "hydrogen")]
    good = ~F.col("cls").isin("water", "hydrogen")
    one = atoms.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_atoms"), *counted, F.count_if(F.col("altloc") != "").alias("n_altloc"), F.countDistinct("model").alias("n_models"), F.countDistinct("chain").alias("n_chains"),
        F.coalesce(F.min(F.when(good, F.col("b"))), F.lit(999.0)).alias("tempf_min"), F.coalesce(F.max(F.when(good, F.col("b"))), F.lit(0.0)).alias("tempf_max"), F.avg(F.when(good, F.col("b"))).alias("tempf_avg"),
    )
    return one.join(count_map(atoms, key, "chain", "atoms_per_chain"), key, "left").join(count_map(atoms, key, "element", "atom_types"), key, "left")


def count_map(df: DataFrame, key: str, by: str, out: str) -> DataFrame:
    """A map of counts by value, in order of the values."""
    n = df.groupBy(key, by).agg(F.count(F.lit(1)).alias("n_"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n_")))).alias(out))


def completeness(res: DataFrame, key: str = "pdb_id") -> DataFrame:
    """Shares of primary amino residues that are incomplete, single atoms, or backbone only."""
    expected = {k: len(v) for k, v in EXPECTED_ATOMS.items()}
    kept = res.filter("primary and cls = 'amino'")
    share = lambda c: F.avg(c.cast("double"))
    return kept.groupBy(key).agg(
        share(F.col("n_atoms") < lookup(expected, F.col("resname"))).alias("incomplete"),
        share(F.col("n_atoms") == 1).alias("single_atom"),
        share((F.col("n_atoms") == F.col("n_backbone")) & (F.col("resname") != "GLY")).alias("backbone_only"),
    )


def quality_gate(areas: DataFrame, ratios: DataFrame, key: str = "pdb_id", sidechain: bool = True, most: float = 0.9) -> DataFrame:
    """In sidechain mode the areas of structures that are mostly backbone become -1; adds ``has_secondary``."""
    joined = areas.join(ratios, key, "left")
    bare = F.lit(sidechain) & (F.col("backbone_only") > most)
    return joined.withColumn("area", F.when(bare, -1.0).otherwise(F.col("area"))).withColumn("has_secondary", ~F.coalesce(F.col("single_atom") > most, F.lit(False))).drop("incomplete", "single_atom", "backbone_only")


def site_secondary(sites: DataFrame, secondary: DataFrame, window: int = 10) -> DataFrame:
    """Secondary-structure context of sites by file, chain and number with insertion code; else ``Unknown``."""
    table = context_window(secondary, ["file", "chain"], "seq", "code", window).select("file", "chain", "resnum", F.col("context").alias("dssp"))
    return sites.join(table, ["file", "chain", "resnum"], "left").withColumn("dssp", F.coalesce("dssp", F.lit("Unknown")))


def site_ranges(df: DataFrame, keys: list[str], value: str, prefix: str, order_by: str | None = None) -> DataFrame:
    """Minimum and maximum over valid (not negative) values, -1 if none; the mean of all, and with an order their list."""
    ok = F.when(F.col(value) >= 0, F.col(value))
    out = [F.coalesce(F.min(ok), F.lit(-1.0)).alias(f"{prefix}_min"), F.coalesce(F.max(ok), F.lit(-1.0)).alias(f"{prefix}_max"), F.avg(value).alias(f"{prefix}_avg")]
    if order_by is not None:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(value).alias("v"))))
        out.append(F.transform(pairs, lambda s: s["v"]).alias(f"{prefix}_vals"))
    return df.groupBy(*keys).agg(*out)


def window_mean(df: DataFrame, keys: list[str], position: str, value: str, width: int) -> DataFrame:
    """Mean of values at positions [p - w/2, p + w/2 + w % 2), by position (not row), for each row."""
    w = Window.partitionBy(*keys).orderBy(position).rangeBetween(-(width // 2), width // 2 + width % 2 - 1)
    return df.withColumn("window_mean", F.avg(value).over(w))


def coverage(evidence: DataFrame) -> DataFrame:
    """One row of counts: secondary structure found, unknown, gapped; assemblies and genes found."""
    d = F.col("dssp")
    return evidence.agg(F.count_if(~d.contains("Unknown") & ~d.contains("?")).alias("dssp_full"), F.count_if(d.contains("Unknown")).alias("dssp_unknown"), F.count_if(d.contains("?")).alias("dssp_gapped"), F.count_if(F.col("assembly").isNotNull()).alias("with_assembly"), F.count_if(F.coalesce("gene", F.lit("-")) != "-").alias("with_gene"), F.count(F.lit(1)).alias("rows"))
