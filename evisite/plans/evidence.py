"""The whole evidence job: sites, hits, alignments and structures to one row per (site, hit), then per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.functions.headers import align_window, entry_key, flanks
from evisite.functions.scores import identity_score, interface_call, preferred, surface_decision, temperature_score
from evisite.operators import align, pairs, spatial, structures
from evisite.operators.group import summary, typed_group, typed_map_group, union_of_keys
from evisite.tables import settled

CONTEXTS = ("isol", "biol", "asym")  # own chain alone, first assembly with the chain, near chains of the asymmetric unit

#: Columns of the evidence table.
EVIDENCE = [
    "dataseries", "entry", "seq_id", "desc", "gene", "tempf_avg", "tempf_values", "tempf_poi_min", "tempf_poi_max",
    *[f"{c}_asa{part}" for c in CONTEXTS for part in ("", "_avg", "_poi_min", "_poi_max")],
    "poi_chain", "proximity_chains", "duplicate_chains", "interface", "interface_asa_delta", "dssp", "pdbcode", "pdbaas", "pdbptm", "tempf_file_min", "tempf_file_max", "pdbmod", "all_chains",
    "title", "compound", "keywords", "database", "poipos", "poiseq", "pdbseq", "align_score", "rank", "bitscore", "n_residues", "identity",
    "resolution", "r_value", "r_free", "method", "organism_common", "organism_scientific", "organism_taxid", "published",
]

#: Output columns of the grouped report with their aggregates and inputs, in order.
REPORT = [
    ("dataseries", "check_identity", []), ("gene", "any", []), ("desc", "set", []), ("n_structures", "count", []), ("dssp", "list", []), ("interface", "vote", []),
    *[(f"{c}_asa_{name}", op, [f"{c}_asa{col}"]) for c in CONTEXTS for name, op, col in (("decision", "vote", ""), ("avg", "avg_no_negatives", "_avg"))],
    *[(f"{c}_asa_poi_{end}", "list", []) for c in CONTEXTS for end in ("min", "max")],
    *[(f"{c}_asa_poi_delta", "delta_no_negatives", [f"{c}_asa_poi_min", f"{c}_asa_poi_max"]) for c in CONTEXTS],
    ("tempf_poi_avg", "avg_nozeroes", ["tempf_avg"]), ("tempf_poi_vals", "list", ["tempf_avg"]), ("tempf_poi_min", "list", []), ("tempf_poi_max", "list", []), ("tempf_file_min", "list", []), ("tempf_file_max", "list", []),
    ("pdb_files", "list", ["pdbcode"]), ("pdb_chains", "list", ["poi_chain"]), ("pdb_sites", "list", ["pdbaas"]), ("pdb_ptms", "list", ["pdbptm"]), ("blast_ranks", "list", ["rank"]),
    ("entry", "matching", []), ("seq_poipos", "any", ["poipos"]), ("seq_poiseq", "any", ["poiseq"]), ("pdbseq", "list", []), ("alignments", "list", ["align_score"]), ("align_avg", "avg", ["align_score"]),
    ("bitscore_avg", "avg", ["bitscore"]), ("identity_avg", "avg", ["identity"]), ("methods", "list", ["method"]), ("r_free_avg", "avg_nozeroes", ["r_free"]), ("resolutions", "list", ["resolution"]),
    ("organism_scientific", "list", []), ("organism_taxid", "list", []), ("interfaces", "list", ["interface"]), ("interface_asa_deltas", "list", ["interface_asa_delta"]), ("interface_asa_delta_avg", "avg", ["interface_asa_delta"]),
    *[(f"{c}_asa_{name}", "list", [f"{c}_asa{col}"]) for c in CONTEXTS for name, col in (("decisions", ""), ("vals", "_avg"))],
]


#: Names that an attribute of a header can't have.
TAKEN = ["seq_id", *EVIDENCE, *[name for name, _, _ in REPORT], "tempf_score", "asa_avg", "pymol", "pymol_biomol", "iupred", "custom"]


def located(pois: DataFrame, hits: DataFrame, res: DataFrame, bitscore: float, align_cutoff: float, matrix: dict | None, positions: int) -> DataFrame:
    """One row per (site, hit) whose site has a residue in the structure: ``row_id``, ``spot`` (structure, chain, ``nth``)."""
    found = pairs.with_pois(pois, pairs.bitscore_filter(hits.withColumnRenamed("query_id", "entry_id"), cutoff=bitscore))
    chains = structures.chain_sequences(res, "A").join(res.select("file", "pdb_id").distinct(), "file").select("pdb_id", "chain", F.col("seq").alias("chain_seq"))
    windows = found.withColumn("window", align_window(F.col("plain"), F.col("poi"))).join(chains, ["pdb_id", "chain"])
    # Scores and residues are found once for each distinct pair of texts; a window has its site at one of its first five letters.
    residues = lambda t, q: F.array(*[align.site_in_target(t, q, F.lit(k), positions) for k in range(1, 6)])
    aligned = align.align_pairs(windows, "window", "chain_seq", matrix, measures={"align_score": identity_score, "sites_": residues})
    good = pairs.alignment_filter(aligned, cutoff=align_cutoff)
    sited = good.withColumn("site", F.get("sites_", F.least(F.col("poi"), F.lit(5)) - 1)).filter("site is not null")
    sited = sited.withColumns({"nth": F.col("site.position") + 1, "row_id": entry_key(F.col("entry_id"), F.col("rank")), "n_residues": F.length("chain_seq")})
    return sited.withColumn("spot", F.concat_ws("/", "pdb_id", "chain", F.col("nth").cast("string"))).drop("window", "sites_", "chain_seq")


def site_residues(spots: DataFrame, nth: DataFrame, positions: int) -> DataFrame:
    """The residues of each spot in order: its own and the next for a site between two (``positions`` 0), else its last ``positions``."""
    first, last = (F.col("nth"), F.col("nth") + 1) if positions == 0 else (F.col("nth") - (positions - 1), F.col("nth"))
    wanted = spots.select("spot", "pdb_id", "chain", F.explode(F.sequence(first, last)).alias("nth"), F.col("nth").alias("own"))
    columns = ["pdb_id", "chain", "nth", "file", "model", "res_id", "resnum", "icode", "resname", "aa1", "b_avg", "residx", "ca_x", "ca_y", "ca_z"]
    rows = wanted.join(nth.select(*columns), ["pdb_id", "chain", "nth"])
    return rows.withColumn("here", F.max(F.col("nth") == F.col("own")).over(Window.partitionBy("spot"))).filter("here").drop("here")


def areas(at: DataFrame, atoms: DataFrame, near: DataFrame, assemblies: DataFrame | None, points: list, sidechain: bool) -> DataFrame:
    """``spot, res_id, isol, biol, asym``: accessible percent of each site residue in three surroundings; biol null without an assembly."""
    own = atoms.withColumn("res_id", F.concat_ws(":", "chain", F.concat(F.col("resnum").cast("string"), "icode"))).withColumn("atom_id", F.col("line_no"))
    used = own.filter(~F.col("atom_name").isin("N", "C", "O")) if sidechain else own
    targets = used.join(at.select("spot", "pdb_id", "res_id"), ["pdb_id", "res_id"]).join(near, "spot", "left")
    ids = at.select("spot", "res_id").distinct()

    def percent(areas: DataFrame, name: str) -> DataFrame:
        return spatial.residue_percent(areas, ids, ["spot", "res_id"]).withColumnRenamed("area", name)

    isolated = spatial.accessible_area(targets, own, ["pdb_id", "model", "chain"], points, carry=["spot"])
    crystal = spatial.accessible_area(targets, own, ["pdb_id", "model"], points, carry=["spot"], allowed="chains")
    out = percent(isolated, "isol").join(percent(crystal, "asym"), ["spot", "res_id"])
    if assemblies is None:
        return out.withColumn("biol", F.lit(None).cast("double"))
    chosen = spatial.first_assembly(at.select("pdb_id", "chain", "spot").distinct(), assemblies, "order_").filter("assembly is not null").withColumnRenamed("assembly", "order_")
    plan = assemblies.join(chosen.select("pdb_id", "order_").distinct(), ["pdb_id", "order_"], "left_semi").withColumn("num", F.col("order_"))
    sites = at.select("pdb_id", F.col("ca_x").alias("x"), F.col("ca_y").alias("y"), F.col("ca_z").alias("z")).filter("x is not null").distinct()
    copies = spatial.assembly_copies(own, plan, sites)
    name = lambda c: F.concat_ws("/", F.col("copy").cast("string"), F.col(c).cast("string"))
    copies = copies.withColumns({"own_res": F.col("res_id"), "res_id": name("res_id"), "atom_id": name("atom_id")})
    first = copies.filter("copy = 0").join(chosen.withColumnRenamed("order_", "assembly"), ["pdb_id", "chain", "assembly"])
    first = first.join(at.select("spot", F.col("res_id").alias("own_res")), ["spot", "own_res"])
    first = first.filter(~F.col("atom_name").isin("N", "C", "O")) if sidechain else first
    whole = spatial.accessible_area(first, copies, ["pdb_id", "assembly", "model"], points, carry=["spot"])
    whole = percent(whole.withColumn("res_id", F.substring_index("res_id", "/", -1)), "biol")
    whole = whole.join(chosen.select("spot"), "spot", "left_semi")
    return out.join(whole, ["spot", "res_id"], "left")


def evidence(
    pois: DataFrame, hits: DataFrame, atoms: DataFrame, secondary: DataFrame | None, points: list, bitscore: float = 50.0, align_cutoff: float = 70, matrix: dict | None = None,
    assemblies: DataFrame | None = None, metadata: DataFrame | None = None, positions: int = 0, sidechain: bool = False, dataseries: str = "",
) -> DataFrame:
    """The columns of ``EVIDENCE``, one row per (site, hit) whose site has a residue in the structure.

    ``pois``: entry_id, plain, poi, gene, desc, and where headers have attributes of their own ``custom`` (a map), which is carried
    along; ``hits``: query_id, pdb_id, chain, rank, bitscore, identity; ``assemblies`` and
    ``metadata``: as read from the structure files. ``positions``: 0 for a site between two residues, else the number of
    residues that end at the site. Cheap filters come before the alignment; structures are cut to those that hits name before
    areas are computed, and areas to the residues of sites.
    """
    code = F.upper(F.regexp_extract("file", r"([0-9A-Za-z]{4})\.[^.]*$", 1))
    kinds = structures.classify(atoms).join(hits.select("pdb_id").distinct(), "pdb_id", "left_semi")
    numbered = structures.split_locations(structures.number_residues(structures.accept(kinds, first_model=True)))
    wanted = settled(numbered.filter("primary"))
    res = settled(structures.residues(wanted))
    nth = structures.nth_residue(res)
    sites = settled(located(pois, hits, res, bitscore, align_cutoff, matrix, positions))
    at = settled(site_residues(sites.select("spot", "pdb_id", "chain", "nth").distinct(), nth, positions))
    spots = at.groupBy("spot").agg(F.first("pdb_id").alias("pdb_id"), F.first("chain").alias("poi_chain"))
    alpha = {f"ca_{c}": c for c in "xyz"}
    near = spatial.chains_in_range(at.withColumnsRenamed(alpha).withColumnRenamed("spot", "site_id"), res.withColumnsRenamed(alpha)).withColumnRenamed("site_id", "spot")
    near = settled(spots.join(near, "spot", "left").select("spot", F.array_sort(F.array_union(F.coalesce("chains", F.array().cast("array<string>")), F.array("poi_chain"))).alias("chains")))
    # Areas, with structures that are mostly backbone taken out in sidechain mode.
    ratios = structures.completeness(res)
    ranged = settled(areas(at, wanted, near, assemblies, points, sidechain).join(at.select("spot", "res_id", "pdb_id", "aa1"), ["spot", "res_id"]))
    out = spots
    for c in CONTEXTS:
        gated = structures.quality_gate(ranged.filter(F.col(c).isNotNull()).withColumn("area", F.col(c)), ratios, sidechain=sidechain)
        ends = structures.site_ranges(gated, ["spot"], "area", f"{c}_asa_poi").drop(f"{c}_asa_poi_avg")
        decided = surface_decision(gated, ["spot"], sidechain=sidechain).withColumnsRenamed({"decision": f"{c}_asa", "area_avg": f"{c}_asa_avg"})
        out = out.join(decided, "spot", "left").join(ends, "spot", "left")
        out = out.withColumn(f"{c}_asa", F.coalesce(f"{c}_asa", F.lit("None"))).withColumns({k: F.coalesce(k, F.lit(-1.0)) for k in (f"{c}_asa_avg", f"{c}_asa_poi_min", f"{c}_asa_poi_max")})
    # Interface: chains near the site against copies of its chain.
    same = structures.duplicate_chains(structures.chain_sequences(res, "A").join(res.select("file", "pdb_id").distinct(), "file"), ["pdb_id", "model"])
    twins = same.groupBy("pdb_id", F.col("chain").alias("poi_chain")).agg(F.array_sort(F.collect_set("other")).alias("chains"))
    twins = settled(spots.join(twins, ["pdb_id", "poi_chain"], "left").select("spot", F.coalesce("chains", F.array().cast("array<string>")).alias("chains")))
    valid = lambda c: F.when(F.col(c) >= 0, F.col(c))
    loss = ranged.select("spot", "res_id", valid("isol").alias("isolated"), valid("biol").alias("assembly"), valid("asym").alias("asymmetric"))
    called = interface_call(loss, ["spot"], "res_id", near, twins).select("spot", "interface", F.coalesce("delta", F.lit(0.0)).alias("interface_asa_delta"))
    told = lambda c: F.array_join(c, ";")
    chains = near.join(twins.withColumnRenamed("chains", "twins"), "spot").join(spots.select("spot", "poi_chain"), "spot")
    others = F.array_remove("chains", F.col("poi_chain"))
    chains = chains.select("spot", F.when(F.size(others) > 0, told(others)).otherwise("None").alias("proximity_chains"), F.when(F.size("twins") > 0, told("twins")).otherwise("None").alias("duplicate_chains"))
    # Residues and temperature factors of the site.
    modified = structures.lookup({n: k[0] for k, group in structures.MODIFICATIONS.items() for n in group}, F.col("resname"))
    place = F.concat(F.rpad("resname", 3, " "), F.lit(" "), "chain", F.lpad(F.concat(F.col("resnum").cast("string"), F.when(F.col("icode") == "", " ").otherwise(F.col("icode"))), 5, " "))
    listed = F.array_sort(F.collect_list(F.struct("nth", place.alias("aa"), F.coalesce(modified, F.lit("N")).alias("ptm"), F.col("b_avg").alias("b"))))  # as many as a site has residues
    heat = at.groupBy("spot").agg(F.avg("b_avg").alias("tempf_avg"), F.min("b_avg").alias("tempf_poi_min"), F.max("b_avg").alias("tempf_poi_max"), listed.alias("l_"))
    heat = heat.withColumns({"tempf_values": told(F.transform("l_", lambda s: F.format_string("%.2f", s["b"]))), "pdbaas": told(F.transform("l_", lambda s: s["aa"])), "pdbptm": told(F.transform("l_", lambda s: s["ptm"]))}).drop("l_")
    out = out.join(called, "spot").join(chains, "spot").join(heat, "spot")
    # Secondary structure of the site's own residue, structure statistics and headers.
    stats = structures.structure_stats(kinds)
    stats = stats.select("pdb_id", F.col("tempf_min").alias("tempf_file_min"), F.col("tempf_max").alias("tempf_file_max"), F.col("n_modified").alias("pdbmod"), told(F.map_keys("atoms_per_chain")).alias("all_chains"))
    out = out.join(stats, "pdb_id").join(ratios.select("pdb_id", "single_atom"), "pdb_id", "left")
    first = at.filter("nth = own").select("spot", F.col("pdb_id").alias("file"), "chain", F.concat(F.col("resnum").cast("string"), "icode").alias("resnum"))
    coded = first.withColumn("dssp", F.lit("Unknown")) if secondary is None else structures.site_secondary(first, secondary.withColumn("file", code))
    out = out.join(coded.select("spot", "dssp"), "spot").withColumn("dssp", F.when(F.col("single_atom") > 0.9, "Unknown").otherwise(F.col("dssp")))
    texts = ["title", "compound", "keywords", "method", "organism_common", "organism_scientific", "published"]
    kind = {c: "string" for c in texts} | {"resolution": "double", "r_value": "double", "r_free": "double", "organism_taxid": "int"}
    if metadata is None:
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in kind.items()})
    else:
        out = out.join(metadata.select(code.alias("pdb_id"), *kind), "pdb_id", "left")
    left, right = flanks(F.col("plain"), F.col("poi"))
    rows = sites.drop("pdb_id").join(out, "spot")
    return rows.withColumns({
        "dataseries": F.lit(dataseries), "entry": F.col("row_id"), "seq_id": F.col("entry_id"), "pdbcode": F.col("pdb_id"), "database": F.lit("PDB"),
        "poipos": F.col("poi"), "poiseq": F.concat(left, F.lit("/"), right), "pdbseq": F.col("site.context"),
    }).select(*EVIDENCE, *(["custom"] if "custom" in pois.columns else []))


def report(rows: DataFrame, disorder: DataFrame | None = None) -> DataFrame:
    """Evidence rows to one row per site (``seq_id``), with the preferred area, the temperature score and disorder (-1: none).

    A ``custom`` map is grouped name by name: a value where all rows of a site agree on it. Names of report columns stay out
    (``custom_clashes`` lists them); ``with_custom_columns`` makes columns of the rest.
    """
    scored = rows.groupBy("seq_id").agg(temperature_score(F.col("tempf_avg"), F.col("tempf_file_min"), F.col("tempf_file_max")).alias("tempf_score"))
    grouped = typed_group(rows, ["seq_id"], REPORT, order_by=["rank"]).join(scored, "seq_id")
    best = preferred(*[F.col(f"{c}_asa_avg") for c in CONTEXTS])
    place = F.concat_ws(":", F.get("pdb_files", F.lit(0)), F.get("pdb_chains", F.lit(0)))  # what a viewer opens
    assembled = F.get("biol_asa_vals", F.lit(0)) >= 0
    grouped = grouped.withColumns({"asa_avg": best, "pymol": place, "pymol_biomol": F.when(assembled, place)})
    if disorder is None:
        grouped = grouped.withColumn("iupred", F.lit(-1.0))
    else:
        grouped = pairs.with_disorder(grouped, disorder.withColumnsRenamed({"entry_id": "seq_id", "disorder": "iupred"}), "seq_id", "iupred")
    if "custom" not in rows.columns:
        return grouped
    maps, _ = typed_map_group(rows, ["seq_id"], "custom", TAKEN)
    return grouped.join(maps, "seq_id", "left")


def custom_clashes(rows: DataFrame) -> DataFrame:
    """``name, n``: attributes of evidence rows that are named like a report column, with the number of their rows."""
    return typed_map_group(rows, ["seq_id"], "custom", TAKEN)[1]


def with_custom_columns(table: DataFrame) -> DataFrame:
    """A report or evidence table, for a sink, with a column for every name in its ``custom`` map."""
    return union_of_keys(table, "custom", [c for c in table.columns if c != "custom"])


def overview(pois: DataFrame, hits: DataFrame, rows: DataFrame, cutoff: float | None = None) -> DataFrame:
    """One summary row per site, those without hits or evidence included."""
    found = rows.select(F.col("seq_id").alias("entry_id"), F.col("pdbcode").alias("struct_id"), "align_score", F.col("isol_asa").alias("decision"))
    return summary(pois.select("entry_id"), hits.withColumnRenamed("query_id", "entry_id"), found, cutoff)
