import math
import os

import pytest
from pyspark.sql import functions as F

from evisite.operators import spatial as X
from evisite.operators import structures as T
from evisite.plans import evidence
from evisite.sources import fasta, sinks
from evisite.sources import structures as R


def atom(serial, name, res, chain, num, x, y, z, rec="ATOM", alt=" ", icode=" ", b=10.0, el=None):
    return f"{rec:6}{serial:5} {(' ' + name if len(name) < 4 else name):4}{alt}{res:>3} {chain}{num:4}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{b:6.2f}          {el or name[0]:>2}  "


HEAD = """HEADER    TRANSFERASE                             12-JAN-11   1ABC
TITLE     STRUCTURE OF A
TITLE    2 THING
COMPND   2 MOLECULE: SOME KINASE;
KEYWDS    ONE, TWO
EXPDTA    X-RAY DIFFRACTION
REMARK   2 RESOLUTION.   12.50 ANGSTROMS.
REMARK   3   R VALUE            (WORKING SET) : 0.186
REMARK   3   FREE R VALUE                     : 0.222
SOURCE   2 ORGANISM_SCIENTIFIC: HOMO SAPIENS;
SOURCE   3 ORGANISM_TAXID: 9606;
REMARK 350 BIOMOLECULE: 1
REMARK 350 APPLY THE FOLLOWING TO CHAINS: A, B
REMARK 350                    AND CHAINS: C
REMARK 350   BIOMT1   1  1.000000  0.000000  0.000000        0.00000
REMARK 350   BIOMT2   1  0.000000  1.000000  0.000000        0.00000
REMARK 350   BIOMT3   1  0.000000  0.000000  1.000000        0.00000
REMARK 350   BIOMT1   2 -1.000000  0.000000  0.000000       10.00000
REMARK 350   BIOMT2   2  0.000000 -1.000000  0.000000       20.00000
REMARK 350   BIOMT3   2  0.000000  0.000000  1.000000       30.00000
REMARK 350 BIOMOLECULE: 2
REMARK 350 APPLY THE FOLLOWING TO CHAINS: B
REMARK 350   BIOMT1   1  1.000000  0.000000  0.000000        0.00000
REMARK 350   BIOMT2   1  0.000000  1.000000  0.000000        0.00000
REMARK 350   BIOMT3   1  0.000000  0.000000  1.000000        0.00000"""

BACK = [("N", 0.0), ("CA", 1.5), ("C", 2.5), ("O", 3.2)]


def residue(out, res, chain, num, x, **more):
    for name, dx in BACK:
        out.append(atom(len(out) + 1, name, res, chain, num, x + dx, 0.3 * num % 2, 0.0, **more))


def structure():
    out = []
    for k, res in enumerate(["TYR", "GLU", "HIS"]):
        residue(out, res, "A", 3 + k, 4.0 * k)
    residue(out, "VAL", "A", 8, 12.0)
    residue(out, "SER", "A", 8, 16.0, icode="A")
    out.append(atom(90, "CB", "SER", "A", 8, 17.0, 1.5, 0.0, alt="A", icode="A"))
    out.append(atom(91, "CB", "SER", "A", 8, 17.0, -1.5, 0.0, alt="B", icode="A"))
    residue(out, "MSE", "A", 9, 20.0, rec="HETATM")
    out.append(atom(95, "SE", "MSE", "A", 9, 22.0, 2.0, 0.0, rec="HETATM", el="SE"))
    out.append(atom(96, "XX", "MSE", "A", 9, 22.0, 3.0, 0.0, rec="HETATM", el="C"))
    for k, res in enumerate(["TYR", "GLU", "HIS"]):
        residue(out, res, "B", 3 + k, 4.0 * k + 60)
    out.append(atom(97, "ZN", "ZN", "B", 201, 61.0, 5.0, 0.0, rec="HETATM", el="ZN"))
    out.append(atom(98, "O", "HOH", "B", 301, 61.0, 9.0, 0.0, rec="HETATM"))
    out.append(atom(99, "H", "TYR", "B", 3, 61.0, 9.0, 0.0))
    return HEAD + "\n" + "\n".join(out) + "\nEND\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pdb")
    (d / "pdb1abc.ent").write_text(structure())
    two = "MODEL        1\n" + atom(1, "CA", "GLY", "A", 1, 0, 0, 0) + "\nENDMDL\nMODEL        2\n" + atom(1, "CA", "GLY", "A", 1, 1, 0, 0) + "\nENDMDL\n"
    (d / "pdb2xyz.ent").write_text(two)
    return str(d)


@pytest.fixture(scope="module")
def atoms(spark, folder):
    return T.classify(R.atoms(R.file_lines(spark, folder, "*.ent"))).cache()


def full(atoms):
    return T.residues(T.split_locations(T.number_residues(T.accept(atoms, first_model=True))))


def test_reading(spark, folder, atoms):
    lines = R.file_lines(spark, folder, "pdb1abc.ent")
    m = R.metadata(lines).first()
    assert (m.title, m.compound, m.header, m.published, m.pdb_code, m.method) == ("STRUCTURE OF A THING".replace(" 2", ""), "SOME KINASE", "Transferase", "12-JAN-11", "1ABC", "X-RAY DIFFRACTION") or m.title == "STRUCTURE OF A THING"
    assert (m.resolution, m.r_free, m.r_value, m.organism_scientific, m.organism_taxid, m.n_biomolecules) == (12.5, 0.222, 0.186, "HOMO SAPIENS", 9606, 2)
    one, two = R.assemblies(lines).orderBy("order_").collect()
    assert (one.num, one.chains, len(one.matrices), one.matrices[1][0]) == (1, ["A", "B", "C"], 2, [-1.0, 0.0, 0.0, 10.0]) and two.chains == ["B"]
    assert {(r.file, r.model): r.n for r in atoms.groupBy("file", "model").agg(F.count("*").alias("n")).collect()} == {("pdb1abc.ent", 0): 43, ("pdb2xyz.ent", 1): 1, ("pdb2xyz.ent", 2): 1}
    r = {(r.resname, r.atom_name): (r.cls, r.radius) for r in atoms.collect()}
    assert r["ZN", "ZN"] == ("ion", 1.39) and r["TYR", "CA"] == ("amino", 1.7) and r["MSE", "SE"] == ("modified", 1.9) and r["HOH", "O"][0] == "water" and r["TYR", "H"][0] == "hydrogen"


def test_sequences(atoms):
    res = full(atoms)
    seq = {(r.file, r.chain): r.seq for r in T.chain_sequences(res, "A", gaps=True, initial=True).collect()}
    assert seq["pdb1abc.ent", "A"] == "--YEH--VSM" and seq["pdb1abc.ent", "B"] == "--YEH" and seq["pdb2xyz.ent", "A"] == "G"
    assert {r.seq for r in T.chain_sequences(res, "A").filter("chain = 'A' and file like '%1abc%'").collect()} == {"YEHVSM"}
    assert {r.chain: r.seq for r in T.chain_sequences(res, "AI").filter("file like '%1abc%'").collect()}["B"] == "YEH."
    both = [r for r in res.filter("resnum = 8 and icode = 'A'").collect()]
    assert sorted((r.location, r.primary, r.n_atoms) for r in both) == [("A", True, 5), ("B", False, 5)]
    dup = T.duplicate_chains(T.chain_sequences(res.filter("file like '%1abc%'"), "A", gaps=True, initial=True), ["file"])
    assert sorted((r.chain, r.other) for r in dup.collect()) == [("A", "B"), ("B", "A")]


def test_modified_residues_and_ratios(atoms):
    c = T.convert_modified(atoms).filter("file like '%1abc%' and resnum = 9").collect()
    assert sorted(r.atom_name for r in c) == ["C", "CA", "N", "O", "SD"] and {r.resname for r in c} == {"MET"} and {r.cls for r in c} == {"amino"}
    whole = T.convert_modified(atoms, "A").filter("file like '%1abc%' and resnum = 9").collect()
    assert sorted(r.atom_name for r in whole) == ["C", "CA", "N", "O", "SE", "XX"] and {(r.resname, r.rec) for r in whole} == {("MET", "ATOM")}
    assert T.convert_modified(atoms, "N") is atoms
    s = {r.pdb_id: r for r in T.structure_stats(atoms).collect()}["1ABC"]
    assert (s.n_ion, s.n_water, s.n_hydrogen, s.n_altloc, s.atoms_per_chain["B"], s.atom_types["ZN"]) == (1, 1, 1, 2, 15, 1)
    ratio = {r.pdb_id: r for r in T.completeness(full(atoms)).collect()}["1ABC"]
    assert ratio.incomplete == 1 and ratio.backbone_only == 7 / 8 and ratio.single_atom == 0


def test_assemblies_and_writing(spark, folder, atoms, tmp_path):
    plan = R.assemblies(R.file_lines(spark, folder, "pdb1abc.ent")).withColumn("pdb_id", F.lit("1ABC"))
    kept = T.accept(atoms).filter("pdb_id = '1ABC'")
    moved = X.assembly_copies(kept, plan)
    n = kept.count()
    assert moved.filter("assembly = 1").count() == 2 * n
    a = moved.filter("copy = 1 and assembly = 1 and resname = 'ZN'").first()
    assert (a.x, a.y, a.z) == (-51.0, 15.0, 30.0)
    site = spark.createDataFrame([("1ABC", 61.0, 5.0, 0.0)], "pdb_id string, x double, y double, z double")
    near = X.assembly_copies(kept, plan, site, most=10, keep=3.0)
    assert 0 < near.count() < 10
    assert {(r.chain, r.assembly) for r in X.first_assembly(spark.createDataFrame([("1ABC", "B"), ("1ABC", "Z")], "pdb_id string, chain string"), plan).collect()} == {("B", 1), ("Z", None)}
    lines = sinks.assembly_lines(moved, chains=["B"], numbers=[1])
    sinks.write_structures(lines, str(tmp_path / "out"), "assembly_id")
    text = open(next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part-"))).read().split("\n")
    assert text[0].startswith("MODEL        1") and text[-2] == "END" and sum(x.startswith("ATOM") for x in text) == 24 and text.count("TER") == 2
    again = kept.filter("resname = 'ZN'").select(sinks.atom_line().alias("line"), F.lit("x1abc.ent").alias("file"), F.lit(0).alias("line_no"))
    back = R.atoms(again).first()
    assert (back.atom_name, back.x, back.chain, back.resnum, back.element) == ("ZN", 61.0, "B", 201, "ZN")


def brute_area(rows, points, probe=1.4):
    out = {}
    for a in rows:
        full_r = a.radius + probe
        sa = asa = 0
        for u in points:
            p = [c + full_r * d for c, d in zip((a.x, a.y, a.z), u)]
            hit = [b.res_id == a.res_id for b in rows if b.atom_id != a.atom_id and math.dist(p, (b.x, b.y, b.z)) < b.radius + probe]
            sa += not any(hit)
            asa += not hit
        scale = 4 * math.pi * full_r**2 / len(points)
        out[a.atom_id] = (scale * sa, scale * asa)
    return out


def test_area_equals_brute_force(atoms):
    own = T.accept(atoms).filter("pdb_id = '1ABC'").withColumns({"atom_id": F.col("line_no"), "res_id": F.concat_ws(":", "chain", "resnum", "icode")})
    points = X.icosahedron_sphere(2)
    got = {r.atom_id: (r.sa, r.asa) for r in X.accessible_area(own, own, ["pdb_id", "model"], points).collect()}
    want = brute_area(own.collect(), points)
    assert got.keys() == want.keys() and all(abs(got[k][i] - want[k][i]) < 1e-6 for k in got for i in (0, 1))
    assert all(0 <= asa <= sa + 1e-9 for sa, asa in got.values())
    both = X.area_contexts(own.filter("chain = 'A'"), {"asym": own, "isol": own.filter("chain = 'A'")}, ["pdb_id", "model"], points)
    r = both.groupBy("atom_id").pivot("context", ["asym", "isol"]).agg(F.first("asa")).collect()
    assert all(x.asym <= x.isol + 1e-9 for x in r)
    rows, totals = X.batch_areas(own, None, points)
    assert rows.filter("area > 100 or area < -1").count() == 0 and totals.first().atoms == len(want)
    assert X.batch_areas(own, own.select("file"), points)[1].count() == 0


def test_spheres_and_neighbours(spark):
    for level in (1, 2, 3):
        pts = X.icosahedron_sphere(level)
        assert len(pts) == 10 * 4 ** (level - 1) + 2 and all(abs(math.hypot(*p) - 1) < 1e-12 for p in pts)
    assert len(X.golden_sphere(50)) == 50
    import random

    rng = random.Random(2)
    pts = [(k, "s", 0, rng.choice("AB"), *(rng.uniform(0, 40) for _ in range(3))) for k in range(300)]
    df = spark.createDataFrame(pts, "site_id int, pdb_id string, model int, chain string, x double, y double, z double")
    got = {r.site_id: r.chains for r in X.chains_in_range(df, df, 5.0).collect()}
    assert got == {a[0]: sorted({b[3] for b in pts if math.dist(a[4:], b[4:]) <= 5.0}) for a in pts}
    twins = spark.createDataFrame([("p", "A", 1, "", "GLY"), ("p", "B", 1, "", "GLY"), ("p", "C", 1, "", "ALA")], "pdb_id string, chain string, resnum int, icode string, resname string")
    assert sorted((r.chain, r.twin) for r in X.twin_residues(twins).collect()) == [("A", "B"), ("B", "A")]


def test_secondary_structure(spark, tmp_path):
    head = "==== title\n  #  RESIDUE AA STRUCTURE BP1 BP2  ACC\n"
    rows = "".join(f"{k:5}{69 + k:5} A {a}  {c}             0\n" for k, (a, c) in enumerate(zip("RKLMN", "HH ES"), 1))
    (tmp_path / "1abc.dssp").write_text(head + rows + "    6        !*             0   0\n    7   80 B G  T             0\n")
    table = R.secondary(R.file_lines(spark, str(tmp_path), "*.dssp"))
    assert [(r.resnum, r.chain, r.code) for r in table.orderBy("seq").collect()] == [("70", "A", "H"), ("71", "A", "H"), ("72", "A", "_"), ("73", "A", "E"), ("74", "A", "S"), ("80", "B", "T")]
    sites = spark.createDataFrame([("1abc.dssp", "A", "71"), ("1abc.dssp", "A", "99")], "file string, chain string, resnum string")
    assert [r.dssp for r in T.site_secondary(sites, table, 6).orderBy("resnum").collect()] == ["?HH*_ES", "Unknown"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("; note\n>sp|A1|x\nAC*D\nEF\n>B2\r\nGG GG\r\n\n>C3\n")
    got = sorted((r.header, r.seq) for r in fasta.sequences(spark, str(tmp_path / "a.fasta")).collect())
    assert got == [("B2", "GGGG"), ("C3", ""), ("sp|A1|x", "AC*DEF")] and fasta.count_records(spark, str(tmp_path / "a.fasta")) == 3
    row = "gn|P1|G\t{}\t99.5\t10\t0\t0\t1\t10\t1\t10\t1e-5\t{}\n"
    (tmp_path / "h.blast").write_text(">gn|P1|G\n" + row.format("gi|1|pdb|2XX3|A", 436) + row.format("4IP7_GG", 90) + "bad\tline\n" + row.format("2XX3_A", 50) + row.format("9OLD_A", 40) + ">gn|P2|H\n")
    hits, rejects = fasta.hits(spark, str(tmp_path / "h.blast"), spark.createDataFrame([("9old",)], "pdb_id string"))
    assert sorted((r.struct_id, r["rank"], r.bitscore, r.evalue) for r in hits.collect()) == [("2XX3_A", 1, 436.0, "1e-5"), ("4IP7_g", 2, 90.0, "1e-5")] and rejects.count() == 1
    (tmp_path / "d.txt").write_text(">E1_Pos3 x\ndisorder_@3: 0.25\n>E1_Pos3\ndisorder_@3: 0.9\n")
    assert [(r.entry_id, r.position, r.disorder) for r in fasta.disorder_results(spark, str(tmp_path / "d.txt")).collect()] == [("E1_Pos3", 3, 0.25)]
    (tmp_path / "s.txt").write_text("# x\n 1 A 0.5\n 2 C 0.75\n")
    assert [(r.position, r.aa, r.score) for r in fasta.disorder_scores(spark, str(tmp_path / "s.txt")).orderBy("position").collect()] == [(1, "A", 0.5), (2, "C", 0.75)]
    (tmp_path / "n.pdb").write_text("REMARK 69  PDBSITE: PDBPOI:SER A 121 ;THR A 122;, KIND: x\nREMARK 69  RUNINFO: DATASERIES:in\nATOM  1\nREMARK 69  RUNINFO: LATE:1\n")
    v = fasta.annotations(spark, str(tmp_path / "n.pdb")).first()["values"]
    assert v == {"PDBPOI": ["SER A 121", "THR A 122"], "KIND": ["x"], "DATASERIES": ["in"], "POIRESIDUE_1": ["SER A 121"], "POIRESIDUE_2": ["THR A 122"]}
    for n in ("f_9.pdb", "f_10.pdb", "f_010.pdb", "g_11.pdb"):
        (tmp_path / n).write_text("x")
    assert [r.series_no for r in fasta.series(fasta.folder(spark, str(tmp_path), "*.pdb"), "f_9.pdb").collect()] == [9, 10]
    sinks.write_fasta(spark.createDataFrame([("h", "A" * 130)], "header string, seq string"), str(tmp_path / "out"))
    assert [len(r.seq) for r in fasta.sequences(spark, str(tmp_path / "out")).collect()] == [130]
    sinks.write_tsv(spark.createDataFrame([("a", [1.5, 2.0])], "k string, v array<double>"), str(tmp_path / "t"))
    assert fasta.tsv(spark, str(tmp_path / "t")).first().v == "1.5,2.0"
    assert sinks.remark_lines(spark.createDataFrame([("p", "a,b", 3)], "pdb_id string, title string, n int"), "pdb_id", {"PDBINFO": ["title", "n"]}).first().line == "REMARK 69  PDBINFO: TITLE:a_b, N:3"


def test_evidence_end_to_end(spark, folder, atoms):
    pois = spark.createDataFrame([("P1_Pos2", "YEHVSM", 2, "G1", "desc"), ("P2_Pos1", "WWWWW", 1, "G2", "none"), ("P3_Pos1", "YEH", 1, "G3", "no hit")], "entry_id string, plain string, poi int, gene string, desc string")
    hits = spark.createDataFrame([("P1_Pos2", "1ABC", "A", 90.0, 99.0, 1), ("P1_Pos2", "1ABC", "B", 80.0, 50.0, 2), ("P2_Pos1", "1ABC", "A", 10.0, 20.0, 1)], "query_id string, pdb_id string, chain string, bitscore double, identity double, rank int")
    lines = R.file_lines(spark, folder, "pdb1*.ent")
    plan = R.assemblies(lines).withColumn("pdb_id", F.lit("1ABC"))
    points = X.icosahedron_sphere(2)
    rows = evidence.evidence(pois, hits, atoms, None, points, align_cutoff=10, assemblies=plan, metadata=R.metadata(lines), dataseries="s1").cache()
    assert rows.columns == evidence.EVIDENCE and len(rows.columns) == 54
    got = {r.poi_chain: r for r in rows.collect()}
    assert set(got) == {"A", "B"} and all(r.seq_id == "P1_Pos2" for r in got.values())
    a = got["A"]
    assert (a.entry, a.pdbaas, a.pdbptm, a.align_score, a.poipos, a.poiseq) == ("P1_Pos2_1", "GLU A   4 ;HIS A   5 ", "N;N", 100, 2, "----YE/HVSM--")
    assert (a.title, a.method, a.resolution, a.r_free, a.organism_taxid, a.all_chains) == ("STRUCTURE OF A THING", "X-RAY DIFFRACTION", 12.5, 0.222, 9606, "A;B")
    assert (a.duplicate_chains, a.proximity_chains, a.tempf_avg, a.tempf_values, a.dssp) == ("B", "None", 10.0, "10.00;10.00", "Unknown")
    # Areas of both residues in the chain alone, with near chains and in the assembly, against brute force.
    kept = T.split_locations(T.number_residues(T.accept(atoms, first_model=True))).filter("pdb_id = '1ABC' and primary").collect()

    def area(occluders, residue):
        own = [o for o in occluders if (o[5], o[6]) == (residue, 0)]
        sa = free = 0
        for x, y, z, r, line, _, _ in own:
            full_r = r + 1.4
            for u in points:
                p = [c + full_r * d for c, d in zip((x, y, z), u)]
                hit = [(o[5], o[6]) == (residue, 0) for o in occluders if (o[4], o[6]) != (line, 0) and sum((s - t) ** 2 for s, t in zip(p, o[:3])) < (o[3] + 1.4) ** 2]
                weight = 4 * math.pi * full_r**2 / len(points)
                sa += 0 if True in hit else weight
                free += 0 if hit else weight
        return 100 * free / sa if sa else 0

    cells = lambda rs, m=None, copy=0: [(*((r.x, r.y, r.z) if m is None else (10 - r.x, 20 - r.y, 30 + r.z)), r.radius, r.line_no, f"{r.chain}:{r.resnum}{r.icode}", copy) for r in rs]
    alone = cells([r for r in kept if r.chain == "A"])
    both = cells(kept) + cells(kept, 1, 1)
    isolated, whole = [area(alone, f"A:{n}") for n in (4, 5)], [area(both, f"A:{n}") for n in (4, 5)]
    assert a.isol_asa_avg == pytest.approx(sum(isolated) / 2) and (a.isol_asa_poi_min, a.isol_asa_poi_max) == (pytest.approx(min(isolated)), pytest.approx(max(isolated)))
    assert a.biol_asa_avg == pytest.approx(sum(whole) / 2) and a.asym_asa_avg == pytest.approx(a.isol_asa_avg)
    delta = max(x - y for x, y in zip(isolated, whole))
    assert a.interface_asa_delta == pytest.approx(delta) and a.interface == ("No" if abs(delta) < 0.1 else "Heteromer")
    done = evidence.report(rows, spark.createDataFrame([("P9", 0.5)], "entry_id string, disorder double"))
    assert len(done.columns) >= 60
    r = done.first()
    assert (r.seq_id, r.n_structures, r.pdb_chains, r.blast_ranks, r.gene, r.entry, r.iupred) == ("P1_Pos2", 2, ["A", "B"], [1, 2], "G1", "P1_Pos2", -1.0)
    assert r.asa_avg == pytest.approx((a.biol_asa_avg + got["B"].biol_asa_avg) / 2) and r.resolutions == [12.5, 12.5]
    over = {r.entry_id: (r.n_hits, r.n_structures, r.best_alignment) for r in evidence.overview(pois, hits, rows).collect()}
    assert over == {"P1_Pos2": (2, 1, 100), "P2_Pos1": (1, 0, None), "P3_Pos1": (0, 0, None)}


def test_streaming(spark, tmp_path):
    from evisite.streaming.ingest import ingest

    for k in range(3):
        spark.createDataFrame([(k, "ACDEF", "XXACDEFXX")], "id int, query string, target string").write.parquet(str(tmp_path / "in" / f"b{k}"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in" / "*"), "id int, query string, target string", str(tmp_path / "out"), str(tmp_path / "ckpt"), files_per_batch=1).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.align_score) for r in got.collect()) == [(0, 100), (1, 100), (2, 100)]


def test_streaming_of_hit_folders(spark, tmp_path):
    from evisite.streaming.ingest import ingest_hits

    line = lambda q, s: "\t".join([q, s, "99.0", "5", "0", "0", "1", "5", "1", "5", "1e-9", "80.5"])
    folder, out, bad = tmp_path / "hits", str(tmp_path / "o"), str(tmp_path / "bad")
    folder.mkdir()
    (folder / "a.txt").write_text(f">q1\n{line('q1', 'gi|1|pdb|1abc|A')}\n{line('q1', '2XYZ_GG')}\nshort line\n>q2\n{line('q2', '1ABC_A')}\n")
    queries = spark.createDataFrame([("q1", "ACDEF"), ("q2", "KLMNP")], "query_id string, query string")
    chains = spark.createDataFrame([("1ABC", "A", "XXACDEFXX"), ("2XYZ", "g", "ACDWF")], "pdb_id string, chain string, target string")
    for k in range(2):
        ingest_hits(spark, str(folder), queries, chains, out, str(tmp_path / "c"), rejects=bad).awaitTermination(120)
        (folder / f"more{k}.txt").write_text(f">q3\n{line('q3', '1ABC_A')}\n>q1\n{line('q1', '1ABC_B')}\n")
    got = {(r.query_id, r.struct_id): (r.rank, r.align_score) for r in spark.read.parquet(out).collect()}
    assert got[("q1", "1ABC_A")] == (1, 100) and got[("q1", "2XYZ_g")][0] == 2 and set(got) == {("q1", "1ABC_A"), ("q1", "2XYZ_g"), ("q2", "1ABC_A")}
    assert [(r.block, r.line) for r in spark.read.parquet(bad).collect()] == [("q1", "short line")]


def test_rejects(spark, tmp_path):
    lines = spark.createDataFrame([("f", 0, atom(1, "CA", "GLY", "A", 1, 0, 0, 0)), ("f", 1, "ATOM      2  CB  GLY A   1       x.xxx   0.000   0.000"), ("f", 2, "REMARK"), ("s", 0, "  #  RESIDUE"), ("s", 1, " 1 short"), ("s", 2, "    1    1 A A  H          ")], "file string, line_no int, line string")
    assert [r.line_no for r in R.atom_rejects(lines).collect()] == [1] and R.atoms(lines).count() == 1
    assert [r.line_no for r in R.secondary_rejects(lines).collect()] == [1] and R.secondary(lines).count() == 1
    (tmp_path / "d.txt").write_text(">a\ndisorder_@3: 0.5\n>b\nnothing\n")
    assert [r.header for r in fasta.disorder_rejects(spark, str(tmp_path / "d.txt")).collect()] == ["b"]
    (tmp_path / "s.txt").write_text("# head\n  1 A  0.5\n\nbroken row\n")
    assert [r.value for r in fasta.score_rejects(spark, str(tmp_path / "s.txt")).collect()] == ["broken row"]


def test_sites_are_located_once_for_each_pair_of_texts(spark, monkeypatch):
    """Scores and residues are measured with the alignment, not for each hit; sites before the fifth letter and after it."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    res = spark.createDataFrame([("f", "f", 0, "A", k, k, "", "ALA", a, "amino", "ATOM", True) for k, a in enumerate(letters)], "pdb_id string, file string, model int, chain string, residx long, resnum int, icode string, resname string, aa1 string, cls string, rec string, primary boolean")
    pois = spark.createDataFrame([(f"e{k}", letters, k) for k in range(1, 20)], "entry_id string, plain string, poi int")
    hits = spark.createDataFrame([(f"e{k}", "f", "A", 90.0 - 50 * (n == 2), n) for k in range(1, 20) for n in (0, 1, 2)], "query_id string, pdb_id string, chain string, bitscore double, rank int")
    seen, made = [], evidence.align.align_pairs
    monkeypatch.setattr(evidence.align, "align_pairs", lambda *a, **b: seen.append(made(*a, **b)) or seen[-1])
    got = sorted((r.row_id, r.spot, r.align_score, r.n_residues) for r in evidence.located(pois, hits, res, 50.0, 70, None, 1).collect())
    assert got == sorted((f"e{k}_{n}", f"f/A/{k}", 100, 20) for k in range(1, 20) for n in (0, 1))
    assert not {"target_row", "query_row"} & set(seen[0].columns)
