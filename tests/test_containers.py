"""Containers of many small structure files, custom columns, and the cut of assemblies."""

import os
import random

from pyspark.sql import functions as F

from evisite.operators import group as G
from evisite.operators import spatial as X
from evisite.plans import evidence as E
from evisite.sources import structures as R


def test_many_small_files(spark, tmp_path):
    """3000 files go through few tasks into few files; a reader of some names opens few; atoms and rejects come from one pass."""
    folder = tmp_path / "in"
    folder.mkdir()
    atom = "ATOM      1  CA  GLY A   1    %8.3f   2.000   3.000  1.00 10.00           C  "
    for k in range(3000):
        (folder / f"pdb{k:04d}.ent").write_text(f"HEADER x\n{atom % k}\n" + ("ATOM      2  CB  GLY A   1       x.xxx   0.000   0.000\n" if k % 100 == 0 else "") + "END\n")
    (folder / "notes.txt").write_text("no structure")
    conf = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(conf)
    out = str(tmp_path / "out")
    R.pack_files(spark, str(folder), out, glob="pdb*.ent", bytes_=200_000)
    assert spark.conf.get(conf) == before
    stored = spark.read.parquet(out)
    files = [f for f in os.listdir(out) if f.startswith("part-")]
    assert stored.count() == 3000 and 1 < len(files) < 40
    lines = R.container_lines(spark, out)
    rows = R.coordinates(lines)
    assert rows.filter("ok").count() == 3000 and rows.filter("not ok").count() == 30 == R.atom_rejects(lines).count()
    some = R.container_lines(spark, out, ["pdb0007.ent", "pdb0009.ent"])
    assert {(r.file, r.x) for r in R.atoms(some).collect()} == {("pdb0007.ent", 7.0), ("pdb0009.ent", 9.0)}
    assert "PushedFilters: [In(file" in some._jdf.queryExecution().executedPlan().toString()
    spans = [(r.lo, r.hi) for r in stored.groupBy(F.input_file_name()).agg(F.min("file").alias("lo"), F.max("file").alias("hi")).orderBy("lo").collect()]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # each container holds a range of names


def test_custom_columns(spark):
    rows = [("a", {"X": "1", "Y": "p", "gene": "no"}), ("a", {"X": "1", "Y": "q"}), ("b", {"X": "2", " Rank": "no"}), ("b", None), ("c", {}), ("d", {"Z": None})]
    df = spark.createDataFrame(rows, "seq_id string, custom map<string,string>")
    maps, clashes = G.typed_map_group(df, ["seq_id"], "custom", ["Gene", "rank"])
    assert {r.seq_id: r.custom for r in maps.collect()} == {"a": {"X": "1", "Y": None}, "b": {"X": "2"}, "d": {"Z": None}}
    assert sorted(map(tuple, clashes.collect())) == [(" Rank", 1), ("gene", 1)]
    wide = E.with_custom_columns(maps)
    assert wide.columns == ["seq_id", "X", "Y", "Z"] and {(r.seq_id, r.X) for r in wide.collect()} == {("a", "1"), ("b", "2"), ("d", None)}
    assert "gene" in E.TAKEN and "isol_asa_avg" in E.TAKEN


def test_one_scan_for_all_votes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("k", "a", "x", 1, 2.0), ("k", "b", "x", 2, 2.0), ("k", "b", None, 3, None), (None, "c", None, 4, 1.0)], "k string, u string, v string, n int, d double").write.parquet(path)
    for more in ([], [("all", "list", ["u"])]):  # values counted as rows of their own, or gathered beside a list
        spec = [("u", "vote", []), ("v", "vote", []), ("n", "vote", []), ("d", "vote", []), ("m", "avg", ["n"]), *more]
        done = G.typed_group(spark.read.parquet(path), ["k"], spec, order_by="n")
        assert done._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        got = {r.k: (r.u, r.v, r.n, r.d, r.m) for r in done.collect()}
        assert got == {"k": ("b", "x", "1/2/3", "2.0", 2.0), None: ("c", None, "4", "1.0", 4.0)}


def test_prefix_of_long_texts(spark):
    long = "x" * 50_000
    df = spark.createDataFrame([(long + "a", long + "b"), ("abc", "abd"), ("ab", "abc"), ("", "a"), ("q", "q"), ("é1", "é2"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(G.lcp(F.col("a"), F.col("b"))).collect()]
    assert got == [long, "ab", "ab", "", "q", "é", None]


def test_cut_by_cells_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(k, f"p{k % 3}", *[rng.uniform(-60, 60) for _ in range(3)]) for k in range(900)] + [(900 + k, "p0", 15.0 * k, 0.0, 0.0) for k in range(5)]
    sites = [("p0", 0.0, 0.0, 0.0), ("p0", 0.0, 0.0, 0.0), ("p0", 40.0, 10.0, -5.0), ("p1", 5.0, 5.0, 5.0), ("p2", None, 0.0, 0.0), ("p9", 0.0, 0.0, 0.0)]
    p, s = spark.createDataFrame(points, "id int, pdb_id string, x double, y double, z double"), spark.createDataFrame(sites, "pdb_id string, x double, y double, z double")
    want = sorted(k for k, f, *xyz in points if any(g == f and None not in at and sum((a - b) ** 2 for a, b in zip(xyz, at)) <= 900 for g, *at in sites))
    assert sorted(r.id for r in X.within(p, s, ["pdb_id"], 30.0).collect()) == want and 20 < len(want) < 300
