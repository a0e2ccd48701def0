import datetime

import pytest
from pyspark.sql import functions as F

from evisite.operators import group, markers, pairs, search

ROWS = [("e1", 1, "x", 5.0, "alpha_1"), ("e1", 2, "y", -1.0, "alpha_2"), ("e1", 3, "x", 0.0, "alpha_"), ("e2", 1, "y", -2.0, "b"), ("e2", 2, "x", None, "b"), ("e1", 4, None, 3.0, "alpha")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "entry string, rank int, v string, a double, name string")


def test_every_aggregate(rows):
    spec = [
        ("first", "any", ["v"]), ("mean", "avg", ["a"]), ("nonzero", "avg_nozeroes", ["a"]), ("valid", "avg_no_negatives", ["a"]), ("lo", "min", ["a"]), ("hi", "max", ["a"]), ("all", "list", ["v"]),
        ("vote", "vote", ["v"]), ("set", "set", ["v"]), ("n", "count", []), ("d", "delta", ["a"]), ("dn", "delta_no_negatives", ["a"]), ("total", "sum", ["a"]), ("prefix", "matching", ["name"]), ("same", "check_identity", ["name"]), ("later", "special", []),
    ]
    e1, e2 = group.typed_group(rows, ["entry"], spec).orderBy("entry").collect()
    assert (e1["first"], e1["mean"], e1.nonzero, e1.valid, e1.lo, e1.hi, e1["all"], e1.vote, e1.set, e1.n) == ("x", 1.75, 7 / 3, 8 / 3, -1.0, 5.0, ["x", "y", "x"], "x", ["x", "y"], 4)
    assert (e1.d, e1.dn, e1.total, e1.prefix, e1.same, e1.later) == (6.0, 5.0, 7.0, "alpha", None, None)
    assert (e2.vote, e2.valid, e2.dn, e2.nonzero, e2.same, e2.n) == ("x/y", None, 0.0, -2.0, "b", 2)
    with pytest.raises(Exception, match="name differs"):
        group.typed_group(rows, ["entry"], [("same", "check_identity", ["name"])], strict=True).collect()


def test_order_of_rows_does_not_matter(rows):
    spec = [("first", "1st", ["v"]), ("all", "list", ["a"]), ("vote", "vote", ["v"]), ("prefix", "matching", ["name"])]
    one = group.typed_group(rows, ["entry"], spec).orderBy("entry").collect()
    assert one == group.typed_group(rows.orderBy(F.desc("rank")).repartition(3), ["entry"], spec).orderBy("entry").collect()


def test_reports(spark, rows):
    h = {r.bin: (r.n, r.passed) for r in group.histogram(spark.createDataFrame([(0,), (9,), (70,), (100,), (250,), (None,)], "s int"), "s", cutoff=70).collect()}
    assert len(h) == 11 and h[0] == (2, False) and h[7] == (1, True) and h[10] == (2, True)
    r = group.filter_report(spark.createDataFrame([("a", "70"), ("a", "x"), ("b", "10")], "rec string, s string"), "s", 60.0, "rec").first()
    assert (r.passed, r.failed, r.unknown, r.records, r.records_passed) == (1, 1, 1, 2, 1)
    assert group.repeated_ids(rows, "entry").count() == 2
    s = group.summary(spark.createDataFrame([("a",), ("b",)], "entry_id string"), spark.createDataFrame([("a", 61.0)], "entry_id string, bitscore double"), spark.createDataFrame([("a", "1ABC_A", 90, "Buried")], "entry_id string, struct_id string, align_score int, decision string"), 60.0).orderBy("entry_id").collect()
    assert [(x.n_hits, x.best_bitscore, x.bitscore_pass, x.structures) for x in s] == [(1, 61.0, "yes", "1ABC_A"), (0, -1.0, "no", "")]
    custom = spark.createDataFrame([(1, {"A": "x"}), (2, {"B": "y", "id": "z"})], "id int, m map<string,string>")
    assert group.union_of_keys(custom, "m", ["id"]).columns == ["id", "A", "B"]


def test_hits(spark):
    hits = spark.createDataFrame([("q", i, s, b) for i, (s, b) in enumerate([("A", "99"), ("A", "80"), ("B", "x"), ("C", "61"), ("A", "60")], 1)], "q string, line int, s string, bitscore string")
    ranked = pairs.rank_hits(hits, "q", [F.col("line")])
    assert [(r.s, r["rank"]) for r in pairs.dedup_hits(ranked, "q", ["s"]).orderBy("rank").collect()] == [("A", 1), ("B", 3), ("C", 4)]
    assert [r["rank"] for r in pairs.bitscore_filter(ranked, cutoff=61).orderBy("rank").collect()] == [1, 2, 4]
    assert pairs.bitscore_filter(ranked, cutoff=0).count() == 4
    assert [(r.s, r.run) for r in pairs.collapse_limit(hits, ["q"], ["line"], "s", 3).orderBy("line").collect()] == [("A", 1), ("B", 2), ("C", 3)]
    assert pairs.top_k(ranked, ["q"], [F.col("rank")], 2).count() == 2
    scored = spark.createDataFrame([(75,), (70,), (69,), (120,), (None,)], "align_score int")
    assert sorted(r[0] for r in pairs.alignment_filter(scored, cutoff=78).collect()) == [70, 75, 100]
    found, missing = pairs.with_alignments(ranked, ranked.filter("rank = 1").select("q", "rank", F.lit(1).alias("x")), ["q", "rank"])
    assert found.count() == 1 and missing.first().missing == 4


def test_cache(spark):
    day = datetime.date(2024, 1, 1)
    cache = spark.createDataFrame([("a", 10, 3, "r", day), ("b", 5, 5, "r", day), ("c", 5, 0, "", day + datetime.timedelta(80))], "hash string, count int, n_results int, results string, inserted date")
    today = F.lit("2024-02-01").cast("date")
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "hash string")
    assert sorted(r.hash for r in pairs.cache_lookup(q, cache, "hash", today, 60, wanted=8).collect()) == ["a"]
    assert pairs.cache_lookup(q, cache, "hash", today, 20).filter("hash <> 'c'").count() == 0
    new = spark.createDataFrame([("a", 20, 9, "n", day)], cache.schema)
    assert {r.hash: r.results for r in pairs.cache_upsert(cache, new, "hash").collect()} == {"a": "n", "b": "r", "c": ""}
    assert sorted(r.hash for r in pairs.cache_retain(cache, today, older_than=10).collect()) == ["c"]
    assert sorted(r.hash for r in pairs.cache_retain(cache, today, drop_empty=True).collect()) == ["a", "b"]


def test_markers(spark):
    seqs = spark.createDataFrame([(1, ">x|P1|d", "AC*D EF*"), (2, "x|P2|d", "*ACD"), (3, "x|P3|POI:2-3|d", "ACDE"), (4, "x|P4|d", "ACD"), (5, "x|P5|POI:9-10", "ACD"), (6, "x|P1|d", "AC*DEF")], "line int, header string, seq string")
    from evisite.functions.headers import accession

    sites, rejects = markers.normalise(seqs, accession(F.col("header")), "line")
    assert sorted((r.entry_id, r.poi, r.plain, r.poiseq) for r in sites.collect()) == [("P1_Pos2", 2, "ACDEF", "----AC/DEF---"), ("P1_Pos5", 5, "ACDEF", "-ACDEF/------"), ("P3_Pos2", 2, "ACDE", "----AC/DE----")]
    assert sorted((r.acc, r.reason) for r in rejects.collect()) == [("P2", "position outside the sequence"), ("P4", "no marker"), ("P5", "position outside the sequence")]
    long = spark.createDataFrame([("a", "S" * 30), ("b", "SS")], "k string, seq string")
    picked = markers.sample_positions(long, "k", "seq", "S", n=5)
    got = markers.mark_samples(picked, long, "k", "seq").collect()
    assert len(got) == 5 and all(r.marked == "S" * r.poi + "*" + "S" * (30 - r.poi) for r in got)


def test_seed_search_finds_planted_pairs(spark):
    q = spark.createDataFrame([("q1", "MKVLAAGIVGLCAK"), ("q2", "WWWWW")], "q string, qs string")
    t = spark.createDataFrame([("t1", "XXXMKVLAAGIVGLCAKYY"), ("t2", "GIVGLQQQQ"), ("t3", "")], "t string, ts string")
    got = search.seed_search(q, t, "q", "t", "qs", "ts", k=5, least=2).collect()
    assert [(r.q, r.t, r.diagonal, r.seeds) for r in got] == [("q1", "t1", 3, 10)]


def test_sites_move_without_their_texts(spark):
    """The choice among repeated sites sorts and moves places and their letters, not a text for each of its markers."""
    from evisite.functions.headers import accession

    rows = spark.createDataFrame([("sp|P1|v", "MAC*DEF-GH*"), ("sp|P1|w", "MAC*DEFGHIKLM"), ("sp|P2 POI:2-3|x", "AC*DE")], "header string, seq string")
    sites = markers.normalise(rows, accession(F.col("header")), "header")[0].select("entry_id", "poi", "poiseq")
    nodes, names = [sites._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Window":
            names.append({node.output().apply(k).name() for k in range(node.output().size())})
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert len(names) == 1 and not names[0] & {"seq", "plain", "letters_", "ends_"}
    assert sorted((r.poi, r.poiseq) for r in sites.collect()) == [(2, "----AC/DE----"), (3, "---MAC/DEFGH-"), (8, "CDEFGH/------")]
