import math
import random

from pyspark.sql import functions as F

from evisite.functions import headers as H
from evisite.functions import scores as S
from evisite.operators import align as A


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_headers(spark):
    full = F.lit("sp|K7EL95_Pos3|QTRT1_HUMAN Queuine thing OS=Homo GN=QTRT1 PE=1")
    assert one(spark, H.accession(full), H.accession(full, with_pos=False), H.gene(full), H.description(full)) == ("K7EL95_Pos3", "K7EL95", "QTRT1", "QTRT1_HUMAN Queuine thing")
    norm = F.lit(">A1_Pos7|POI:7-8|POISEQ:AB/CD|KIND:x|KIND:y")
    assert one(spark, H.accession(norm), H.poi_position(norm), H.custom_values(norm)) == ("A1_Pos7", 7, {"KIND": "y"})
    assert one(spark, H.header_fields(norm).poiseq, H.reserved_keys(F.create_map(F.lit("GENE"), F.lit(1), F.lit("Z"), F.lit(2)))) == ("AB/CD", ["GENE"])
    assert one(spark, H.three_to_one(F.lit("ALAglyXXXTRP")), H.real_chain(F.lit("GG")), H.filename_chain(F.lit("g")), H.real_chain(F.lit("A"))) == ("AGXW", "g", "GG", "A")
    seq = F.lit("ABCDEFGHIJKLMNOPQRST")
    assert one(spark, *H.flanks(seq, F.lit(3)), H.query_window(seq, F.lit(1), 5), H.query_window(seq, F.lit(20), 6), H.align_window(seq, F.lit(2))) == ("---ABC", "DEFGHI", "ABCDEF", "OPQRST", "ABCDEFGHIJ")
    assert one(spark, H.sequence_hash(F.lit("A" * 37)), H.sequence_hash(F.lit("A" * 38)))[0] == "A" * 37
    assert one(spark, H.derangify(F.lit("1, 2,5-7,x")), H.percentage(F.lit(1), F.lit(0)), H.real_sequence_id(F.lit("a:b:12"))) == ([1, 2, 5, 6, 7], 0.0, "a:b")
    assert one(spark, *H.typed_cast(F.lit("x1"), "i"), *H.typed_cast(F.lit(" 4 "), "i")) == (None, True, 4, False)
    assert one(spark, H.entry_key(F.lit("a_Pos1"), F.lit(3)), *H.entry_of(F.lit("a_Pos1_3"))) == ("a_Pos1_3", "a_Pos1", 3)
    names = spark.createDataFrame([("f10.pdb",), ("f9.pdb",), ("f010b.pdb",)], "n string")
    assert [r.n for r in names.orderBy(H.natural_key(F.col("n"))).collect()] == ["f9.pdb", "f10.pdb", "f010b.pdb"]
    nums = spark.createDataFrame([("a", v) for v in (1, 2, 3, 7, 9, 10, 10)], "k string, v int")
    assert H.rangify(nums, ["k"], "v").first().ranges == "1-3,7,9-10"
    assert sorted(r.u for r in H.add_unique(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int"), "k", "o", "u").collect()) == ["a", "a_2", "b"]


def test_scores(spark):
    assert one(spark, S.preferred(F.lit(-1.0), F.lit(0.0), F.lit(3.0)), S.flexibility(F.lit("HSS*T_")), S.flexibility(F.lit("Unknown"))) == (0.0, 80.0, 0.0)
    assert abs(one(spark, S.normal_density(F.lit(1.0), 0, 1))[0] - math.exp(-0.5) / math.sqrt(2 * math.pi)) < 1e-12
    assert one(spark, S.identity_score(F.lit("ACDEF"), F.lit("ACDEF")), S.identity_score(F.lit("AC-EF"), F.lit("ACDEF")), S.identity_score(F.lit("--ACD-"), F.lit("----DE"))) == (100, 60, 50)
    r = spark.range(1).select(S.alignment_stats(F.lit("-ACDE--GH"), F.lit("MAC-EFFGI")).alias("s")).first().s
    assert (r.length, r.first, r.last, r.identity, r.gaps, r.unaligned, r.gap_opens) == (8, 1, 8, 4, 2, 1, 1)
    v, words = one(spark, *S.word_match(F.lit("Heat shock protein 70"), F.lit("shock (protein) 70")))
    assert (v, words) == (1.0, "70,shock")
    rows = spark.createDataFrame([("a", "G", 20.0), ("a", "A", 30.0), ("b", "A", -1.0), ("c", "A", 3.0), ("d", "G", 5.0)], "k string, aa1 string, area double")
    assert {r.k: r.decision for r in S.surface_decision(rows, ["k"]).collect()} == {"a": "Surface", "b": "Buried", "c": "Buried", "d": "Buried"}
    assert {r.k: (r.decision, r.area_avg) for r in S.surface_decision(rows.filter("k = 'd'"), ["k"], sidechain=True).collect()} == {"d": ("Buried", -1.0)}


def plain_local(q, t, table, o, e):
    """The best local affine score, by the plain recursion."""
    low, best = -(10**6), 0
    m = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    u = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    w = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            u[i][j] = max(m[i - 1][j] + o, u[i - 1][j] + e)
            w[i][j] = max(m[i][j - 1] + o, w[i][j - 1] + e)
            m[i][j] = max(0, m[i - 1][j - 1] + table[q[i - 1] + t[j - 1]], u[i][j], w[i][j])
            best = max(best, m[i][j])
    return best


def test_local_alignment(spark):
    import random

    rng, matrix = random.Random(1), A.simple_matrix()
    pairs = [("".join(rng.choice("ACDEF") for _ in range(rng.randint(1, 12))), "".join(rng.choice("ACDEF") for _ in range(rng.randint(1, 40)))) for _ in range(60)]
    df = spark.createDataFrame([*pairs, pairs[0]], "q string, t string")
    got = A.align_pairs(df, "q", "t", matrix, -3, -1).collect()
    assert len(got) == 61
    for r in got:
        assert r.score == plain_local(r.q, r.t, matrix, -3, -1)
        assert r.query_row.replace("-", "") == r.q and r.target_row.replace("-", "") == r.t and len(r.query_row) == len(r.target_row)
        both = [(a, b) for a, b in zip(r.query_row, r.target_row)]
        assert ("-", "-") not in both
    r = A.align_pairs(spark.createDataFrame([("CDEFG", "AACDEFGAA")], "q string, t string"), "q", "t").first()
    assert (r.target_row, r.query_row) == ("AACDEFGAA", "--CDEFG--")


def test_sites(spark):
    s = spark.range(1).select(A.site_in_target(F.lit("AACDEFGAA"), F.lit("--CDEFG--"), F.lit(3)).alias("s"), A.site_in_target(F.lit("AACD-FGAA"), F.lit("--CDEFG--"), F.lit(3)).alias("gap")).first()
    assert (s.s.position, s.s.letter, s.s.context, s.gap) == (4, "E", "AACDE*FGAA-", None)
    assert one(spark, A.surroundings(F.lit("A-CD-EF"), F.lit(4), 3), A.gapless(F.lit("CD"), F.lit("AACDCD")).offset) == ("ACD*EF-", 2)


def test_statistics_of_many_rows_equal_a_plain_walk(spark):
    """Long, short, empty and missing rows side by side, in one step of Python instead of one of an expression for each letter."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("AC-é") for _ in range(n))
    rows = [(k, text(rng.choice([0, 1, 5, 40, 3000])), text(rng.choice([0, 1, 5, 40, 3000]))) for k in range(60)] + [(60, "-" * 9, "A" * 9), (61, None, "AC"), (62, "AC", None)]

    def plain(t, q):
        first, last, same, gaps, opens, held, alone = -1, -1, 0, 0, 0, 0, max(len(t) - len(q), 0)
        for k, (a, b) in enumerate(zip(t, q)):
            if a != "-" and b != "-":
                first, last, same, gaps, opens, held = k if first < 0 else first, k, same + (a == b), gaps + held, opens + (held > 0), 0
            elif a == "-" and b != "-":
                held += first >= 0
            else:
                alone += a != "-"
        return (last - first + 1 if first >= 0 else 0, first, last, same, gaps, alone, opens)

    df = spark.createDataFrame(rows, "k int, t string, q string")
    counted = df.select("k", S.alignment_stats(F.col("t"), F.col("q")).alias("s"))
    assert "lambda" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: tuple(r.s) for r in counted.collect()} == {k: plain(t, q) if t is not None and q is not None else (0, -1, -1, 0, 0, 0, 0) for k, t, q in rows}
