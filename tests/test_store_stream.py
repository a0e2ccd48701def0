"""The stored cache, hits that wait for a sequence, and draws of sequences."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from evisite.operators import markers as M
from evisite.operators import pairs as P
from evisite.sources import cache as C
from evisite.streaming.ingest import ingest_hits, release

DAY = datetime.date(2024, 1, 1)
SCHEMA = "hash string, count int, n_results int, results string, inserted date"


def rows_of(df):
    return {r.hash: (r.count_, r.inserted) for r in df.withColumnRenamed("count", "count_").collect()}


def test_stored_cache(spark, tmp_path):
    path, today = str(tmp_path / "store"), F.lit(DAY).cast("date")
    old = [(f"h{k}", 1, 1, "r", DAY) for k in range(400)] + [("h3", 9, 1, "r", DAY - datetime.timedelta(5))]
    C.create(spark.createDataFrame(old, SCHEMA), path, "hash")
    assert len(rows_of(C.read(spark, path))) == 400 and rows_of(C.read(spark, path))["h3"] == (1, DAY)
    asked = spark.createDataFrame([("h7",), ("h9",), ("none",)], "hash string")
    found = C.lookup(path, asked, "hash", today)
    assert rows_of(found) == {"h7": (1, DAY), "h9": (1, DAY)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "prefix" in filters and len(found.inputFiles()) >= 2
    files = {p: set(spark.read.parquet(f"{path}/data").filter(F.col("prefix") == p).inputFiles()) for p in ("00", "7f")}
    before = C.current(spark, path)
    C.upsert(path, spark.createDataFrame([("h7", 5, 1, "new", DAY), ("h8", 5, 1, "older", DAY - datetime.timedelta(1)), ("x", 2, 0, None, DAY)], SCHEMA), "hash")
    after = C.current(spark, path)
    touched = {k for k in after if after[k] != before.get(k)}
    assert len(touched) <= 3 and all(after[k] == before[k] for k in before if k not in touched)
    # A reader that planned before the write still has its files.
    assert rows_of(found) == {"h7": (1, DAY), "h9": (1, DAY)}
    now = rows_of(C.read(spark, path))
    assert now["h7"] == (5, DAY) and now["h8"] == (1, DAY) and now["x"] == (2, DAY) and len(now) == 401 and files
    # Data without a published version, as of a writer that was lost, are not seen.
    C._append(spark.createDataFrame([("lost", 1, 1, "r", DAY)], SCHEMA).withColumn("prefix", C.prefix_of("hash")), path, 77)
    assert "lost" not in rows_of(C.read(spark, path))
    assert C.vacuum(spark, path) == len(touched & set(before)) + 1 and rows_of(C.read(spark, path)) == now
    C.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"), "hash")
    assert C.read(spark, str(tmp_path / "empty")).count() == 0
    listed = spark.createDataFrame(old, SCHEMA)
    assert P.cache_listing(listed, today, "today").count() == 400 and P.cache_listing(listed, today, "entry", entry="h3").count() == 2


def line(q, s):
    return "\t".join([q, s, "99.0", "5", "0", "0", "1", "5", "1", "5", "1e-9", "80.5"])


def test_hits_wait_for_their_sequences(spark, tmp_path):
    """A sequence that comes with the second batch, one that comes without new hits, one that never comes; each hit comes out once."""
    folder, out = tmp_path / "hits", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_text(f">q1\n{line('q1', '1ABC_A')}\n{line('q1', '2XYZ_B')}\n>q2\n{line('q2', '1ABC_A')}\n{line('q2', '9ZZZ_A')}\n")
    queries = {"q1": "ACDEF"}
    chains = {("1ABC", "A"): "XXACDEFXX"}
    tables = lambda: spark.createDataFrame(list(queries.items()), "query_id string, query string"), lambda: spark.createDataFrame([(*k, v) for k, v in chains.items()], "pdb_id string, chain string, target string")
    run = lambda: ingest_hits(spark, str(folder), *tables, out, str(tmp_path / "c")).awaitTermination(180)
    got = lambda: Counter((r.query_id, r.struct_id) for r in spark.read.parquet(out).collect())
    run()
    assert got() == {("q1", "1ABC_A"): 1}
    queries["q2"] = "KLMNP"
    (folder / "b.txt").write_text(f">q1\n{line('q1', '1ABC_A')}\n")
    run()
    assert got() == {("q1", "1ABC_A"): 2, ("q2", "1ABC_A"): 1}
    chains["2XYZ", "B"] = "ACDWF"
    release(spark, *tables, out)
    release(spark, *tables, out)
    (folder / "c.txt").write_text(f">q2\n{line('q2', '2XYZ_B')}\n")
    run()
    assert got() == {("q1", "1ABC_A"): 2, ("q2", "1ABC_A"): 1, ("q1", "2XYZ_B"): 1, ("q2", "2XYZ_B"): 1}


def test_draws_of_sequences(spark):
    """Short and long sequences are drawn alike; places differ; all places come out when more are asked for."""
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("STAC") for _ in range(30 if k % 2 else 3000))) for k in range(40)] + [(90, "S" * 24), (91, "A" * 30), (92, None), (93, "")]
    df = spark.createDataFrame(rows, "id int, seq string")
    got = M.sample_uniform(df, "id", "seq", "ST", n=200).collect()
    text = dict(rows)
    assert len(got) == 200 == len({(r.id, r.poi) for r in got}) and all(text[r.id][r.poi - 1] == r.aa and r.aa in "ST" for r in got)
    odd = sum(r.id % 2 for r in got)
    assert 60 <= odd <= 140 and max(Counter(r.id for r in got).values()) < 16
    assert M.sample_uniform(df, "id", "seq", "ST", n=200).collect() == got
    all_ = M.sample_uniform(df.filter("id in (1, 3, 90)"), "id", "seq", "ST", n=500).collect()
    assert sorted((r.id, r.poi) for r in all_) == sorted((k, p + 1) for k in (1, 3) for p, c in enumerate(text[k]) if c in "ST")
    assert M.sample_uniform(df.limit(0), "id", "seq", "ST", n=5).count() == 0
