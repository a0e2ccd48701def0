"""Incremental hit ingestion: new hit files are parsed, joined to sequences, aligned, scored and appended.

The checkpoint of the stream replaces resume code: files that are done are not read again, and a batch that is repeated
after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisite.functions.scores import identity_score
from evisite.operators.align import align_pairs
from evisite.sources.fasta import parse_hits, stream_records


def score_pairs(pairs: DataFrame, **options) -> DataFrame:
    """Pairs (``query, target`` sequences) with rows and identity score."""
    return align_pairs(pairs, "query", "target", **options).withColumn("align_score", identity_score(F.col("target_row"), F.col("query_row")))


def _replaced(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` in the place of an earlier try and reads it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _appended(score, out: str):
    def append(batch: DataFrame, number: int) -> None:
        _replaced(score(batch), f"{out}/batch={number}")

    return append


class Pending:
    """Hits that wait for a sequence: one table a step, the last of which holds all that still wait.

    A step is a batch of the stream, or a release after it. Step (n, k) reads the last step before it and writes its own, so a batch
    that is repeated after a failure finds what it found before.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def steps(self) -> list[str]:
        """Names of the finished steps in order."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        found = [f.getPath() for f in files.listStatus(where)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(f.getName() for f in found if files.exists(done(f, "_SUCCESS")))

    @staticmethod
    def name(batch: int, release: int = 0) -> str:
        return f"step-{batch:012d}-{release:06d}"

    def before(self, step: str) -> DataFrame:
        earlier = [s for s in self.steps() if s < step]
        if not earlier:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{earlier[-1]}")

    def write(self, waiting: DataFrame, step: str) -> None:
        waiting.write.mode("overwrite").parquet(f"{self.path}/{step}")


def _settle_hits(found: DataFrame, queries: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with both sequences, and those that miss one."""
    both = found.join(queries, "query_id", "left").join(chains, ["pdb_id", "chain"], "left")
    whole = F.col("query").isNotNull() & F.col("target").isNotNull()
    return both.filter(whole), both.filter(~whole).select(*found.columns)


def ingest_hits(spark: SparkSession, folder: str, queries, chains, out: str, checkpoint: str, rejects: str | None = None, obsolete: DataFrame | None = None, pending: str | None = None, files_per_batch: int = 20, **options):
    """A streaming query over a folder of hit tables.

    ``queries``: query_id, query; ``chains``: pdb_id, chain, target (both sequences, one row a key), or functions that give these tables as
    they are when a batch begins. Hits without a sequence on either side wait in ``pending`` (next to ``out`` if not given) and come out
    with the first batch, or ``release``, that finds both; each hit comes out once. Lines that are no hit go to ``rejects``.
    """
    wait = pending or f"{out.rstrip('/')}-pending"

    def append(batch: DataFrame, number: int) -> None:
        good, bad = parse_hits(batch, obsolete)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema.fields)
        step, state = Pending.name(number), Pending(spark, wait, schema)
        waited = state.before(step)
        # The batch's own hits are written first: two outputs read them.
        new = _replaced(good, f"{wait}-new/batch={number}")
        ready, waiting = _settle_hits(waited.unionByName(new), _now(queries), _now(chains))
        score_pairs(ready, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if rejects is not None:
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        state.write(waiting, step)

    stream = stream_records(spark, folder, files_per_batch)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _now(table) -> DataFrame:
    return table() if callable(table) else table


def release(spark: SparkSession, queries, chains, out: str, pending: str | None = None, **options) -> None:
    """Scores the waiting hits whose sequences have come, without new hit files; for times when the stream is not running."""
    wait = pending or f"{out.rstrip('/')}-pending"
    state = Pending(spark, wait, "")
    steps = state.steps()
    if not steps:
        return
    batch, last = (int(x) for x in steps[-1].removeprefix("step-").split("-"))
    waited = spark.read.parquet(f"{wait}/{steps[-1]}")
    ready, waiting = _settle_hits(waited, _now(queries), _now(chains))
    score_pairs(ready, **options).write.mode("overwrite").parquet(f"{out}/batch={batch}r{last + 1}")
    state.write(waiting, Pending.name(batch, last + 1))


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 20, **options):
    """A streaming query over Parquet files of ready pairs."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(_appended(lambda batch: score_pairs(batch, **options), out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
