"""Helpers that the training-data operators share: shared-folder tables, fingerprints, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a folder of this machine is; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Spark hand rows to Python in batches of at most ``most`` bytes from now on; a lower limit of the session stays.

    Spark's own limits are 10,000 rows and, since 4.1, 64 MB; workers and the JVM's buffers keep the memory of their largest batch.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(name)).rstrip("bB")) <= most:
        spark.conf.set(name, str(most))


def tidy(work):
    """The function of a Python stage, after which a task gives the memory back that it no longer needs: workers stay for later tasks."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def settle(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    several consumers share one computation.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/evisite-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """While it lasts, Spark hands at most ``rows`` rows at once to Python: less memory for tables with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unsettle(*tables: DataFrame) -> None:
    """Deletes settled tables whose readers are done."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes in a text or binary column (a longer value stands alone): bounded memory in Python."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def own_texts(texts: pa.Array) -> pa.Array:
    """The texts of a slice in buffers of their own, nulls as empty; some Arrow string kernels misread slices."""
    return texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (column names are case-insensitive in Spark)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def low_hash(key, wanted, total) -> F.Column:
    """Whether a 64-bit hash is so low that about four times ``wanted`` of ``total`` rows are: a test before a ranking by hash, so that
    what is ranked doesn't grow with the number of tasks. All rows pass where there are few."""
    share = F.least(F.lit(1.0), 4.0 * wanted / F.greatest(total, F.lit(1)))
    return key.cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)


def text_key(text) -> F.Column:
    """128 bits of SHA-256 of a text, as 16 bytes."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 32))


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of ``x[n]`` and ``y[n]``; on return every node points to the least node of its tree."""
    while len(x):
        a, b = parent[x], parent[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """Connected components of an undirected edge list ``(a, b)``: ``(node, component)``, component = smallest node.

    Alternating large-star and small-star contraction. Each half round is a partial-combined minimum and an equi-join
    whose hot keys Spark can split, so a node with a third of all edges stays spread over tasks. The number of rounds
    grows with the logarithm of the component size; each is written to the shared folder.
    """
    e = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = large.join(low, F.col("a") == F.col("u"))
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        before, e = e, settle(small.distinct())
        unsettle(before)
        # Done when the edges are stars: each node has one parent, and no parent has one.
        twice = e.groupBy("a").count().filter("count > 1").select("a")
        deep = e.select("a").join(e.select("b").distinct(), F.col("a") == F.col("b"), "left_semi")
        if twice.union(deep).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
