"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``), and the memory of Python stages."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, stem: str = "table") -> str:
    """A new place below ``spark.checkpoint.dir``; where that is unset and Spark runs in one process (tests), of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: several readers share one computation, and a lost executor costs a re-read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Spark hand rows to Python in batches of at most ``most`` bytes from now on; a lower limit of the session stays (Spark's own are 10,000 rows and 64 MB)."""
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
