"""A result cache that is stored: Parquet files in partitions of a key's digest, and a table of each partition's current version.

``columns`` is an empty table with the store's columns. ``data/prefix=ab/version=3`` holds the rows of one partition as one upsert left them; ``current`` gets one small file an upsert, after
its data are complete, so a reader sees all of it or nothing, and files that a reader has open are never changed. One job writes at
a time. ``vacuum`` deletes the versions that are no longer current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisite.operators.pairs import cache_lookup, cache_upsert



def prefix_of(key: str, width: int = 2) -> Column:
    return F.substring(F.md5(F.col(key).cast("string")), 1, width)


def _append(rows: DataFrame, path: str, version: int) -> None:
    wide = rows.withColumn("version", F.lit(version)).hint("rebalance", "prefix")  # large partitions in several files
    wide.write.mode("append").partitionBy("prefix", "version").parquet(f"{path}/data")


def _publish(spark: SparkSession, path: str, prefixes: list[str], version: int) -> None:
    rows = spark.createDataFrame([(p, version) for p in prefixes], "prefix string, version int")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/current")


def current(spark: SparkSession, path: str) -> dict[str, int]:
    """The current version of each partition."""
    rows = spark.read.schema("prefix string, version int").parquet(f"{path}/current").groupBy("prefix").agg(F.max("version").alias("version"))
    return {r.prefix: r.version for r in rows.collect()}


def create(cache: DataFrame, path: str, key: str, width: int = 2) -> None:
    """A new store of ``cache``; later upserts bring the same columns. Of repeated keys the newest row stays (``inserted``).

    ``width``: hexadecimal digits of a partition, so 16 ** width partitions; an upsert of a few keys writes about as many of them.
    """
    spark = cache.sparkSession
    layout = [F.col(c).alias(c, metadata={"width": width}) if c == key else F.col(c) for c in cache.columns]
    cache.limit(0).select(*layout).coalesce(1).write.parquet(f"{path}/columns")
    _append(cache_upsert(cache.limit(0), cache, key).withColumn("prefix", prefix_of(key, width)), path, 0)
    data = spark.read.schema(_layout(spark, path)[0]).option("basePath", f"{path}/data").parquet(f"{path}/data")
    _publish(spark, path, [r.prefix for r in data.select("prefix").distinct().collect()], 0)


def read(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """The rows of the store, or of some of its partitions; only their files are read."""
    held = current(spark, path)
    wanted = sorted(held) if prefixes is None else sorted(set(prefixes) & set(held))
    data = spark.read.option("basePath", f"{path}/data").schema(_layout(spark, path)[0]).parquet(f"{path}/data")
    by_version: dict[int, list[str]] = {}
    for p in wanted:
        by_version.setdefault(held[p], []).append(p)
    test = F.lit(False)
    for version, some in by_version.items():
        test = test | ((F.col("version") == version) & F.col("prefix").isin(some))
    return data.filter(test).drop("prefix", "version")


def _layout(spark: SparkSession, path: str) -> tuple[str, int]:
    """Columns of the data (the partition columns are text and number whatever they look like), and digits of a partition."""
    fields = spark.read.parquet(f"{path}/columns").schema.fields
    width = next(f.metadata["width"] for f in fields if "width" in f.metadata)
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["prefix string", "version int"]), width


def upsert(path: str, new: DataFrame, key: str) -> None:
    """Newest row of each key; only the partitions that ``new`` touches are written again."""
    spark = new.sparkSession
    prefix = prefix_of(key, _layout(spark, path)[1])
    touched = [r.p for r in new.select(prefix.alias("p")).distinct().collect()]  # at most as many as partitions
    if not touched:
        return
    version = max(current(spark, path).values(), default=-1) + 1
    merged = cache_upsert(read(spark, path, touched), new, key)
    _append(merged.withColumn("prefix", prefix), path, version)
    _publish(spark, path, touched, version)


def lookup(path: str, queries: DataFrame, key: str, today: Column, max_days: int = 60, wanted: int = -1) -> DataFrame:
    """Cached results of ``queries`` that are fresh and sufficient; partitions without a query are not read."""
    spark = queries.sparkSession
    prefix = prefix_of(key, _layout(spark, path)[1])
    prefixes = [r.p for r in queries.select(prefix.alias("p")).distinct().collect()]  # at most as many as partitions
    return cache_lookup(queries, read(spark, path, prefixes), key, today, max_days, wanted)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the files of versions that are not current; for times without readers. Returns the number of folders deleted."""
    held, gone = current(spark, path), 0
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in files.listStatus(where):
        name = part.getPath().getName()
        for one in files.listStatus(part.getPath()) if name.startswith("prefix=") else ():
            if one.getPath().getName() != f"version={held.get(name[7:], -1)}":
                gone += bool(files.delete(one.getPath(), True))
    return gone
