"""Operator 1: sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest first, to the least-loaded shard through a
heap. Groups of one size are interchangeable to the heap, so it works on *runs*: groups of exactly one size, split
further by hash where there are more than ``run_rows`` of them (or a 50,000th of all groups, if that is more). The runs come
to the driver in descending order, ``STEP`` at a time; it keeps the load of each shard only, gives each run a quota of groups
per shard and writes the quotas to the shared folder. The groups find their shard by their place in the run. Shards then
differ by little more than the smallest groups, unless one group alone is larger than a fair share (it still stays whole).

Cases: a null text has no bytes, size 8 and checksum 0; null-text rows are kept together only by equal id. The empty
text is a text. An empty table gives an empty result. Repeated rows are rows of their own in one group. Of
shards with equal loads the lowest number takes the next run. Of a text, however long, only its size and digests travel. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import settle, text_key

ROW_BYTES = 8
STEP = 200_000  # runs on the driver at once
QUOTAS = "bytes long, run long, ends array<long>, shards array<int>"


def deal(runs: list[tuple[int, int]], n_shards: int, loads: list | None = None) -> list[list[tuple[int, int]]]:
    """LPT quotas. ``runs``: (size of one group, groups), largest first; returns for each run its (shard, groups) pairs.

    ``loads``: the heap of (load, shard) that earlier runs left; it is changed.

    The greedy rule for ``n`` equal items is taken in bulk: every shard below the water level gets the items that fit
    under it, then a heap deals the few that remain.
    """
    heap = [(0, k) for k in range(n_shards)] if loads is None else loads
    out = []
    for size, n in runs:
        quota: dict[int, int] = {}
        if n > 4 * n_shards:
            low, high = heap[0][0], heap[0][0] + size * n
            for _ in range(60):
                level = (low + high) / 2
                fits = sum(int((level - load) // size) for load, _ in heap if load < level)
                low, high = (level, high) if fits <= n else (low, level)
            fitted = []
            for load, k in heap:
                got = int((low - load) // size) if load < low else 0
                if got:
                    quota[k] = got
                fitted.append((load + got * size, k))
            heap[:] = fitted
            heapq.heapify(heap)
            n -= sum(quota.values())
        for _ in range(n):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            quota[k] = quota.get(k, 0) + 1
        out.append(sorted(quota.items()))
    return out


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", run_rows: int = 100_000, slot_rows: int = 200_000) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; slots count from 0 without gaps in each shard."""
    spark = docs.sparkSession
    text = F.col(text_col)
    alone = F.unhex(F.md5(F.concat(F.lit("null:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(text_key(text), alone).alias("key"),
        )
    )
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")))
    total = groups.agg(F.count("*"), F.sum("copies")).first()
    most = max(run_rows, (total[0] or 0) // 50_000)
    sizes = groups.groupBy("bytes").agg(F.ceil(F.count("*") / most).alias("runs"))
    groups = groups.join(sizes, "bytes").withColumn("run", F.pmod(F.xxhash64("key"), F.col("runs")))
    runs = groups.groupBy("bytes", "run").agg(F.count("*").alias("n")).orderBy(F.desc("bytes"), "run")
    found, loads, tables = runs.toLocalIterator(), [(0, k) for k in range(n_shards)], []
    while some := list(itertools.islice(found, STEP)):
        table = []
        for r, quota in zip(some, deal([(r[0], r[2]) for r in some], n_shards, loads)):
            table.append((r[0], r[1], list(itertools.accumulate(n for _, n in quota)), [k for k, _ in quota]))
        tables.append(spark.createDataFrame(table, QUOTAS))
        tables[-1] = settle(tables[-1]) if len(some) == STEP else tables[-1]
    dealt = functools.reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], QUOTAS)
    place = F.row_number().over(Window.partitionBy("bytes", "run").orderBy("key")) - 1
    groups = groups.withColumn("place", place).join(dealt, ["bytes", "run"])
    to = F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("place"))) + 1).alias("shard")
    buckets = max(16, (total[1] or 0) // (slot_rows * n_shards))
    homed = settle(rows.join(groups.select("key", to), "key").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets))))
    sums = homed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key"))
    placed = homed.withColumn("inside", inside).join(before, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
