"""Operator 6: mixing sources to target weights by capped water-filling, DataFrame functions only.

Sources get word targets in proportion to their weights. A target stops at ``max_epochs`` times the source's size and
the excess is shared again by weight, round by round, until no target is above its cap. A source with target ``t`` and
size ``s`` then gives ``floor(t / s)`` whole repetitions of every document, and the rest from a seeded order of its
documents: whole documents until the remaining words are used up, of which the last one is taken in part. So a source's
taken words are its target rounded to a whole word.

Scale: texts are read once for their word counts. What follows works on narrow rows; prefix sums run over hash buckets
of bounded size, so a source that holds a third of all rows is spread over tasks.

Cases: a null text has size 0 and takes 0. A null source is a source of its own, last in order. A source without words
has target 0. An empty table gives an empty result. Repeated rows count each on their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisite.llm.common import fresh, settle

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordinals(sources: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the 0-based place in code-point order of ``source``, null last; one pass over range partitions."""
    ranged = settle(
        sources.withColumn("last", F.col("source").isNull())
        .repartitionByRange(F.col("last"), F.col("source"))
        .withColumn("part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    return ranged.withColumn("inside", inside).join(before, "part").withColumn("ordinal", F.col("inside") - 1 + F.col("before")).drop("part", "inside", "before", "last")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, weight)`` to the same with ``target`` double.

    Each round clamps the sources whose share is above their cap; only three sums go to the driver. A round clamps at
    least one more source or is the last.
    """
    caps = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        row = caps.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("held"),
            F.sum(F.when(over, F.lit(0)).otherwise(F.col("weight"))).alias("weights"),
            F.sum(over.cast("long")).alias("clamped"),
        ).first()
        if row.total is None or not row.weights or row.clamped == clamped:
            break
        level, clamped = (row.total - row.held) / row.weights, row.clamped
    filled = F.lit(0.0) if level is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return caps.withColumn("target", filled).drop("cap")


def mix(
    docs: DataFrame,
    weights=(1, 2, 3),
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, epochs, whole, part, taken``.

    ``whole`` is the number of whole repetitions and ``part`` the words of a further one (0 to ``size``).
    """
    text = F.col(text_col)
    sized = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash")))
    by_source = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    pick = F.lit(weights[-1])
    for k, w in list(enumerate(weights))[-2::-1]:
        pick = F.when(F.col("ordinal") % len(weights) == k, F.lit(w)).otherwise(pick)
    plan = water_fill(_ordinals(by_source).withColumn("weight", pick), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = settle(
        plan.withColumn("epochs", epochs)
        .withColumn("base", F.floor("epochs").cast("long"))
        .withColumn("rest", F.round(F.col("target")).cast("long") - F.col("base") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("rows") / rows_per_bucket).cast("long") * 16)
    )
    # The seeded order: a digest of the id; its first 7 hex digits choose the bucket, buckets follow each other.
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    placed = (
        sized.withColumn("u", order)
        .alias("d")
        .join(plan.select("source", "source_size", "target", "epochs", "base", "rest", "buckets").alias("p"), same)
        .select("d.*", "source_size", "target", "epochs", "base", "rest", "buckets")
        .withColumn("bucket", F.floor(F.conv(F.substring("u", 1, 7), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 28)).cast("long"))
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = sums.withColumn("ahead", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    same = F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.bucket") == F.col("a.bucket"))
    placed = placed.alias("d").join(ahead.alias("a"), same).select("d.*", "a.ahead", "a.words")
    # Whole buckets before the end of the rest are taken, those after it are not; one bucket a source needs its order.
    at_end = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("words") > F.col("rest"))
    clear = placed.filter(~at_end).withColumn("part", F.when(F.col("ahead") < F.col("rest"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter(at_end).withColumn("gone", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("gone"))).cast("long")).drop("gone")
    done = clear.unionByName(edge)
    whole = F.when(F.col("size") > 0, F.col("base") + (F.col("part") == F.col("size")).cast("long")).otherwise(0).cast("long").alias("whole")
    part = F.when(F.col("part") == F.col("size"), F.lit(0).cast("long")).otherwise(F.col("part")).alias("part")
    taken = (F.col("base") * F.col("size") + F.col("part")).alias("taken")
    return done.select("doc_id", "source", "size", "source_size", "target", "epochs", whole, part, taken, "text_hash")


def repeat(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as they are taken, a repetition in part cut to its words.

    Same columns as ``docs``. Equal rows (id and text) are counted together.
    """
    names = docs.columns
    key, first, copies = (fresh(docs, n) for n in ("text_hash", "first", "copies"))
    mix_id, mix_hash, whole, part = (fresh(docs, n) for n in ("mix_id", "mix_hash", "mix_whole", "mix_part"))
    plan = mix(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    plan = plan.groupBy(F.col("doc_id").alias(mix_id), F.col("text_hash").alias(mix_hash)).agg(F.sum("whole").alias(whole), F.sum("part").alias(part))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    order = Window.partitionBy(id_col, key).orderBy(F.col(source_col))
    keyed = keyed.withColumn(first, F.row_number().over(order)).filter(F.col(first) == 1)
    taken = plan.filter((F.col(whole) > 0) | (F.col(part) > 0))
    rows = keyed.join(taken, F.col(id_col).eqNullSafe(F.col(mix_id)) & (F.col(key) == F.col(mix_hash)))
    times = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col(whole).cast("int")), F.when(F.col(part) > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn(copies, F.explode(times))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col(copies) < 0, F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(copies), F.lit(1)).cast("int")), " "))
    return rows.withColumn(text_col, cut).select(*names)
