"""Typed group-by: one named aggregate for each output column, as plain aggregate expressions.

``typed_group(df, keys, spec, order_by)`` builds a single ``groupBy().agg()``; Spark combines partial results before
the shuffle for all but the list-valued aggregates, whose output is the list itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-5


def _rank(order_by) -> Column:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    return F.struct(*[F.col(n) for n in names])


def _ordered(value: Column, order_by) -> Column:
    """All values in rank order, duplicates kept, nulls as empty text dropped."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(_rank(order_by).alias("r"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def lcp(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts, in time that grows with their length; null where one is."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y) & (x != ""))
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(same, F.lit(False))
    return F.substring(a, F.lit(1), F.when(differs > 0, F.least(differs.cast("int") - 1, n)).otherwise(n))


def aggregate(op: str, cols: list[str], order_by="rank", strict: bool = False) -> Column:
    """The expression of one named aggregate.

    any/1st, avg, avg_nozeroes (none: 0), avg_no_negatives (none: null), min, max, list, set, count, delta,
    delta_no_negatives (none: 0), sum, matching (common prefix without trailing blanks and underscores),
    check_identity (the value; null, or an error if ``strict``, where values differ), special (null). ``vote`` needs
    a count by value and is handled by ``typed_group``.
    """
    v = F.col(cols[0]) if cols else None
    if op in ("any", "1st"):
        return F.min_by(v, _rank(order_by))
    if op == "avg":
        return F.avg(v)
    if op == "avg_nozeroes":
        return F.coalesce(F.avg(F.when(F.abs(v) >= EPS, v)), F.lit(0.0))
    if op == "avg_no_negatives":
        return F.avg(F.when(v >= 0, v))
    if op in ("min", "max", "sum"):
        return getattr(F, op)(v)
    if op == "list":
        return _ordered(v, order_by)
    if op == "set":
        return F.array_sort(F.collect_set(v))
    if op == "count":
        return F.count(F.lit(1))
    if op in ("delta", "delta_no_negatives"):
        used = [F.when(F.col(c) >= 0, F.col(c)) if op == "delta_no_negatives" else F.col(c) for c in cols]
        high, low = [F.max(u) for u in used], [F.min(u) for u in used]
        width = F.greatest(*high) - F.least(*low) if len(cols) > 1 else high[0] - low[0]
        return F.coalesce(width, F.lit(0.0)) if op == "delta_no_negatives" else width
    if op == "matching":
        return F.regexp_replace(lcp(F.min(v), F.max(v)), r"[ _]+$", "")
    if op == "check_identity":
        differs = F.lit(None) if not strict else F.raise_error(F.concat(F.lit(f"{cols[0]} differs: "), F.min(v).cast("string"), F.lit(" / "), F.max(v).cast("string")))
        return F.when(F.min(v).eqNullSafe(F.max(v)), F.min(v)).otherwise(differs)
    if op == "special":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown aggregate {op!r}")


def _winners(counted: Column, top: Column, sep: str) -> Column:
    """Of structs ``(n, v)`` the values of the count ``top``, sorted and joined."""
    return F.array_join(F.array_sort(F.transform(F.filter(counted, lambda s: s["n"] == top), lambda s: s["v"])), sep)


def _most_frequent(values: Column, sep: str = "/") -> Column:
    """The most frequent of collected values, ties sorted and joined, in one pass over them in order; null where there are none."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"), none.alias("won"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(v == s["last"], s["run"] + 1).otherwise(1)
        won = F.when(run > s["top"], F.array(v)).when(run == s["top"], F.array_append(s["won"], v)).otherwise(s["won"])
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(run, s["top"]).alias("top"), won.alias("won"))

    return F.when(F.size(values) > 0, F.aggregate(F.array_sort(values), start, step, lambda s: F.array_join(s["won"], sep)))


def _of(n: int):
    return lambda s: s["at"] == n


def vote(df: DataFrame, keys: list[str], col: str, out: str, sep: str = "/") -> DataFrame:
    """The most frequent value of each group; ties sorted and joined. Counts combine before the shuffle."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n_"))
    best = counted.groupBy(*keys).agg(F.max("n_").alias("top_"), F.collect_list(F.struct(F.col("n_").alias("n"), F.col(col).cast("string").alias("v"))).alias("all_"))
    return best.select(*keys, _winners(F.col("all_"), F.col("top_"), sep).alias(out))


def typed_group(df: DataFrame, keys: list[str], spec: list[tuple[str, str, list[str]]], order_by="rank", strict: bool = False) -> DataFrame:
    """``spec``: (output column, aggregate, input columns); the output is in this order after the keys.

    The input is read once. Where columns are voted on beside lists, which gather a group's values anyway, the values of the voted
    columns are gathered too. Without lists groups may be of any size: each row becomes itself and a (number of the column, value)
    row for each vote; the first group-by counts the values beside the other aggregates, the second picks the winners of a group.
    """
    plain = [aggregate(op, cols or [out], order_by, strict).alias(out) for out, op, cols in spec if op != "vote"]
    votes = {out: (cols or [out])[0] for out, op, cols in spec if op == "vote"}
    names = [out for out, _, _ in spec]
    if not votes:
        return df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("n_")])).select(*keys, *names)
    cast = {out: F.col(col).cast("string") for out, col in votes.items()}
    if any(op == "list" for _, op, _ in spec):
        gathered = df.groupBy(*keys).agg(*plain, *[F.collect_list(v).alias(out) for out, v in cast.items()])
        return gathered.withColumns({out: _most_frequent(F.col(out)) for out in votes}).select(*keys, *names)
    ballots = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(n).alias("at"), v.alias("v")) for n, v in enumerate(cast.values())])
    rest = [c for c in df.columns if c not in keys]
    rows = df.withColumn("b_", F.explode(F.filter(ballots, lambda b: (b["at"] < 0) | b["v"].isNotNull())))
    only = F.col("b_.at") < 0  # the others carry their value alone
    rows = rows.select(*keys, F.col("b_.at").alias("at_"), F.col("b_.v").alias("v_"), *[F.when(only, F.col(c)).alias(c) for c in rest])
    counted = rows.groupBy(*keys, "at_", "v_").agg(F.count(F.lit(1)).alias("n_"), *plain)
    own, vote_no = F.col("at_") < 0, {out: n for n, out in enumerate(votes)}
    best = counted.groupBy(*keys).agg(
        F.collect_list(F.when(~own, F.struct(F.col("at_").alias("at"), F.col("n_").alias("n"), F.col("v_").alias("v")))).alias("b_"),  # the different values of a group
        *[F.any_value(F.when(own, F.col(out)), ignoreNulls=True).alias(out) for out in names if out not in votes],
    )
    for out, n in vote_no.items():
        mine = F.filter("b_", _of(n))
        top = F.array_max(F.transform(mine, lambda s: s["n"]))
        best = best.withColumn(out, F.when(F.size(mine) > 0, _winners(mine, top, "/")))
    return best.select(*keys, *names)


def typed_map_group(df: DataFrame, keys: list[str], map_col: str, reserved: list[str], out: str = "custom") -> tuple[DataFrame, DataFrame]:
    """The values of a map column grouped like a column each, and the names that can't be one.

    ``keys, out``: of every name the value, where all rows of a group that have the name agree on it, else null. Names that
    differ from a ``reserved`` one by case at most stay out; the second table has them with the number of their rows (``name, n``).
    """
    entries = df.select(*keys, F.explode(map_col).alias("name", "value"))
    taken = F.lower(F.trim("name")).isin([c.lower() for c in reserved])
    one = entries.filter(~taken).groupBy(*keys, "name").agg(aggregate("check_identity", ["value"]).alias("value"))
    maps = one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(out))  # as many as a group has names
    return maps, entries.filter(taken).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def union_of_keys(df: DataFrame, map_col: str, keep: list[str], most: int = 1000) -> DataFrame:
    """Projects every key of a map column to a column of its own, over all rows; names in ``keep`` win.

    More than ``most`` distinct keys are an error: a table can't have so many columns.
    """
    keys = [r.k for r in df.select(F.explode(F.map_keys(map_col)).alias("k")).distinct().orderBy("k").limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} distinct keys in {map_col}")
    extra = [F.try_element_at(map_col, F.lit(k)).alias(k) for k in keys if k.lower() not in {c.lower() for c in keep}]
    return df.select(*keep, *extra)


def histogram(df: DataFrame, score: str, bins: int = 11, width: float = 10, cutoff: float | None = None) -> DataFrame:
    """``bin, n, passed``: all bins, the last open; scores above it are clamped."""
    at = F.least(F.floor(F.col(score) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    passed = F.lit(None).cast("boolean") if cutoff is None else F.col("bin") * width >= cutoff
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), passed.alias("passed"))


def filter_report(df: DataFrame, score: str, cutoff: float, record: str) -> DataFrame:
    """One row: passed, failed and unknown rows with percentages, records, and records with a pass."""
    v = F.col(score).try_cast("double") if dict(df.dtypes)[score] == "string" else F.col(score)
    ok = v >= cutoff
    one = df.groupBy(record).agg(F.count_if(ok).alias("p"), F.count_if(v < cutoff).alias("f"), F.count_if(v.isNull()).alias("u"))
    total = F.sum(F.col("p") + F.col("f") + F.col("u"))
    share = lambda c: F.coalesce(F.try_divide(F.sum(c) * 100.0, total), F.lit(0.0))
    return one.agg(
        F.sum("p").alias("passed"), F.sum("f").alias("failed"), F.sum("u").alias("unknown"),
        share("p").alias("passed_pct"), share("f").alias("failed_pct"), share("u").alias("unknown_pct"),
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("p") > 0).alias("records_passed"),
    )


def summary(sequences: DataFrame, hits: DataFrame, evidence: DataFrame, cutoff: float | None, key: str = "entry_id") -> DataFrame:
    """One row per sequence: hits, best score, pass flag, structures, best alignment, decisions, list of structures.

    Both sides are aggregated before the left joins; sequences without hits stay.
    """
    h = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.max("bitscore").alias("best_bitscore"))
    e = evidence.groupBy(key).agg(F.max("align_score").alias("best_alignment"), F.array_join(F.array_sort(F.collect_set("decision")), "/").alias("accessible"), F.array_sort(F.collect_set("struct_id")).alias("ids_"))
    e = e.withColumns({"n_structures": F.size("ids_").cast("long"), "structures": F.array_join("ids_", ",")}).drop("ids_")
    passed = F.lit("n/a") if cutoff is None else F.when(F.col("best_bitscore") >= cutoff, "yes").otherwise("no")
    joined = sequences.join(h, key, "left").join(e, key, "left")
    return joined.select(
        *sequences.columns, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("best_bitscore", F.lit(-1.0)).alias("best_bitscore"), passed.alias("bitscore_pass"),
        F.coalesce("n_structures", F.lit(0)).alias("n_structures"), F.col("best_alignment"), F.coalesce("accessible", F.lit("")).alias("accessible"), F.coalesce("structures", F.lit("")).alias("structures"),
    )


def repeated_ids(df: DataFrame, col: str) -> DataFrame:
    """The ids that occur more than once, with their counts."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def composition(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(col, "n", (F.col("n") * 100.0 / total).alias("pct"))
