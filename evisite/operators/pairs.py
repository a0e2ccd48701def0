"""Hits and pairs: ranking, filters, joins and the rules of the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """The first row of each key by an order (a top-1 window, limited before the shuffle by Spark)."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("k_", k).filter("k_ = 1").drop("k_")


def rank_hits(df: DataFrame, query: str, order_by: list, out: str = "rank") -> DataFrame:
    """Rank of hits in their query's order, given before any filter."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(query).orderBy(*order_by)))


def dedup_hits(df: DataFrame, query: str, subject: list[str], rank: str = "rank") -> DataFrame:
    """The first hit of each structure chain; ranks stay."""
    return first_of(df, [query, *subject], [F.col(rank)])


def top_k(df: DataFrame, keys: list[str], order_by: list, k: int) -> DataFrame:
    """At most ``k`` rows of each key; 0 means 999."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("k_", n).filter(F.col("k_") <= (k or 999)).drop("k_")


def collapse_limit(df: DataFrame, keys: list[str], order_by: list, value: str, k: int) -> DataFrame:
    """Runs of equal consecutive values collapsed to their first row, then ``k`` rows; adds ``run``."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("change_", change)
    marked = marked.withColumn("run", F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter((F.col("change_") == 1) & (F.col("run") <= k)).drop("change_")


def bitscore_filter(df: DataFrame, score: str = "bitscore", cutoff: float = 60.0) -> DataFrame:
    """Hits at or above the cutoff; below 0.0001 the test is off, and only non-numeric scores go."""
    v = F.col(score).try_cast("double") if dict(df.dtypes)[score] == "string" else F.col(score)
    return df.filter(v.isNotNull() & (v >= (cutoff if cutoff >= 1e-4 else float("-inf"))))


def alignment_filter(df: DataFrame, score: str = "align_score", cutoff: float = 70) -> DataFrame:
    """Pairs whose alignment score, at most 100, reaches the cutoff rounded down to tens; no score: dropped."""
    scored = df.filter(F.col(score).isNotNull())  # least() would skip nulls
    return scored.withColumn(score, F.least(F.col(score), F.lit(100))).filter(F.col(score) >= int(cutoff // 10 * 10))


def no_gap_at(target: str, column: Column, positions: int = 0) -> Column:
    """Whether the target row has letters at an alignment column (and the next, for a site between two residues)."""
    ok = F.substring(F.col(target), column, F.lit(1)) != "-"
    return ok & (F.substring(F.col(target), column + 1, F.lit(1)) != "-") if positions == 0 else ok


def with_pois(pois: DataFrame, hits: DataFrame, key: str = "entry_id") -> DataFrame:
    """Sites with their hits by entry; sites without hits stay out."""
    return pois.join(hits, key)


def without_obsolete(hits: DataFrame, obsolete: DataFrame, key: str = "pdb_id") -> DataFrame:
    return hits.join(obsolete.select(key).distinct(), key, "left_anti")


def with_alignments(pairs: DataFrame, alignments: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs with their alignments, and the count of pairs without."""
    joined = pairs.join(alignments.withColumn("found_", F.lit(True)), keys, "left")
    return joined.filter("found_").drop("found_"), joined.agg(F.count_if(F.col("found_").isNull()).alias("missing"))


def with_genes(evidence: DataFrame, genes: DataFrame, key: str, unknown: str = "-") -> DataFrame:
    """Left join to the gene dimension; unknown genes by name."""
    return evidence.join(genes, key, "left").withColumn("gene", F.coalesce("gene", F.lit(unknown)))


def with_disorder(grouped: DataFrame, disorder: DataFrame, key: str, col: str = "disorder") -> DataFrame:
    """Left join to disorder scores, -1 where there is none."""
    return grouped.join(disorder, key, "left").withColumn(col, F.coalesce(col, F.lit(-1.0)))


def only_new(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that earlier output doesn't hold."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def missing_ids(all_ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Set difference of ids."""
    return all_ids.select(key).subtract(found.select(key))


def union_results(new: DataFrame, skipped: DataFrame) -> DataFrame:
    return new.unionByName(skipped, allowMissingColumns=True)


def chain_sets(a: Column, b: Column) -> Column:
    """struct(both, either, touch) of two chain arrays."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("both"), F.array_sort(F.array_union(a, b)).alias("either"), F.arrays_overlap(a, b).alias("touch"))


def distinct_queries(queries: DataFrame, seq: str, search) -> DataFrame:
    """Runs ``search`` once per distinct sequence and joins its results back to all queries."""
    return queries.join(search(queries.select(seq).distinct()), seq)


def cache_lookup(queries: DataFrame, cache: DataFrame, key: str, today: Column, max_days: int = 60, wanted: int = -1) -> DataFrame:
    """Cached results that are fresh (``inserted``) and sufficient: the entry holds as many results as wanted.

    ``cache``: key, count (the limit it was searched with), n_results, results, inserted.
    """
    fresh = F.datediff(today, F.col("inserted")) <= max_days
    enough = F.lit(True) if wanted < 0 else (F.col("count") >= wanted) | (F.col("n_results") >= wanted)
    return queries.join(cache, key).filter(fresh & enough)


def cache_upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Newest row of each key; of equal dates the new one."""
    both = cache.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return first_of(both, [key], [F.col("inserted").desc(), F.col("new_").desc()]).drop("new_")


def cache_retain(cache: DataFrame, today: Column, older_than: int | None = None, newer_than: int | None = None, drop_empty: bool = False) -> DataFrame:
    """Deletes entries older or newer than a number of days, or empty ones."""
    age, keep = F.datediff(today, F.col("inserted")), F.lit(True)
    if older_than is not None:
        keep = keep & (age <= older_than)
    if newer_than is not None:
        keep = keep & (age >= newer_than)
    if drop_empty:
        keep = keep & (F.coalesce(F.col("n_results"), F.lit(0)) > 0)
    return cache.filter(keep)


def cache_listing(cache: DataFrame, today: Column, kind: str, days: int = 60, key: str = "hash", entry=None) -> DataFrame:
    """``old`` entries beyond a number of days, those of ``today``, or one ``entry`` by its key."""
    age = F.datediff(today, F.col("inserted"))
    tests = {"old": age > days, "today": age == 0, "entry": F.col(key) == F.lit(entry)}
    return cache.filter(tests[kind])


def keyword_lines(lines: DataFrame, words: DataFrame, key: str, text: str, word: str = "word", length: int = 4) -> DataFrame:
    """The ids and words of lines that hold a word of a list, each once; words have ``length`` letters."""
    tokens = lines.select(key, F.explode(F.array_distinct(F.split(text, r"[^A-Za-z0-9]+"))).alias(word)).filter(F.length(word) == length)
    return tokens.join(words.select(word).distinct(), word, "left_semi").select(key, word).distinct()
