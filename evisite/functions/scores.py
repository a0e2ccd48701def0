"""Scores and decisions as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDED = [  # words that say nothing about a molecule (fixed values)
    "protein", "proteins", "subunit", "fragment", "isoform", "molecule", "chain", "domain", "family", "mutant", "factor", "and", "of", "the", "a",
    "with", "in", "wild", "type", "human", "mouse", "rabbit", "bovine", "cow", "yeast", "drosophila", "melanogaster", "xenopus", "laevis", "rattus",
    "norvegicus", "gallus",
]


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def preferred(*values: Column) -> Column:
    """The first value that is not negative."""
    return F.coalesce(*[F.when(v >= 0, v) for v in values])


def temperature_score(value: Column, low: Column, high: Column) -> Column:
    """Aggregate: mean of 100 (v - min) / (max - min) over usable rows, -1 if none."""
    ok = (low >= 1e-4) & (high >= 1e-4) & (high - low >= 1e-4)
    return F.coalesce(F.avg(F.when(ok, (value - low) * 100.0 / (high - low))), F.lit(-1.0))


def flexibility(codes: Column) -> Column:
    """Share of unordered letters in a secondary-structure window with its site mark, in percent."""
    n = F.length(codes) - 1
    loose = F.length(F.regexp_replace(codes, "[^S_?T]", ""))
    return F.when(codes.contains("Unknown"), 0.0).when(n == 0, 100.0).otherwise(loose * 100.0 / n)


def combined_score(area: Column, temperature: Column, sequence: Column, structure: Column) -> Column:
    """Weights 0.3, 0.1, 0.3, 0.3; parts from 0 to 100, the result from 0 to 1."""
    return (clamp(area * 2.5, 0, 100) * 0.3 + temperature * 0.1 + sequence * 0.3 + structure * 0.3) / 100.0


def normal_density(x: Column, mean: float, dev: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * dev * dev)) / (dev * math.sqrt(2 * math.pi))


def older_score(area: Column, temperature: Column, cleavage: Column, bitscore: Column, align: Column) -> Column:
    """The earlier combined score: ramps and parabolas per part."""
    t = clamp((1 - (temperature - 50) * (temperature - 50) / 900.0) * 100.0, 0, 100)
    a = clamp((area / 12.0 - 1.5) * 100.0, 0, 100)
    c = clamp((3.0 * cleavage * cleavage - cleavage) * 100.0, 0, 100)
    b = clamp(bitscore / 5.0, 0, 100)
    al = clamp((align / 30.0 - 7.0 / 3.0) * 100.0, 0, 100)
    return a * 0.3 + t * 0.3 + c * 0.25 + b * 0.1 + al * 0.05


def word_match(left: Column, right: Column) -> tuple[Column, Column]:
    """Agreement of two descriptions from 0 to 1, and the common words.

    Order-independent: a common word of two letters or more counts 1, a letter 0.5, a number by its size; a word of
    letters and digits whose letters are the initials of the other text counts 0.8.
    """
    words = lambda t: F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(t), "[-/]", " "), "[()]", ""), " "), lambda w: w != "")
    a, b = words(left), words(right)
    initials = lambda w: F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")
    stems = lambda w: F.filter(F.transform(w, lambda x: F.regexp_extract(x, r"^([a-z]{3,})\d+", 1)), lambda x: x != "")
    acronym = F.exists(stems(a), lambda s: F.instr(initials(b), s) > 0) | F.exists(stems(b), lambda s: F.instr(initials(a), s) > 0)
    common = F.array_sort(F.array_except(F.array_intersect(a, b), F.array(*map(F.lit, EXCLUDED))))

    def worth(w: Column) -> Column:
        n = w.try_cast("double")
        number = F.when(n < 5, 0.1).when(n < 10.1, 0.4).when(n < 20.1, 0.6).otherwise(1.0)
        return F.when(w.rlike(r"^\d+$"), number).when(F.length(w) < 2, 0.5).otherwise(1.0)

    total = F.aggregate(common, F.when(acronym, 0.8).otherwise(0.0), lambda s, w: s + worth(w))
    return clamp(total, 0, 1), F.array_join(common, ",")


def reliability(words: Column, align: Column, bitscore: Column, same_species: Column, identity: Column, resolution: Column, codes: Column) -> Column:
    """0 to 1 from description, alignment, hit score, identity and resolution; halved without secondary structure."""
    same = F.when(same_species | (identity > 79.99999), 1.0).otherwise(0.0)
    res = F.when(resolution < 1e-4, 0.5).otherwise(clamp(-0.5 * resolution + 2, 0, 1))
    total = words * 0.2 + clamp(align / 100.0, 0, 1) * 0.2 + clamp(bitscore / 500.0, 0, 1) * 0.2 + same * 0.1 + res * 0.3
    return F.when(codes.contains("Unknown"), total / 2).otherwise(total)


def identity_score(target: Column, query: Column) -> Column:
    """Identities over query letters in percent, less 100/length for each inner gap of either row, 0 at least."""
    letters = F.length(F.regexp_replace(query, "-", ""))
    start = F.length(query) - F.length(F.ltrim(query, F.lit("-")))
    end = F.length(F.rtrim(query, F.lit("-"))) - 1  # the last letter's column, left out of the gap count
    inner = lambda t: F.substring(t, start + 1, end - start)
    used = lambda t: F.split(F.substring(t, start + 1, end - start + 1), "")
    gaps = F.length(F.regexp_replace(F.concat(inner(query), inner(target)), "[^-]", ""))
    same = F.aggregate(F.zip_with(used(query), used(target), lambda q, t: ((q == t) & (q != "-") & (q != "")).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    score = F.round(same * 100.0 / letters - gaps * 100.0 / letters)
    return F.when(letters == 0, 0).otherwise(F.greatest(F.lit(0), score).cast("int"))


STATS = "length int, first int, last int, identity int, gaps int, unaligned int, gap_opens int"
LETTERS = 2_000_000  # letters of both rows counted at once


def alignment_stats(target: Column, query: Column) -> Column:
    """struct(length, first, last, identity, gaps, unaligned, gap_opens) of two gapped rows (columns from 0).

    Many pairs of rows are counted at once, letter by letter in flat arrays. A missing row has no columns.
    """
    return F.pandas_udf(_stats, STATS)(target, query)


def _some_stats(targets: list[str], queries: list[str]) -> np.ndarray:
    """The numbers of ``alignment_stats``, a row for each pair."""
    sizes = np.array([[len(t), len(q)] for t, q in zip(targets, queries)], np.int64).reshape(-1, 2)
    n = sizes.min(axis=1)
    flat = lambda rows: np.frombuffer("".join([r[:k] for r, k in zip(rows, n)]).encode("utf-32-le", "surrogatepass"), np.uint32)
    t, q, gap = flat(targets), flat(queries), ord("-")
    ends = np.cumsum(n)
    starts = ends - n
    row = np.repeat(np.arange(len(n)), n)
    totals = lambda marks: np.bincount(row[marks], minlength=len(n))
    both = (t != gap) & (q != gap)
    at = np.flatnonzero(both)
    n_both = totals(both)
    some, after = n_both > 0, np.cumsum(n_both)
    first, last = np.full(len(n), -1), np.full(len(n), -1)
    first[some] = at[(after - n_both)[some]] - starts[some]
    last[some] = at[after[some] - 1] - starts[some]
    # Columns of the query alone between two of letters in both: their number before each of these, less that before the one ahead.
    holes = np.concatenate([[0], np.cumsum((t == gap) & (q != gap))])[at]
    held = np.diff(holes, prepend=0)
    held[(after - n_both)[some]] = 0
    sums = lambda x: np.bincount(row[at], x, len(n)).astype(np.int64)
    unaligned = totals((t != gap) & (q == gap)) + np.maximum(sizes[:, 0] - sizes[:, 1], 0)
    return np.stack([np.where(some, last - first + 1, 0), first, last, totals(both & (t == q)), sums(held), unaligned, sums(held > 0)], axis=1)


def _stats(target: pd.Series, query: pd.Series) -> pd.DataFrame:
    none = target.isna() | query.isna()
    t, q = (x.mask(none, "").tolist() for x in (target, query))
    ends, at, out = np.cumsum([len(a) + len(b) for a, b in zip(t, q)]), 0, [np.zeros((0, 7), np.int64)]
    while at < len(t):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right")))
        out.append(_some_stats(t[at:to], q[at:to]))
        at = to
    return pd.DataFrame(np.concatenate(out), columns=[x.split()[0] for x in STATS.split(", ")])


def surface_decision(df: DataFrame, keys: list[str], letter: str = "aa1", area: str = "area", sidechain: bool = False) -> DataFrame:
    """``decision, area_avg`` of each group: mean area of valid residues against their mean threshold."""
    own = F.when(F.col(letter) == "G", None if sidechain else 14.0).when((F.col(letter) == "A") & F.lit(sidechain), 14.0).otherwise(15.0)
    valid = F.col(area) >= 0
    g = df.groupBy(*keys).agg(F.avg(F.when(valid, F.col(area))).alias("a_"), F.avg(F.when(valid, own)).alias("t_"), F.count(F.col(area)).alias("n_"))
    delta = F.col("a_") - F.col("t_")
    text = F.when(F.col("n_") == 0, "Unknown").when(F.col("t_").isNull() | (delta < 0), "Buried").when(delta < 10, "Intermediate").otherwise("Surface")
    return g.select(*keys, text.alias("decision"), F.when(F.col("t_").isNull(), -1.0).otherwise(F.col("a_")).alias("area_avg"))


def interface_call(areas: DataFrame, keys: list[str], residue: str, near: DataFrame, duplicates: DataFrame, least: float = 0.1) -> DataFrame:
    """``interface, delta``: largest loss of area of a residue between its own chain and the assembly.

    ``areas``: keys, residue, isolated, assembly (null: use ``asymmetric``); ``near`` and ``duplicates``: keys, chains array.
    """
    loss = F.col("isolated") - F.coalesce("assembly", "asymmetric")
    g = areas.groupBy(*keys).agg(F.max(loss).alias("delta"))
    both = g.join(near.withColumnRenamed("chains", "near_"), keys, "left").join(duplicates.withColumnRenamed("chains", "dup_"), keys, "left")
    kind = F.when(F.coalesce(F.arrays_overlap("near_", "dup_"), F.lit(False)), "Homomer").otherwise("Heteromer")
    return both.select(*keys, F.when(F.abs("delta") >= least, kind).otherwise("No").alias("interface"), "delta")
