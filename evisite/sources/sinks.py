"""Sinks: text layouts as column expressions, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap(seq: Column, n: int = 60) -> Column:
    return F.rtrim(F.regexp_replace(seq, f"(.{{{n}}})", "$1\n"), F.lit("\n"))


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", n: int = 60) -> None:
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrap(F.col(seq), n)).alias("value")).write.text(path)


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", mode: str = "error") -> None:
    """Tab-separated text with a head line; arrays joined with ``sep``."""
    kinds = dict(df.dtypes)
    cols = [F.array_join(F.transform(c, lambda v: v.cast("string")), sep).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns or df.columns]
    df.select(*cols).write.mode(mode).csv(path, sep="\t", header=True, emptyValue="")


def atom_line() -> Column:
    """A fixed-column coordinate line of an atom row."""
    name = F.when(F.length("atom_name") >= 4, F.col("atom_name")).otherwise(F.rpad(F.concat(F.lit(" "), F.col("atom_name")), 4, " "))
    return F.concat(
        F.rpad("rec", 6, " "), F.lpad(F.col("serial").cast("string"), 5, " "), F.lit(" "), name, F.rpad("altloc", 1, " "), F.lpad("resname", 3, " "), F.lit(" "), F.rpad("chain", 1, " "),
        F.lpad(F.col("resnum").cast("string"), 4, " "), F.rpad("icode", 1, " "), F.lit("   "), *[F.lpad(F.format_string("%.3f", F.col(c)), 8, " ") for c in "xyz"],
        F.lpad(F.format_string("%.2f", F.col("occ")), 6, " "), F.lpad(F.format_string("%.2f", F.col("b")), 6, " "), F.lit("      "), F.rpad("segid", 4, " "), F.lpad("element", 2, " "), F.rpad("charge", 2, " "),
    )


def structure_lines(atoms: DataFrame, keys: list[str], remarks: DataFrame | None = None) -> DataFrame:
    """``keys, order_, value``: remarks, models, atoms, chain ends and the end of each structure."""
    ends = atoms.groupBy(*keys, "model", "chain").agg(F.max("line_no").alias("line_no"))
    models = atoms.groupBy(*keys, "model").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    several = models.filter("model > 0")
    place = lambda a, b: F.struct(F.lit(a).cast("int").alias("part"), b.cast("long").alias("line"), F.lit(0).alias("sub"))
    sub = lambda line, k: F.struct(F.lit(1).alias("part"), line.cast("long").alias("line"), F.lit(k).alias("sub"))
    out = atoms.select(*keys, sub(F.col("line_no"), 1).alias("order_"), atom_line().alias("value"))
    out = out.unionByName(ends.select(*keys, sub(F.col("line_no"), 2).alias("order_"), F.lit("TER").alias("value")))
    out = out.unionByName(several.select(*keys, sub(F.col("lo"), 0).alias("order_"), F.format_string("MODEL     %4d", F.col("model")).alias("value")))
    out = out.unionByName(several.select(*keys, sub(F.col("hi"), 3).alias("order_"), F.lit("ENDMDL").alias("value")))
    out = out.unionByName(atoms.select(*keys).distinct().select(*keys, place(2, F.lit(0)).alias("order_"), F.lit("END").alias("value")))
    if remarks is not None:
        out = out.unionByName(remarks.select(*keys, place(0, F.col("line_no")).alias("order_"), F.col("line").alias("value")))
    return out


def write_structures(lines: DataFrame, path: str, key: str) -> None:
    """One folder per structure with its lines in order."""
    lines.repartition(key).sortWithinPartitions(key, "order_").select(key, "value").write.partitionBy(key).text(path)


def remark_lines(df: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """Annotation lines ``REMARK 69  GROUP: KEY:value, ...`` of an evidence table."""
    out = None
    for n, (group, cols) in enumerate(groups.items()):
        text = F.concat(F.lit(f"REMARK 69  {group[:7]:7}: "), F.concat_ws(", ", *[F.concat(F.lit(c.upper() + ":"), F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[,;]", "_"), F.lit(""))) for c in cols]))
        one = df.select(key, F.lit(n).alias("line_no"), text.alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def alignment_text(score: str, target: str, query: str, target_id: str, query_id: str) -> Column:
    return F.concat(F.lit(";ALIGNMENT_SCORE:"), F.col(score).cast("string"), F.lit("\n>"), F.col(target_id), F.lit("\n"), F.col(target), F.lit("\n>"), F.col(query_id), F.lit("\n"), F.col(query))


def disorder_text(header: str, position: str, value: str) -> Column:
    return F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.format_string("disorder_@%d: %.4f", F.col(position), F.col(value)))


def heatmap(df: DataFrame, row: str, series: str, value: str) -> DataFrame:
    """``row, values``: one value per file of a series, in its order, joined with ``;``."""
    all_ = F.transform(F.array_sort(F.collect_list(F.struct(series, F.col(value).alias("v")))), lambda s: s["v"].cast("string"))
    return df.groupBy(row).agg(F.array_join(all_, ";").alias("values"))


def concatenate(spark, paths: list[str], to: str, append: bool = False) -> None:
    """All lines of several files into one text table."""
    spark.read.text(paths).write.mode("append" if append else "error").text(to)


def write_list(df: DataFrame, col: str, path: str, append: bool = False) -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


def area_provenance(areas: DataFrame, key: str, probe: float, points: int, mode: str, modified: str = "N") -> DataFrame:
    """Run metadata of an area computation: chains, models, classes, settings and total."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return areas.groupBy(key).agg(listed("chain").alias("chains"), listed("model").alias("models"), listed("cls").alias("classes"), F.lit(mode).alias("mode"), F.lit(modified).alias("modified"), F.lit(points).alias("points"), F.lit(probe).alias("probe"), F.sum("asa").alias("total_area"))


def assembly_lines(copies: DataFrame, chains: list[str] | None = None, numbers: list[int] | None = None) -> DataFrame:
    """Structure lines of assembly copies, by structure and assembly, filtered by chain or number."""
    kept = copies.filter(F.col("chain").isin(chains)) if chains else copies
    kept = kept.filter(F.col("assembly").isin(numbers)) if numbers else kept
    kept = kept.withColumn("assembly_id", F.concat_ws("_", "pdb_id", "assembly")).withColumn("model", F.col("copy") + 1)
    return structure_lines(kept.withColumn("line_no", F.col("copy").cast("long") * 10_000_000 + F.col("line_no")), ["assembly_id"])
