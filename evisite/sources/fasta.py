"""Sequence, hit, disorder and list sources: text scans that split by record, so one large file reads in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisite.functions.headers import natural_key, real_chain, series_number
from evisite.operators.pairs import first_of

HIT_TYPES = {
    "subject_id": "string", "identity": "double", "alignment_length": "int", "mismatches": "int", "gap_opens": "int", "q_start": "int", "q_end": "int",
    "s_start": "int", "s_end": "int", "evalue": "string", "bitscore": "double",
}


def records(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``header, body, file`` of every ``>`` record; comment lines before and inside records are dropped."""
    reader = spark.read.option("lineSep", "\n>")
    return parse_records((reader.option("pathGlobFilter", glob) if glob else reader).text(path))


def stream_records(spark: SparkSession, folder: str, files_per_batch: int = 20) -> DataFrame:
    """The records of new files of a folder, as a stream; a file is never split between batches."""
    return parse_records(spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder))


def parse_records(raw: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"(?m)^;[^\n]*\n?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^\s*>", ""), r"\n+$", "")
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    split = raw.select(F.substring_index(text, "\n", 1).alias("header"), body.alias("body"), F.col("_metadata.file_path").alias("file"))
    return split.filter(F.trim("header") != "")


def sequences(spark: SparkSession, path, join_lines: bool = True, glob: str | None = None) -> DataFrame:
    """``header, seq, file``; lines joined without white space."""
    seq = F.regexp_replace("body", r"\s+", "") if join_lines else F.trim("body")
    return records(spark, path, glob).select(F.trim("header").alias("header"), seq.alias("seq"), "file")


def headers(spark: SparkSession, path) -> DataFrame:
    """Header lines only."""
    return spark.read.text(path).filter(F.startswith("value", F.lit(">"))).select(F.col("value").substr(F.lit(2), F.length("value")).alias("header"))


def count_records(spark: SparkSession, path) -> int:
    return headers(spark, path).count()


def hits(spark: SparkSession, path, obsolete: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits and rejects of hit tables: 12 tab columns below ``>query`` lines; rank is the line's place in its block.

    Subjects are ``gi|n|pdb|CODE|CHAIN`` or ``CODE_CHAIN``; of repeated structure chains the first stays, ranks advance.
    """
    return parse_hits(records(spark, path), obsolete)


def parse_hits(blocks: DataFrame, obsolete: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``hits`` of records that are read already (``header, body``)."""
    lines = blocks.select(F.col("header").alias("block"), F.posexplode(F.split("body", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    cols = F.split("line", "\t")
    good = lines.filter(F.size(cols) == 12)
    rows = good.select(cols[0].alias("query_id"), *[cols[k + 1].try_cast(t).alias(n) if t != "string" else cols[k + 1].alias(n) for k, (n, t) in enumerate(HIT_TYPES.items())], (F.col("line_no") + 1).alias("rank"))
    long = F.col("subject_id").contains("|pdb|")
    pdb = F.when(long, F.regexp_extract("subject_id", r"\|pdb\|([^|]+)", 1)).otherwise(F.substring_index("subject_id", "_", 1))
    chain = F.when(long, F.regexp_extract("subject_id", r"\|pdb\|[^|]+\|([^|]*)", 1)).otherwise(F.substring_index("subject_id", "_", -1))
    rows = rows.withColumn("pdb_id", F.upper(pdb)).withColumn("chain", real_chain(chain))
    rows = rows.withColumn("struct_id", F.concat_ws("_", "pdb_id", "chain"))
    if obsolete is not None:
        rows = rows.join(obsolete.select(F.upper("pdb_id").alias("pdb_id")).distinct(), "pdb_id", "left_anti")
    rejects = lines.filter(F.size(cols) != 12).select("block", "line_no", "line")
    return first_of(rows, ["query_id", "struct_id"], [F.col("rank")]), rejects


def disorder_results(spark: SparkSession, path) -> DataFrame:
    """``entry_id, position, disorder``; the first of repeated entries."""
    rows = records(spark, path).select(
        F.regexp_extract("header", r"^(\S+)", 1).alias("entry_id"),
        F.regexp_extract("body", r"disorder_@(\d+):", 1).try_cast("int").alias("position"),
        F.regexp_extract("body", r"disorder_@\d+:\s*(-?[0-9.]+)", 1).try_cast("double").alias("disorder"),
        F.monotonically_increasing_id().alias("o_"),
    )
    return first_of(rows, ["entry_id"], [F.col("o_")]).drop("o_")


def disorder_scores(spark: SparkSession, path) -> DataFrame:
    """``file, position, aa, score`` of per-residue score rows."""
    at = r"^\s*(\d+)\s+(\S)\s+(-?[0-9.]+)\s*$"
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(F.col("value").rlike(at))
    return rows.select("file", F.regexp_extract("value", at, 1).cast("int").alias("position"), F.regexp_extract("value", at, 2).alias("aa"), F.regexp_extract("value", at, 3).cast("double").alias("score"))


def disorder_rejects(spark: SparkSession, path) -> DataFrame:
    """``header, body`` of disorder records without a position and a value."""
    whole = F.col("header").rlike(r"^\S+") & F.col("body").rlike(r"disorder_@\d+:\s*-?[0-9.]+")
    return records(spark, path).filter(~whole).select("header", "body")


def score_rejects(spark: SparkSession, path) -> DataFrame:
    """``file, value`` of lines that are neither a score row nor blank nor a remark."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.filter(~F.col("value").rlike(r"^\s*(\d+\s+\S\s+-?[0-9.]+)?\s*$") & ~F.startswith(F.ltrim("value"), F.lit("#")))


def obsolete_codes(spark: SparkSession, path) -> DataFrame:
    return lines(spark, path, distinct=True).select(F.upper("value").alias("pdb_id"))


def lines(spark: SparkSession, path, distinct: bool = False) -> DataFrame:
    """Non-empty trimmed lines."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")
    return rows.distinct() if distinct else rows


def tsv(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def annotations(spark: SparkSession, path) -> DataFrame:
    """``file, values`` from ``REMARK 69`` lines before the first atom: a map of arrays; site residues also numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("all_"))
    until = F.coalesce(F.array_position(F.transform("all_", lambda x: F.startswith(x, F.lit("ATOM "))), F.lit(True)), F.lit(0))
    head = F.when(until > 0, F.slice("all_", F.lit(1), until.cast("int") - 1)).otherwise(F.col("all_"))
    notes = F.filter(head, lambda x: F.startswith(x, F.lit("REMARK 69  ")))
    fields = F.flatten(F.transform(notes, lambda x: F.split(F.substring(x, F.lit(21), F.length(x)), ",")))
    pairs = F.filter(F.transform(fields, lambda c: F.struct(F.trim(F.substring_index(c, ":", 1)).alias("k"), F.filter(F.transform(F.split(F.substring(c, F.instr(c, ":") + 1, F.length(c)), ";"), lambda v: F.trim(v)), lambda v: v != "").alias("v"))), lambda p: p["k"] != "")
    rows = whole.select("path", "file", F.posexplode(pairs).alias("at_", "p_")).select("path", "file", "at_", "p_.k", "p_.v")
    sites = rows.filter(F.col("k").isin("PDBPOI", "PDBCLV")).select("path", "file", "at_", F.posexplode("v").alias("n_", "x_")).select("path", "file", "at_", F.concat(F.lit("POIRESIDUE_"), (F.col("n_") + 1).cast("string")).alias("k"), F.array("x_").alias("v"))
    last = rows.unionByName(sites).groupBy("path", "file", "k").agg(F.max_by("v", "at_").alias("v"))
    return last.groupBy("path", "file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values")).drop("path")


def folder(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """``file_path, file_name, length`` of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.substring_index("path", "/", -1).alias("file_name"), "length")


def series(files: DataFrame, first: str) -> DataFrame:
    """The files of a numbered series from a first file on: same stem and ending, one per number (``series_no``, by which a reader sorts)."""
    stem = F.regexp_extract("file_name", r"^(.*?)(\d+)(\D*)$", 1)
    ending = F.regexp_extract("file_name", r"^(.*?)(\d+)(\D*)$", 3)
    of = lambda p: F.regexp_extract(F.lit(first), r"^(.*?)(\d+)(\D*)$", p)
    n = series_number(F.col("file_name"))
    rows = files.withColumn("series_no", n).filter((stem == of(1)) & (ending == of(3)) & (n >= of(2).cast("long")))
    return first_of(rows, ["series_no"], [natural_key(F.col("file_name"))])
