"""Structure and secondary-structure files to tables.

A structure file is small (tens of MB at most) and is read whole; parallelism is over files. Everything after that is
column expressions over its lines.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER_RE = r"^(.*)\s+(\d{2}-.{3}-\d{2})\s+(.*)$"


def file_lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``file, line_no, line`` of whole-text files, in order within a file."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _at(start: int, n: int) -> Column:
    return F.trim(F.substring("line", start, n))


@contextlib.contextmanager
def _packed(spark: SparkSession, bytes_: int):
    """While it lasts, Spark reads files of ``bytes_`` together in one task, however many they are."""
    names = {"spark.sql.files.maxPartitionBytes": str(bytes_), "spark.sql.files.openCostInBytes": str(max(1, bytes_ // 10_000)), "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def pack_files(spark: SparkSession, path, out: str, glob: str | None = None, bytes_: int = 128 << 20) -> None:
    """Many small text files to a few containers: a Parquet table ``file, n_bytes, value`` in order of the file names.

    Tasks and containers hold about ``bytes_`` each. The smallest and largest names of a container's row groups, and a Bloom filter,
    are its index: a reader of some names opens only what may hold them.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    with _packed(spark, bytes_):
        found = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("n_bytes"), "value")
        write_containers(found, out, bytes_)


def write_containers(texts: DataFrame, out: str, bytes_: int = 128 << 20, mode: str = "error") -> None:
    """``file, value`` (one row a file) to containers of about ``bytes_``."""
    rows = texts if "n_bytes" in texts.columns else texts.withColumn("n_bytes", F.octet_length("value").cast("long"))
    total = texts.agg(F.coalesce(F.sum(F.col("n_bytes") if "n_bytes" in texts.columns else F.octet_length("value")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // bytes_))
    options = {"parquet.block.size": str(max(1 << 20, bytes_ // 16)), "parquet.bloom.filter.enabled#file": "true"}
    rows.select("file", "n_bytes", "value").repartitionByRange(parts, "file").sortWithinPartitions("file").write.options(**options).mode(mode).parquet(out)


def container_lines(spark: SparkSession, path, names: list[str] | None = None) -> DataFrame:
    """``file, line_no, line`` of all files of containers, or of those with some names."""
    found = spark.read.parquet(path)
    found = found.filter(F.col("file").isin(names)) if names is not None else found
    return found.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def texts_of(lines: DataFrame, key: str) -> DataFrame:
    """``file, value``: the lines of each structure (``key, order_, value``) as one text."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_", "value"))), lambda s: s["value"]), "\n")  # one structure's lines
    return lines.groupBy(F.col(key).alias("file")).agg(whole.alias("value"))


def coordinates(lines: DataFrame) -> DataFrame:
    """All ``ATOM`` and ``HETATM`` lines in one pass: the columns of ``atoms``, the ``line``, and ``ok``, whether its coordinates parse."""
    opened = F.when(F.startswith("line", F.lit("MODEL ")), F.substring("line", 11, 4).try_cast("int"))
    order = Window.partitionBy("file").orderBy("line_no")
    coordinate = F.substring("line", 1, 6).isin("ATOM  ", "HETATM")
    useful = lines.filter(coordinate | F.startswith("line", F.lit("MODEL ")))
    marked = useful.withColumn("model", F.coalesce(F.last(opened, ignorenulls=True).over(order), F.lit(0))).filter(coordinate)
    rows = marked.select(
        F.upper(F.regexp_extract("file", r"(?:pdb)?([0-9A-Za-z]{4})[^/]*$", 1)).alias("pdb_id"), "file", F.col("line_no").cast("long").alias("line_no"), _at(1, 6).alias("rec"),
        _at(7, 5).try_cast("int").alias("serial"), _at(13, 4).alias("atom_name"), _at(17, 1).alias("altloc"), _at(18, 3).alias("resname"), _at(22, 1).alias("chain"), _at(23, 4).try_cast("int").alias("resnum"),
        _at(27, 1).alias("icode"), *[_at(31 + 8 * k, 8).try_cast("double").alias(c) for k, c in enumerate("xyz")], _at(55, 6).try_cast("double").alias("occ"), _at(61, 6).try_cast("double").alias("b"),
        _at(73, 4).alias("segid"), F.upper(_at(77, 2)).alias("element"), _at(79, 2).alias("charge"), "model", "line",
    )
    return rows.withColumn("ok", F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of ``ATOM``/``HETATM`` lines with their model; lines whose coordinates don't parse are left out."""
    return coordinates(lines).filter("ok").drop("line", "ok")


def atom_rejects(lines: DataFrame) -> DataFrame:
    """``file, line_no, line`` of coordinate lines that ``atoms`` leaves out."""
    whole = [_at(31 + 8 * k, 8).try_cast("double").isNotNull() for k in range(3)]
    return lines.filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM") & ~(whole[0] & whole[1] & whole[2]))


def metadata(lines: DataFrame) -> DataFrame:
    """One row per file: title, keywords, compound, header, dates, method, resolution, R values, organism, assemblies."""
    first = lines.filter(F.substring("line", 1, 6).isin("ATOM  ", "HETATM")).groupBy("file").agg(F.min("line_no").alias("first_"))
    head = lines.join(first, "file", "left").filter(F.col("first_").isNull() | (F.col("line_no") < F.col("first_")))
    line = F.col("line")

    def joined(test: Column, value: Column) -> Column:
        rows = F.collect_list(F.when(test, F.struct("line_no", value.alias("v"))))
        return F.array_join(F.transform(F.array_sort(rows), lambda s: s["v"]), " ")

    def last(test: Column, value: Column) -> Column:
        return F.max_by(F.when(test, value), F.when(test, F.col("line_no")))

    number = F.regexp_extract(line, r"(\d+\.\d+)\D*$", 1).try_cast("double")
    dated = F.startswith(line, F.lit("HEADER")) & F.substring(line, 7, 200).rlike(HEADER_RE)
    part = lambda k: F.trim(F.regexp_extract(F.substring(line, 7, 200), HEADER_RE, k))
    after = lambda word: F.trim(F.regexp_replace(F.regexp_extract(line, word + r":\s*(.*)", 1), ";", ""))
    return head.groupBy("file").agg(
        joined(F.startswith(line, F.lit("TITLE ")), F.trim(F.substring(line, 11, 200))).alias("title"),
        joined(F.startswith(line, F.lit("KEYWDS")), F.trim(F.substring(line, 7, 200))).alias("keywords"),
        last(F.startswith(line, F.lit("COMPND   2")), F.trim(F.regexp_replace(F.regexp_replace(F.substring(line, 11, 200), ";", ""), "MOLECULE:", ""))).alias("compound"),
        last(dated, F.concat(F.upper(F.substring(part(1), 1, 1)), F.lower(F.substring(part(1), 2, 200)))).alias("header"),
        last(dated, F.upper(part(2))).alias("published"),
        last(dated, F.upper(part(3))).alias("pdb_code"),
        last(F.startswith(line, F.lit("EXPDTA")), F.trim(F.substring(line, 7, 200))).alias("method"),
        last(line.contains("RESOLUTION.") & number.isNotNull(), number).alias("resolution"),
        last(line.contains("FREE R VALUE    ") & number.isNotNull(), number).alias("r_free"),
        last(line.contains("3   R VALUE") & line.contains("WORKING SET") & number.isNotNull(), number).alias("r_value"),
        last(line.contains("ORGANISM_SCIENTIFIC:"), after("ORGANISM_SCIENTIFIC")).alias("organism_scientific"),
        last(line.contains("ORGANISM_COMMON:"), after("ORGANISM_COMMON")).alias("organism_common"),
        last(line.contains("ORGANISM_TAXID:"), F.regexp_extract(line, r"ORGANISM_TAXID:\s*(\d+)", 1).try_cast("int")).alias("organism_taxid"),
        F.count_if(line.contains("350 BIOMOLECULE:")).alias("n_biomolecules"),
    )


def assemblies(lines: DataFrame) -> DataFrame:
    """``file, num, order_, chains, matrices`` from ``REMARK 350`` lines, in file order."""
    r = lines.filter(F.startswith("line", F.lit("REMARK 350 "))).withColumn("data", F.substring("line", 12, 200))
    order = Window.partitionBy("file").orderBy("line_no")
    starts = F.when(F.trim("data").startswith("BIOMOLECULE"), F.col("line_no"))
    r = r.withColumn("order_", F.last(starts, ignorenulls=True).over(order)).filter("order_ is not null")
    listed = F.filter(F.transform(F.split(F.regexp_extract("data", r":\s*([^:]*)$", 1), ","), lambda v: F.trim(v)), lambda c: c != "")
    is_chain = F.col("data").contains("APPLY THE FOLLOWING TO CHAINS") | F.col("data").contains("AND CHAINS:")
    cols = F.split(F.trim("data"), r"\s+")
    is_row = F.col("data").rlike(r"^\s*BIOMT[123]\s+\d+")
    row = F.struct("line_no", F.transform(F.slice(cols, 3, 4), lambda v: v.cast("double")).alias("v"))
    g = r.groupBy("file", "order_").agg(
        F.max(F.when(F.trim("data").startswith("BIOMOLECULE"), F.regexp_extract("data", r":\s*(\d+)", 1).try_cast("int"))).alias("num"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(is_chain, F.struct("line_no", listed.alias("c"))))), lambda s: s["c"])).alias("chains"),
        F.transform(F.array_sort(F.collect_list(F.when(is_row, row))), lambda s: s["v"]).alias("rows_"),
    )
    three = F.filter(F.transform("rows_", lambda _, k: F.when(k % 3 == 0, F.slice("rows_", k + 1, F.lit(3)))), lambda m: m.isNotNull())
    return g.select("file", "num", F.col("order_").cast("long").alias("order_"), "chains", three.alias("matrices"))


def secondary(lines: DataFrame) -> DataFrame:
    """``file, seq, resnum, chain, aa, code`` of secondary-structure tables; blank codes are ``_``, chain breaks go."""
    header = lines.filter(F.trim("line").startswith("#")).groupBy("file").agg(F.min("line_no").alias("head_"))
    rows = lines.join(header, "file").filter((F.col("line_no") > F.col("head_")) & (F.length("line") > 16) & (F.substring("line", 14, 1) != "!"))
    code = F.trim(F.substring("line", 15, 3))
    return rows.select("file", F.col("line_no").alias("seq"), F.trim(F.substring("line", 6, 6)).alias("resnum"), F.trim(F.substring("line", 12, 1)).alias("chain"), F.substring("line", 14, 1).alias("aa"), F.when(code == "", "_").otherwise(code).alias("code"))


def secondary_rejects(lines: DataFrame) -> DataFrame:
    """``file, line_no, line`` of lines below the head row that are too short for a table row."""
    header = lines.filter(F.trim("line").startswith("#")).groupBy("file").agg(F.min("line_no").alias("head_"))
    return lines.join(header, "file").filter((F.col("line_no") > F.col("head_")) & (F.length("line") <= 16) & (F.trim("line") != "")).select("file", "line_no", "line")


def area_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Precomputed areas: atoms whose b column is the area, and per file the modification modes and count of its remarks."""
    remark = F.startswith("line", F.lit("REMARK"))
    mode = F.when(F.col("line").rlike("(?i)number of modif"), "").otherwise(F.regexp_extract("line", r"(?i)modif\w*[^:]*:\s*(.*)$", 1))
    notes = lines.filter(remark).groupBy("file").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(mode != "", F.trim(mode)))), ",").alias("modifications"),
        F.max(F.regexp_extract("line", r"(?i)number of modif\w*[^:]*:\s*(\d+)", 1).try_cast("int")).alias("n_modified"),
    )
    return atoms(lines).withColumnRenamed("b", "area"), notes
