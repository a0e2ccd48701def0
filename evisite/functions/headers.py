"""Column expressions over sequence headers, sequences and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisite.dims import AMINO, lookup

#: Names that custom header attributes may not take (fixed values).
RESERVED = [
    "ENTRY", "ENTRY_ID", "GENE", "POI", "POISEQ", "STRUCTURES", "ACCESSIBLE", "FLEXIBLE", "BLAST_ENTRIES", "BEST_BITSCORE", "BITSCORE_PASS",
    "BEST_ALIGNMENT", "ALIGN_PASS", "DISORDER_SCORE", "DATASERIES", "SEQ_ID", "RELIABILITY", "DESC", "N_STRUCTURES", "PYMOL", "IUPRED", "DSSP",
    "ASA_VALS", "ASA_AVG", "ASA_DECISION", "ASA_POI_DELTA", "ASA_POI_MIN", "ASA_POI_MAX", "TEMPF_POI_VALS", "TEMPF_POI_MIN", "TEMPF_POI_MAX",
    "TEMPF_FILE_MIN", "TEMPF_FILE_MAX", "PDB_FILES", "PDB_CHAINS", "PDB_SITES", "PDB_PTMS", "BLAST_RANKS", "SEQ_POIPOS", "SEQ_POISEQ", "PDBSEQ",
    "ALIGNMENTS", "ALIGN_AVG", "BITSCORE_AVG", "IDENTITY_AVG", "METHODS", "R-FREE_AVG", "RESOLUTIONS", "ORGANISM_SCIENTIFIC", "ORGANISM_TAXID",
]


def strip_pos_tag(acc: Column) -> Column:
    return F.substring_index(acc, "_Pos", 1)


def accession(header: Column, with_pos: bool = True, clean: bool = True) -> Column:
    """The accession of a header by its number of ``|`` fields; illegal marks become ``_``."""
    h = F.regexp_replace(F.trim(header), "^>", "")
    cols = F.transform(F.split(h, r"\|"), lambda v: F.trim(v))
    second = F.try_element_at(cols, F.lit(2))
    acc = (
        F.when(F.size(cols) < 2, F.substring(h, 1, 10))
        .when((F.size(cols) == 2) & (F.length(cols[0]) > 2), cols[0])
        .when(F.startswith(second, F.lit("POI:")), cols[0])
        .otherwise(second)
    )
    acc = acc if with_pos else strip_pos_tag(acc)
    return F.translate(acc, ";,: \t", "_____") if clean else acc


def poi_position(header: Column) -> Column:
    """The position in ``POI:n``, else -1."""
    return F.coalesce(F.regexp_extract(header, r"POI:\s*(\d+)", 1).try_cast("int"), F.lit(-1))


def gene(header: Column) -> Column:
    """The gene in ``GN=``, else empty."""
    return F.regexp_extract(header, r"GN=(\S+)", 1)


def description(header: Column) -> Column:
    """Text after the accession field before the first `` XX=``."""
    after = F.substring_index(header, "|", -1)
    text = F.when(after.rlike(r".+? ..="), F.regexp_extract(after, r"(.+?) ..=", 1)).otherwise(after)
    return F.when(F.instr(header, "|") == 0, header).otherwise(text)


def custom_values(header: Column, with_poi: bool = False) -> Column:
    """``|KEY:value|`` attributes as a map; the last of repeated keys wins."""
    cols = F.filter(F.split(header, r"\|"), lambda c: c.rlike(r"^\s*[A-Z]+:"))
    pairs = F.transform(cols, lambda c: F.struct(F.regexp_extract(c, r"^\s*([A-Z]+):", 1).alias("k"), F.regexp_extract(c, r"^\s*[A-Z]+:(.*)$", 1).alias("v")))
    if not with_poi:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin("POI", "POISEQ"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def reserved_keys(custom: Column) -> Column:
    """The keys of a custom map that clash with report columns."""
    return F.array_sort(F.array_intersect(F.map_keys(custom), F.array(*map(F.lit, RESERVED))))


def header_fields(header: Column) -> Column:
    """Database, POI range, POI context and other named fields of a normalised header, as a struct."""
    m = custom_values(header, with_poi=True)
    pick = lambda k: F.try_element_at(m, F.lit(k)).alias(k.lower())
    return F.struct(F.when(F.instr(header, "|") > 0, F.substring_index(header, "|", 1)).alias("db"), pick("POI"), pick("POISEQ"), pick("CLV"), pick("NETSURF"))


def clean_sequence(seq: Column) -> Column:
    return F.regexp_replace(seq, r"[\s-]+", "")


def flanks(seq: Column, poi: Column, n: int = 6) -> tuple[Column, Column]:
    """``n`` residues up to and after position ``poi``, padded with ``-``."""
    start = F.greatest(poi - n, F.lit(0))
    before = F.lpad(F.substring(seq, start + 1, poi - start), n, "-")
    return before, F.rpad(F.substring(seq, poi + 1, F.lit(n)), n, "-")


def query_window(seq: Column, poi: Column, n: int) -> Column:
    """``n`` residues (odd rounded up) around the position, shifted in at the ends."""
    n += n % 2
    start = F.greatest(F.lit(0), F.least(poi - n // 2, F.length(seq) - n))
    return F.substring(seq, start + 1, F.lit(n))


def align_window(seq: Column, poi: Column, n: int = 10) -> Column:
    """``n`` residues from ``max(0, poi - n/2)``."""
    return F.substring(seq, F.greatest(F.lit(0), poi - n // 2) + 1, F.lit(n))


def three_to_one(text: Column) -> Column:
    """Residue names written together to letters, unknown ones to X."""
    names = F.regexp_extract_all(F.upper(text), F.lit(r"(.{3})"))
    return F.array_join(F.transform(names, lambda n: F.coalesce(lookup(AMINO, n), F.lit("X"))), "")


def real_chain(chain: Column) -> Column:
    """``GG`` means chain ``g``."""
    return F.when((F.length(chain) == 2) & (F.substring(chain, 1, 1) == F.substring(chain, 2, 1)), F.lower(F.substring(chain, 1, 1))).otherwise(chain)


def filename_chain(chain: Column) -> Column:
    """Chain ``g`` is written ``GG``."""
    return F.when(chain.rlike("^[a-z]$"), F.upper(F.concat(chain, chain))).otherwise(chain)


def add_unique(df: DataFrame, col: str, order_by, out: str) -> DataFrame:
    """Ids made unique: the first stays, later ones get a numeric suffix."""
    k = F.row_number().over(Window.partitionBy(col).orderBy(order_by))
    return df.withColumn(out, F.when(k == 1, F.col(col)).otherwise(F.concat(F.col(col), F.lit("_"), k.cast("string"))))


def typed_cast(value: Column, code: str) -> tuple[Column, Column]:
    """The value as ``s``, ``i`` or ``f``, and whether the cast failed."""
    to = {"s": "string", "i": "int", "f": "double"}[code]
    cast = F.trim(value).try_cast(to)
    return cast, value.isNotNull() & cast.isNull()


def remark_text(text: Column) -> Column:
    return F.regexp_replace(text, "[,;]", "_")


def fasta_description(text: Column) -> Column:
    """A description without position tags and list marks."""
    return F.trim(remark_text(F.regexp_replace(text, r"POI(SEQ)?:[^|\s]*", "")))


def entry_key(entry: Column, rank: Column) -> Column:
    return F.concat(entry, F.lit("_"), rank.cast("string"))


def entry_of(key: Column) -> tuple[Column, Column]:
    """The entry and the rank of an entry key."""
    return F.regexp_extract(key, r"^(.*)_(\d+)$", 1), F.regexp_extract(key, r"_(\d+)$", 1).try_cast("int")


def sequence_hash(seq: Column) -> Column:
    """The sequence itself up to 37 letters, else its md5 and its length in five digits."""
    s = F.trim(seq)
    return F.when(F.length(s) <= 37, s).otherwise(F.concat(F.md5(s), F.lpad(F.length(s).cast("string"), 5, "0")))


def derangify(text: Column) -> Column:
    """``1,2,5-10`` to all its numbers."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int"))))


def rangify(df: DataFrame, keys: list[str], col: str, out: str = "ranges") -> DataFrame:
    """Sorted distinct numbers of each group as ``1-3,7`` (gaps and islands)."""
    d = df.select(*keys, F.col(col).cast("long").alias("v_")).filter("v_ is not null").distinct()
    island = F.col("v_") - F.row_number().over(Window.partitionBy(*keys).orderBy("v_"))
    runs = d.withColumn("g_", island).groupBy(*keys, "g_").agg(F.min("v_").alias("a_"), F.max("v_").alias("b_"))
    text = F.when(F.col("a_") == F.col("b_"), F.col("a_").cast("string")).otherwise(F.concat_ws("-", "a_", "b_"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("a_", text.alias("t_")))), lambda s: s["t_"])
    return runs.groupBy(*keys).agg(F.array_join(parts, ",").alias(out))


def natural_key(name: Column) -> Column:
    """Sort key of a file name: digit runs padded, so they order by value."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def series_number(name: Column) -> Column:
    """The last number of a file's stem."""
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long")


def percentage(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def real_sequence_id(name: Column) -> Column:
    return F.regexp_replace(name, r":\d+$", "")


def view_colour(is_poi: Column, chain: Column, poi_chain: Column, is_twin: Column, duplicates: Column) -> Column:
    """Colour code of a residue: site 100, its chain 0, twin site 95, duplicate chains 20 to 50, neighbours 70 to 80."""
    at = F.array_position(duplicates, chain)
    return (
        F.when(is_poi, 100.0)
        .when(chain == poi_chain, 0.0)
        .when(is_twin, 95.0)
        .when(at > 0, F.least(F.lit(50.0), 20.0 + 5.0 * (at - 1)))
        .otherwise(70.0 + F.pmod(F.ascii(chain), F.lit(11)))
    )


def gene_dimension(headers: DataFrame, col: str = "header", order_by: str = "line_no") -> DataFrame:
    """``id, gene, description``; the first header of an id wins."""
    d = headers.select(accession(F.col(col), with_pos=False).alias("id"), gene(F.col(col)).alias("gene"), description(F.col(col)).alias("description"), F.col(order_by).alias("o_"))
    return d.groupBy("id").agg(F.min_by(F.struct("gene", "description"), "o_").alias("s_")).select("id", "s_.gene", "s_.description")
