"""Further registered queries: sources and sinks over text that Spark writes from the tables, and single operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisite.functions import headers as H
from evisite.functions import scores as S
from evisite.operators import align as A
from evisite.operators import group as G
from evisite.operators import markers as M
from evisite.operators import pairs as P
from evisite.operators import spatial as X
from evisite.operators import search as W
from evisite.operators import structures as T
from evisite.plans import evidence as E
from evisite.plans.registry import AREA_SQL, CACHE_SQL, POINTS, PTS, TODAY, _cache, _points, _seeds_sql, query, table
from evisite.sources import cache as C
from evisite.sources import fasta, sinks
from evisite.sources import structures as R


def _place(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/text-{uuid.uuid4().hex}"


def _text(column: str) -> F.Column:
    return F.col(column).cast("string")


def _pick(values: list[str], at) -> F.Column:
    """The value at a place counted from 0, round and round."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def _pick_sql(values: list[str], at: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[(({at}) % {len(values)} + 1)::int]"


# Sources and sinks.


@query("select 'd|' || doc_id as header, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') seq from documents")
def fasta_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as sequence records in lines of 60 letters, and read back."""
    path = _place(spark)
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d|"), _text("doc_id")).alias("header"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("seq"))
    sinks.write_fasta(d, path)
    return fasta.sequences(spark, path).select("header", "seq")


@query("select 'sp|P' || p_partkey || '|' || p_name as header from part")
def fasta_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("sp|P"), _text("p_partkey"), F.lit("|"), "p_name").alias("header"), F.upper("p_type").alias("seq"))
    sinks.write_fasta(p, path)
    return fasta.headers(spark, path)


HIT_LINES_SQL = """
r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as rank, l_suppkey, l_quantity, l_extendedprice, l_tax from lineitem)
"""


def _hit_file(spark: SparkSession, sf_dir: str) -> str:
    """Hit tables of all orders: a block of lines an order; lines of a tax of 0.05 or more lack a column."""
    l = table(spark, sf_dir, "lineitem")
    subject = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("gi|7|pdb|"), F.lpad(_text("l_suppkey"), 4, "0"), F.lit("|GG"))).otherwise(F.concat(F.lpad(_text("l_suppkey"), 4, "0"), F.lit("_A")))
    whole = F.concat_ws("\t", F.concat(F.lit("q"), _text("l_orderkey")), subject, _text("l_quantity"), *[F.lit("1")] * 7, F.lit("1e-5"), _text("l_extendedprice"))
    line = F.when(F.col("l_tax") >= 0.05, F.concat_ws("\t", F.concat(F.lit("q"), _text("l_orderkey")), subject)).otherwise(whole)
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", line.alias("line")))).alias("all_"))
    path = _place(spark)
    lines.select(F.concat(F.lit(">q"), _text("l_orderkey"), F.lit("\n"), F.array_join(F.transform("all_", lambda s: s["line"]), "\n")).alias("value")).write.text(path)
    return path


@query(f"""
with {HIT_LINES_SQL},
h as (select *, lpad(l_suppkey::varchar, 4, '0') pdb_id, case when l_suppkey % 2 = 0 then 'g' else 'A' end as chain from r where l_tax < 0.05),
f as (select *, row_number() over (partition by l_orderkey, pdb_id, chain order by rank) k from h)
select 'q' || l_orderkey query_id, pdb_id, chain, pdb_id || '_' || chain struct_id, l_quantity::double identity, l_extendedprice::double bitscore, rank::int as rank from f where k = 1
""")
def hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = fasta.hits(spark, _hit_file(spark, sf_dir))
    return good.select("query_id", "pdb_id", "chain", "struct_id", "identity", "bitscore", "rank")


@query(f"with {HIT_LINES_SQL} select 'q' || l_orderkey block, (rank - 1)::int line_no from r where l_tax >= 0.05")
def hit_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = fasta.hits(spark, _hit_file(spark, sf_dir))
    return bad.select("block", "line_no")


@query("select 'E' || event_id entry_id, (event_id % 900)::int as position, round(value, 4) disorder from events where value is not null")
def disorder_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    e = table(spark, sf_dir, "events").filter("value is not null").select(F.concat(F.lit("E"), _text("event_id"), F.lit(" some text")).alias("h"), (F.col("event_id") % 900).cast("int").alias("p"), "value")
    e.select(sinks.disorder_text("h", "p", "value").alias("value")).write.text(path)
    return fasta.disorder_results(spark, path)


@query("select (event_id % 900)::int as position, upper(left(event_type, 1)) aa, round(value, 2) score, count(*) n from events where value is not null group by 1, 2, 3")
def disorder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    e = table(spark, sf_dir, "events").filter("value is not null")
    line = F.concat(F.lit("  "), _text("position"), F.lit(" "), F.upper(F.substring("event_type", 1, 1)), F.lit("   "), F.format_string("%.2f", F.col("value")))
    e.withColumn("position", F.col("event_id") % 900).select(line.alias("value")).union(spark.createDataFrame([("# head line",)], "value string")).write.text(path)
    return fasta.disorder_scores(spark, path).groupBy("position", "aa", "score").agg(F.count("*").alias("n"))


@query("select distinct upper(p_brand || p_size) pdb_id from part")
def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list file with blanks and repeated lines, read as distinct codes."""
    path = _place(spark)
    sinks.write_list(table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.lower("p_brand"), _text("p_size"), F.lit("  ")).alias("v")), "v", path)
    return fasta.obsolete_codes(spark, path)


@query("select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    sinks.write_tsv(table(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "c_mktsegment"])
    return fasta.tsv(spark, path)


@query("select o_custkey, count(*)::varchar n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) orders from orders group by 1")
def tsv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays are joined in the text table."""
    path = _place(spark)
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    sinks.write_tsv(g, path)
    return fasta.tsv(spark, path).withColumn("o_custkey", F.col("o_custkey").cast("long"))


@query("select n_nationkey::varchar as key, n_name as name, n_regionkey::varchar as region from nation")
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation lines of an evidence table, one file a row, and read back."""
    path = _place(spark)
    n = table(spark, sf_dir, "nation")
    lines = sinks.remark_lines(n, "n_nationkey", {"PDBINFO": ["n_nationkey", "n_name"], "PDBSITE": ["n_regionkey"]})
    sinks.write_structures(lines.select(F.col("n_nationkey").alias("key"), F.col("line_no").alias("order_"), F.col("line").alias("value")), path, "key")
    values = fasta.annotations(spark, path + "/*")
    return values.select(F.col("values")["N_NATIONKEY"][0].alias("key"), F.col("values")["N_NAME"][0].alias("name"), F.col("values")["N_REGIONKEY"][0].alias("region"))


# Structures: events as atoms.

NAMES = ["N", "CA", "C", "O", "CB", "H1"]
RESIDUES = ["GLY", "ALA", "MSE", "HOH", "ZN", "DA", "XYZ", "SO4"]
CLASSES = {"GLY": "amino", "ALA": "amino", "MSE": "modified", "HOH": "water", "ZN": "ion", "DA": "nucleic", "XYZ": "unknown", "SO4": "other"}
ALTLOCS = ["", "", "", "A", "B"]

ATOMS_SQL = f"""
a0 as (select event_id, 'F' || lpad((user_id % 10)::varchar, 3, '0') as file, {_pick_sql(["A", "B"], "event_id // 200")} as chain, (event_id // 20) % 50 as resnum, {_pick_sql(ALTLOCS, "event_id")} as altloc,
  {_pick_sql(NAMES, "event_id // 3")} as atom_name, {_pick_sql(RESIDUES, "event_id // 20")} as resname, coalesce(value, 0) as v from events),
a as (select *, left(atom_name, 1) as element,
  case when left(atom_name, 1) = 'H' then 'hydrogen' {" ".join(f"when resname = '{k}' then '{v}'" for k, v in CLASSES.items())} end as cls,
  case when resname = 'ZN' then case when atom_name = 'CA' then 2.31 end else case left(atom_name, 1) when 'H' then 1.20 when 'C' then 1.70 when 'N' then 1.55 when 'O' then 1.52 end end::double as radius from a0)
"""


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    v = F.coalesce("value", F.lit(0.0))
    name = _pick(NAMES, F.floor(F.floor(k / 3)))
    file = F.concat(F.lit("F"), F.lpad((F.col("user_id") % 10).cast("string"), 3, "0"))
    rows = e.select(
        k, file.alias("pdb_id"), file.alias("file"), k.alias("line_no"), F.lit("ATOM").alias("rec"), k.cast("int").alias("serial"), name.alias("atom_name"), _pick(ALTLOCS, k).alias("altloc"),
        _pick(RESIDUES, F.floor(k / 20)).alias("resname"), _pick(["A", "B"], F.floor(k / 200)).alias("chain"), (F.floor(k / 20) % 50).cast("int").alias("resnum"), F.lit("").alias("icode"),
        v.alias("x"), (v * 2).alias("y"), (v * 3).alias("z"), F.lit(1.0).alias("occ"), v.alias("b"), F.lit("").alias("segid"), F.substring(name, 1, 1).alias("element"), F.lit("").alias("charge"), F.lit(0).alias("model"),
    )
    return T.classify(rows)


@query(f"with {ATOMS_SQL} select event_id, cls, atom_name in ('N', 'CA', 'C', 'O') backbone, radius, case when resname = 'MSE' then 'Selenomethionine' else '' end ptm, case when resname = 'MSE' then 'S' else 'N' end ptm_code from a where cls not in ('hydrogen', 'water') and radius is not null and cls in ('amino', 'modified', 'nucleic', 'ion')")
def atom_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and radii of accepted atoms of amino acids, nucleotides and ions."""
    return T.of_types(T.accept(_atoms(spark, sf_dir)), "ADI").select("event_id", "cls", "backbone", "radius", "ptm", "ptm_code")


@query(f"with {ATOMS_SQL} select event_id, case when resname = 'MSE' then 'MET' else resname end resname, case when resname = 'MSE' and cls = 'modified' then 'amino' else cls end cls from a where not (resname = 'MSE' and atom_name = 'H1')")
def modified_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.convert_modified(_atoms(spark, sf_dir)).select("event_id", "resname", "cls")


RESIDX_SQL = f"""
{ATOMS_SQL},
n0 as (select *, case when lag(chain) over w is not distinct from chain and lag(resnum) over w is not distinct from resnum and row_number() over w > 1 then 0 else 1 end as new from a window w as (partition by file order by event_id)),
n as (select *, sum(new) over (partition by file order by event_id)::bigint as residx from n0)
"""


@query(f"with {RESIDX_SQL} select event_id, residx from n")
def residue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.number_residues(_atoms(spark, sf_dir)).select("event_id", "residx")


LOCATION_SQL = f"""
{RESIDX_SQL},
loc as (select file, residx, altloc as location, min(event_id) first_line from n where altloc <> '' group by 1, 2, 3),
two as (select *, count(*) over (partition by file, residx) k, row_number() over (partition by file, residx order by first_line) o from loc),
s as (select n.*, coalesce(location, '') location, coalesce(o = 1, true) as primary_ from n left join (select * from two where k > 1) t on n.file = t.file and n.residx = t.residx where location is null or altloc = '' or altloc = location)
"""


@query(f"with {LOCATION_SQL} select event_id, location, primary_ from s")
def atom_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues with several locations once per location."""
    return T.split_locations(T.number_residues(_atoms(spark, sf_dir))).select("event_id", "location", F.col("primary").alias("primary_"))


@query(f"""
with {LOCATION_SQL},
g as (select file, residx, any_value(chain) as chain, any_value(resnum)::int resnum, any_value(resname) resname, count(*) n_atoms, round(avg(v), 6) b_avg, count(*) filter (atom_name in ('N', 'CA', 'C', 'O')) n_backbone
  from s where primary_ group by 1, 2)
select file, residx, chain, resnum, resname, n_atoms, b_avg, n_backbone, row_number() over (partition by file, chain order by residx)::int nth from g where resname in ('GLY', 'ALA', 'MSE')
""")
def residue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary residues rolled up, amino acids counted along their chain."""
    atoms = T.split_locations(T.number_residues(_atoms(spark, sf_dir)))
    res = T.residues(atoms.filter("primary").withColumn("cls", F.when(F.col("resname").isin("GLY", "ALA"), "amino").when(F.col("resname") == "MSE", "modified").otherwise("other")))
    return T.nth_residue(res).select("file", "residx", "chain", "resnum", "resname", "n_atoms", F.round("b_avg", 6).alias("b_avg"), "n_backbone", "nth")


@query(f"""
with {RESIDX_SQL},
g as (select file, residx, any_value(resname) resname, count(*) n, count(*) filter (atom_name in ('N', 'CA', 'C', 'O')) bb from n where cls = 'amino' group by 1, 2)
select file pdb_id, round(avg(case when n < case resname when 'GLY' then 4 else 5 end then 1.0 else 0.0 end), 6) incomplete, round(avg(case when n = 1 then 1.0 else 0.0 end), 6) single_atom, round(avg(case when n = bb and resname <> 'GLY' then 1.0 else 0.0 end), 6) backbone_only from g group by 1
""")
def residue_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = T.number_residues(_atoms(spark, sf_dir)).filter("cls = 'amino'").withColumns({"location": F.lit(""), "primary": F.lit(True)})
    return T.completeness(T.residues(atoms)).select("pdb_id", *[F.round(c, 6).alias(c) for c in ("incomplete", "single_atom", "backbone_only")])


@query(f"""
with {ATOMS_SQL}, c as (select file, string_agg(chain || ':' || n, ',' order by chain) chains from (select file, chain, count(*) n from a group by 1, 2) group by 1)
select a.file pdb_id, count(*) n_atoms, count(*) filter (cls = 'amino') n_amino, count(*) filter (cls = 'water') n_water, count(*) filter (cls = 'hydrogen') n_hydrogen, count(*) filter (altloc <> '') n_altloc, count(distinct chain) n_chains,
  min(v) filter (cls not in ('water', 'hydrogen')) tempf_min, max(v) filter (cls not in ('water', 'hydrogen')) tempf_max, round(avg(v) filter (cls not in ('water', 'hydrogen')), 6) tempf_avg, chains from a join c on a.file = c.file group by a.file, chains
""")
def structure_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.structure_stats(_atoms(spark, sf_dir))
    text = F.array_join(F.transform(F.map_entries("atoms_per_chain"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return s.select("pdb_id", "n_atoms", "n_amino", "n_water", "n_hydrogen", "n_altloc", "n_chains", "tempf_min", "tempf_max", F.round("tempf_avg", 6).alias("tempf_avg"), text.alias("chains"))


@query(f"""
with {ATOMS_SQL} select event_id line_no, file pdb_id, atom_name, altloc, resname, chain, resnum::int resnum, round(v, 3) + 0.0 x, round(v * 2, 3) + 0.0 y, round(v * 3, 3) + 0.0 z, element from a
""")
def coordinate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms written as fixed-column lines and parsed again."""
    a = _atoms(spark, sf_dir).withColumn("serial", F.col("serial") % 100_000)
    lines = a.select("file", "line_no", sinks.atom_line().alias("line"))
    return R.atoms(lines).select("line_no", "pdb_id", "atom_name", "altloc", "resname", "chain", "resnum", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "element")


@query("select 'c' || conv_id as file, turn seq, (turn % 1000)::varchar resnum, upper(left(role, 1)) as chain, case when turn % 3 = 0 then '_' else upper(right(role, 1)) end code from conversations")
def secondary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary-structure table lines of conversations: a blank code is an underscore."""
    c = table(spark, sf_dir, "conversations")
    file = F.concat(F.lit("c"), _text("conv_id"))
    code = F.when(F.col("turn") % 3 == 0, " ").otherwise(F.upper(F.substring("role", -1, 1)))
    number = F.lpad((F.col("turn") % 1000).cast("string"), 5, " ")
    row = F.concat(F.lpad(_text("turn"), 5, " "), number, F.lit(" "), F.upper(F.substring("role", 1, 1)), F.lit(" A"), code, F.lit("        "))
    lines = c.select(file.alias("file"), F.col("turn").alias("line_no"), row.alias("line"))
    head = c.select(file.alias("file"), F.lit(-1).cast("long").alias("line_no"), F.lit("  #  RESIDUE AA").alias("line")).distinct()
    return R.secondary(lines.unionByName(head)).select("file", "seq", "resnum", "chain", "code")


@query("select 'c' || c_custkey as file, 'PART ' || c_custkey || ' OF ' || c_name as title, upper(c_mktsegment) as method, round(2 + (c_custkey % 30) / 10.0, 2) as resolution, (c_custkey % 9999)::int organism_taxid from customer")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure headers from lines: two title lines, a method, a resolution, an organism."""
    c = table(spark, sf_dir, "customer")
    file = F.concat(F.lit("c"), _text("c_custkey"))
    lines = [
        F.concat(F.lit("TITLE     PART "), _text("c_custkey")), F.concat(F.lit("TITLE    2OF "), "c_name"), F.concat(F.lit("EXPDTA    "), F.upper("c_mktsegment")),
        F.concat(F.lit("REMARK   2 RESOLUTION.    "), F.format_string("%.2f", 2 + (F.col("c_custkey") % 30) / 10.0), F.lit(" ANGSTROMS.")),
        F.concat(F.lit("SOURCE   3 ORGANISM_TAXID: "), (F.col("c_custkey") % 9999).cast("string"), F.lit(";")), F.lit("ATOM      1  N"),
    ]
    rows = c.select(file.alias("file"), F.posexplode(F.array(*lines)).alias("line_no", "line"))
    return R.metadata(rows).select("file", "title", "method", "resolution", "organism_taxid")


@query("select 'n' || n_nationkey as file, 1 + n_nationkey % 3 as num, 'A,' || chr((66 + n_nationkey)::int) as chains, 1 as n_matrices, (n_nationkey * 1.5)::double shift from nation")
def assembly_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assemblies from remark lines: number, chains over two lines, matrices."""
    n = table(spark, sf_dir, "nation")
    row = lambda k, v: F.concat(F.lit(f"REMARK 350   BIOMT{k}   1  {' '.join('1.000000' if j == k - 1 else '0.000000' for j in range(3))} "), F.format_string("%.5f", v))
    shift = F.col("n_nationkey") * 1.5
    lines = [
        F.concat(F.lit("REMARK 350 BIOMOLECULE: "), (1 + F.col("n_nationkey") % 3).cast("string")), F.lit("REMARK 350 APPLY THE FOLLOWING TO CHAINS: A,"),
        F.concat(F.lit("REMARK 350                    AND CHAINS: "), F.char(F.col("n_nationkey") + 66)), row(1, shift), row(2, F.lit(0.0)), row(3, F.lit(0.0)),
    ]
    rows = n.select(F.concat(F.lit("n"), _text("n_nationkey")).alias("file"), F.posexplode(F.array(*lines)).alias("line_no", "line"))
    return R.assemblies(rows).select("file", "num", F.array_join("chains", ",").alias("chains"), F.size("matrices").alias("n_matrices"), F.col("matrices")[0][0][3].alias("shift"))


# Headers and texts.


@query("""
select event_id, 'db' as db, '3-4' as poi, 'AB/CD' as poiseq, event_type clv, event_id::varchar netsurf, 'GENE,POISEQ' as reserved, 'E' || user_id || '_' || event_id as entry, 'E' || user_id as entry_id, event_id::int as rank from events
""")
def header_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    header = F.concat(F.lit("db|POI:3-4|POISEQ:AB/CD|CLV:"), "event_type", F.lit("|NETSURF:"), _text("event_id"), F.lit("|GENE:x"))
    key = H.entry_key(F.concat(F.lit("E"), _text("user_id")), F.col("event_id"))
    rows = e.select("event_id", H.header_fields(header).alias("h"), F.array_join(F.array_sort(F.array_union(H.reserved_keys(H.custom_values(header)), F.array(F.lit("POISEQ")))), ",").alias("reserved"), key.alias("entry"))
    entry, rank = H.entry_of(F.col("entry"))
    return rows.select("event_id", "h.*", "reserved", "entry", entry.alias("entry_id"), rank.alias("rank"))


@query(f"""
with p as (select *, {_pick_sql(["A", "B", "C", "D"], "p_partkey")} ch from part)
select p_partkey, {_pick_sql(["AGS", "GX", "WKMV"], "p_partkey")} letters, {_pick_sql(["g", "A", "b"], "p_partkey")} chain, {_pick_sql(["GG", "A", "BB"], "p_partkey")} file_chain,
  case when p_partkey % 2 = 0 then p_size end as number, p_partkey % 2 = 1 as failed, p_name || '_x_y' remark, p_name || '  a_b' description, p_size::bigint series, 'img' || lpad(p_size::varchar, 20, '0') || 'b' as natural_name,
  round(case when p_partkey = 0 then 0 else p_size * 100.0 / p_partkey end, 6) pct, p_name sequence_id,
  case when p_size = 1 then 100.0 when ch = 'A' then 0.0 when p_size = 2 then 95.0 when ch = 'B' then 20.0 when ch = 'C' then 25.0 else 70.0 + ascii('D') % 11 end::double colour from p
""")
def text_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, chains, casts, remarks, series numbers, percentages and view colours."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    number, failed = H.typed_cast(F.when(k % 2 == 0, _text("p_size")).otherwise(F.col("p_name")), "i")
    chain = _pick(["A", "B", "C", "D"], k)
    return p.select(
        "p_partkey", H.three_to_one(_pick(["alaGLYser", "GLYxyz", "TRPLYSMETVAL"], k)).alias("letters"), H.real_chain(_pick(["GG", "A", "BB"], k)).alias("chain"), H.filename_chain(_pick(["g", "A", "b"], k)).alias("file_chain"),
        number.alias("number"), failed.alias("failed"), H.remark_text(F.concat("p_name", F.lit(",x;y"))).alias("remark"), H.fasta_description(F.concat("p_name", F.lit(" POI:3-4 a,b"))).alias("description"),
        H.series_number(F.concat(F.lit("img7_"), _text("p_size"), F.lit(".txt"))).alias("series"), H.natural_key(F.concat(F.lit("Img"), _text("p_size"), F.lit("b"))).alias("natural_name"),
        F.round(H.percentage(F.col("p_size"), k), 6).alias("pct"), H.real_sequence_id(F.concat("p_name", F.lit(":"), _text("p_size"))).alias("sequence_id"),
        H.view_colour(F.col("p_size") == 1, chain, F.lit("A"), F.col("p_size") == 2, F.array(F.lit("B"), F.lit("C"))).alias("colour"),
    )


@query("select p_partkey, case when k = 1 then p_brand else p_brand || '_' || k end uid from (select *, row_number() over (partition by p_brand order by p_partkey) k from part)")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.add_unique(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "uid").select("p_partkey", "uid")


@query("select p_brand as id, arg_min(p_type, p_partkey) gene, arg_min(p_name, p_partkey) || ' x' description from part group by 1")
def gene_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    header = F.concat(F.lit("sp|"), "p_brand", F.lit("_Pos"), _text("p_size"), F.lit("|"), "p_name", F.lit(" x OS=y GN="), "p_type", F.lit(" PE=1"))
    return H.gene_dimension(p.select(header.alias("header"), F.col("p_partkey").alias("line_no")))


@query("select p_partkey, unnest([p_partkey] || range(p_partkey + 2, p_partkey + 3 + p_size % 4))::int as n from part")
def derangify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(k.cast("string"), F.lit(", "), (k + 2).cast("string"), F.lit("-"), (k + 2 + F.col("p_size") % 4).cast("string"))
    return p.select("p_partkey", F.explode(H.derangify(text)).alias("n"))


# Pairs.


@query(f"""
select o_orderkey, least(o_custkey % 130, 100) align_score from orders where o_totalprice >= 100000 and least(o_custkey % 130, 100) >= 70 and substring({_pick_sql(["A-C", "ABC", "AB-"], "o_orderkey")}, 1, 1) <> '-' and substring({_pick_sql(["A-C", "ABC", "AB-"], "o_orderkey")}, 2, 1) <> '-'
""")
def pair_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit score, alignment score rounded down to tens, and no gap at the site or after it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("bitscore"), (F.col("o_custkey") % 130).alias("align_score"), _pick(["A-C", "ABC", "AB-"], F.col("o_orderkey")).alias("t"))
    kept = P.alignment_filter(P.bitscore_filter(o, cutoff=100000), cutoff=75)
    return kept.filter(P.no_gap_at("t", F.lit(1))).select("o_orderkey", "align_score")


@query("""
with p as (select o_orderkey from orders join customer on o_custkey = c_custkey where c_acctbal < 1000), a as (select l_orderkey, max(l_quantity) best from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, best, null::bigint missing from p join a on o_orderkey = l_orderkey union all select null, null, count(*) from p where o_orderkey not in (select l_orderkey from a)
""")
def pairs_with_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of poor customers with their best returned line, and one row with the count of those without."""
    pois = table(spark, sf_dir, "customer").filter("c_acctbal < 1000").select(F.col("c_custkey").alias("entry_id"))
    pairs = P.with_pois(pois, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), "o_orderkey"))
    best = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("best"))
    found, missing = P.with_alignments(pairs, best, ["o_orderkey"])
    return P.union_results(found.select("o_orderkey", "best"), missing).select("o_orderkey", "best", "missing")


@query("""
with g as (select o_custkey, coalesce(list_sort(list_distinct(list(left(o_orderpriority, 1)) filter (o_orderkey % 2 = 0))), []) a, coalesce(list_sort(list_distinct(list(left(o_orderpriority, 1)) filter (o_orderkey % 2 = 1))), []) b from orders group by 1)
select o_custkey, array_to_string(list_sort(list_intersect(a, b)), ',') both_, array_to_string(list_sort(list_distinct(a || b)), ',') either_, list_has_any(a, b) touch from g
""")
def chain_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("c", F.substring("o_orderpriority", 1, 1))
    some = lambda k: F.collect_set(F.when(F.col("o_orderkey") % 2 == k, F.col("c")))
    g = o.groupBy("o_custkey").agg(some(0).alias("a"), some(1).alias("b")).withColumn("s", P.chain_sets(F.col("a"), F.col("b")))
    return g.select("o_custkey", F.array_join("s.both", ",").alias("both_"), F.array_join("s.either", ",").alias("either_"), "s.touch")


@query("select o_orderkey, length(o_orderpriority)::int n from orders")
def distinct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that runs once for each distinct text."""
    search = lambda d: d.select("o_orderpriority", F.length("o_orderpriority").alias("n"))
    return P.distinct_queries(table(spark, sf_dir, "orders"), "o_orderpriority", search).select("o_orderkey", "n")


@query("""
with s as (select p_brand, p_size % 4 as chain, string_agg(upper(left(p_name, 1)), '' order by p_partkey) seq from part group by 1, 2),
j as (select a.p_brand, a.chain, b.chain as other, a.seq s1, b.seq s2, least(length(a.seq), length(b.seq)) n from s a join s b on a.p_brand = b.p_brand and a.chain <> b.chain),
i as (select p_brand, chain, other, n, (select count(*) from range(1, n + 1) r(k) where substring(s1, k::int, 1) = substring(s2, k::int, 1)) same from j)
select p_brand, chain, other, round(same * 100.0 / n, 6) identity from i where same * 100.0 / n >= 20
""")
def duplicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 4).alias("chain")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.upper(F.substring("p_name", 1, 1)).alias("c")))).alias("l"))
    seqs = p.select("p_brand", "chain", F.array_join(F.transform("l", lambda s: s["c"]), "").alias("seq"))
    return T.duplicate_chains(seqs, ["p_brand"], 20.0).select("p_brand", "chain", "other", F.round("identity", 6).alias("identity"))


@query("select count(*) filter (event_type not in ('error', 'view')) dssp_full, count(*) filter (event_type = 'error') dssp_unknown, count(*) filter (event_type = 'view') dssp_gapped, count(*) filter (event_id % 3 = 0) with_assembly, count(*) filter (event_id % 5 <> 0) with_gene, count(*) as n_rows from events")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("event_type") == "error", "Unknown").when(F.col("event_type") == "view", "HH*??").otherwise("HHT*SS").alias("dssp"), F.when(F.col("event_id") % 3 == 0, 1).alias("assembly"), F.when(F.col("event_id") % 5 == 0, "-").otherwise("g").alias("gene"))
    return T.coverage(rows).withColumnRenamed("rows", "n_rows")


# Alignments and scores.

LETTERS_SQL = "[ACDEFGHIKLMNPQRSTVWY]"


@query(f"""
with r as (select p_partkey, upper(replace(p_name, ' ', '-')) q, upper(replace(p_type || p_name, ' ', '-')) t from part),
c as (select *, list_filter(range(1, length(q) + 1), lambda i: regexp_matches(substring(q, i::int, 1), '{LETTERS_SQL}'))[3]::int col from r)
select p_partkey, length(regexp_replace(left(t, col - 1), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))::int as position, substring(t, col, 1) letter,
  lpad(right(replace(left(t, col), '-', ''), 5), 5, '-') || '*' || rpad(left(replace(substring(t, col + 1), '-', ''), 5), 5, '-') around,
  upper(lpad(substring(t, greatest(col - 4, 1), least(col, 5)), 5, '-') || '*' || rpad(substring(t, col + 1, 5), 5, '-')) context
from c where col is not null and substring(t, col, 1) not in ('-', '')
""")
def sites_in_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of the third letter of a query row, the target's letter there, its number and its surroundings."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.translate("p_name", " ", "-")).alias("q"), F.upper(F.translate(F.concat("p_type", "p_name"), " ", "-")).alias("t"))
    t, q = F.col("t"), F.col("q")
    columns = F.filter(F.sequence(F.lit(1), F.length(q)), lambda k: F.substring(q, k, F.lit(1)).rlike(LETTERS_SQL))
    rows = p.withColumn("s", A.site_in_target(t, q, F.lit(3), positions=1)).filter("s is not null")
    return rows.select("p_partkey", "s.position", "s.letter", A.surroundings(t, F.try_element_at(columns, F.lit(3))).alias("around"), "s.context")


@query("""
with w as (select a.p_partkey, list_distinct(string_split(lower(a.p_name), ' ')) x, list_distinct(string_split(lower(b.p_name), ' ')) y from part a join part b on b.p_partkey = a.p_partkey + 1)
select p_partkey, least(1.0, len(list_intersect(x, y)))::double score, array_to_string(list_sort(list_intersect(x, y)), ',') words from w
""")
def word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words of a part's name and the next one's."""
    p = table(spark, sf_dir, "part")
    both = p.select("p_partkey", "p_name").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_")), "p_partkey")
    score, words = S.word_match(F.col("p_name"), F.col("next_"))
    return both.select("p_partkey", score.alias("score"), words.alias("words"))


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 w, l_quantity * 2 q, l_extendedprice / 100 b, l_returnflag = 'R' s, l_tax * 20 x, l_linestatus = 'O' u from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((w * 0.2 + greatest(0, least(1, q / 100)) * 0.2 + greatest(0, least(1, b / 500)) * 0.2 + case when s or q > 79.99999 then 0.1 else 0 end + case when x < 1e-4 then 0.5 else greatest(0, least(1, -0.5 * x + 2)) end * 0.3) / case when u then 2 else 1 end, 9) reliability,
  round(case when u then 0.0 else 100.0 / 3 end, 9) flexible from r
""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    codes = F.when(F.col("l_linestatus") == "O", "Unknown").otherwise("HS*H")
    r = S.reliability(F.col("l_discount") * 10, F.col("l_quantity") * 2, F.col("l_extendedprice") / 100, F.col("l_returnflag") == "R", F.col("l_quantity") * 2, F.col("l_tax") * 20, codes)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(r, 9).alias("reliability"), F.round(S.flexibility(codes), 9).alias("flexible"))


@query("""
with l as (select c_custkey, c_nationkey, c_acctbal from customer)
select c_nationkey, round(min(case when c_acctbal >= 0 then c_acctbal end), 6) v_min, round(max(case when c_acctbal >= 0 then c_acctbal end), 6) v_max, round(avg(c_acctbal), 4) v_avg, string_agg(c_acctbal::varchar, ',' order by c_custkey) v_vals from l group by 1
""")
def range_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.site_ranges(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "v", "c_custkey")
    return g.select("c_nationkey", F.round("v_min", 6).alias("v_min"), F.round("v_max", 6).alias("v_max"), F.round("v_avg", 4).alias("v_avg"), F.array_join(F.col("v_vals").cast("array<string>"), ",").alias("v_vals"))


# Points.


@query(f"""
with {PTS}, d as (select a.label, a.vec_id as id, b.vec_id as near, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) d2 from p a join p b on a.label = b.label and a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by label, id order by d2, near) n from d where d2 <= 225)
select label, id, near, round(d2, 6) d2 from k where n = 1
""")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return X.nearest(p, p, ["label"], 15.0).select("label", "id", "near", F.round("d2", 6).alias("d2"))


@query("select a.o_custkey pdb_id, a.o_orderkey % 7 as resnum, a.o_orderkey as chain, b.o_orderkey as twin from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey % 7 = b.o_orderkey % 7 and a.o_orderstatus = b.o_orderstatus and a.o_orderkey <> b.o_orderkey")
def twin_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer that agree in number (mod 7) and status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pdb_id"), (F.col("o_orderkey") % 7).alias("resnum"), F.lit("").alias("icode"), F.col("o_orderstatus").alias("resname"), F.col("o_orderkey").alias("chain"))
    return X.twin_residues(o).select("pdb_id", "resnum", "chain", "twin")


@query(f"""
with {PTS}, n as (select a.vec_id site_id, b.vec_id % 5 as chain from p a join p b on a.label = b.label and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 100)
select site_id, string_agg(distinct chain::varchar, ',' order by chain::varchar) chains from n group by 1
""")
def chains_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.col("label").alias("pdb_id"), F.lit(0).alias("model"), F.col("vec_id").alias("site_id"), (F.col("vec_id") % 5).cast("string").alias("chain"), "x", "y", "z")
    return X.chains_in_range(p, p, 10.0).select("site_id", F.array_join("chains", ",").alias("chains"))


GOLDEN = 60


def _areas_sql(among: str) -> str:
    """Accessible areas on the golden spiral among some of the points, for ``area_contexts``."""
    return f"""
  select q.vec_id, q.label, 4 * pi() * (radius + 1.4) * (radius + 1.4) / {GOLDEN} * count(*) filter (not coalesce(own, false) and not coalesce(other, false)) asa from q left join (
    select q.vec_id, q.k, bool_or(q.res_id = n.res_id) own, bool_or(q.res_id <> n.res_id) other from q join p n on q.label = n.label and q.vec_id <> n.vec_id and ({among})
      and (px-n.x)*(px-n.x) + (py-n.y)*(py-n.y) + (pz-n.z)*(pz-n.z) < (n.radius + 1.4) * (n.radius + 1.4) group by 1, 2) h on q.vec_id = h.vec_id and q.k = h.k group by 1, 2, radius"""


@query(f"""
with {PTS}, s as (select k, cos(k * pi() * (3 - sqrt(5))) * sqrt(greatest(0, 1 - y * y)) ux, y uy, sin(k * pi() * (3 - sqrt(5))) * sqrt(greatest(0, 1 - y * y)) uz from (select k, (2.0::double * k + 1) / {GOLDEN} - 1 as y from range({GOLDEN}) r(k))),
q as (select p.*, k, x + ux * (radius + 1.4) px, y + uy * (radius + 1.4) py, z + uz * (radius + 1.4) pz from p, s)
select vec_id, label, 'all' as context, round(asa, 4) asa from ({_areas_sql("true")}) union all select vec_id, label, 'even', round(asa, 4) from ({_areas_sql("n.vec_id % 2 = 0")})
""")
def area_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas on a golden spiral among all points and among those of even number."""
    p = _points(spark, sf_dir)
    a = X.area_contexts(p, {"all": p, "even": p.filter("vec_id % 2 = 0")}, ["label"], X.golden_sphere(GOLDEN), max_radius=2.0, atom="vec_id", residue="res_id")
    return a.select("vec_id", "label", "context", F.round("asa", 4).alias("asa"))


# Sites, structures and reports.

MARKED_SQL = """
m0 as (select doc_id, 'D' || doc_id as acc, regexp_replace(coalesce(text, ''), '[^A-Za-z.]', '', 'g') s from documents where doc_id is not null),
m1 as (select acc, replace(s, '.', '') plain, length(s) - length(replace(s, '.', '')) n_marks, string_split(s, '.') a from m0),
m2 as (select acc, plain, list_sum(list_transform(a[1:k], lambda x: length(x)))::int poi from m1, lateral (select unnest(range(1, len(a))) k))
"""


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sites and rejects of documents whose full stops are markers."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    seq = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z.]", ""), ".", "*")
    rows = d.select(F.concat(F.lit("d|D"), _text("doc_id"), F.lit("|some text")).alias("header"), seq.alias("seq"))
    return M.normalise(rows, H.accession(F.col("header")), "header")


@query(f"""
with {MARKED_SQL}
select distinct acc || '_Pos' || poi as entry_id, poi, lpad(substring(plain, greatest(poi - 6, 0) + 1, poi - greatest(poi - 6, 0)), 6, '-') || '/' || rpad(substring(plain, poi + 1, 6), 6, '-') poiseq from m2 where poi between 1 and length(plain)
""")
def marked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)[0].select("entry_id", "poi", "poiseq")


@query(f"with {MARKED_SQL} select acc, 'no marker' reason from m1 where n_marks = 0 union all select acc, 'position outside the sequence' from m2 where poi < 1 or poi > length(plain)")
def site_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)[1].select("acc", "reason")


@query("""
with a as (select p_brand pdb_id, p_partkey num, unnest([upper(left(p_name, 1)), upper(left(p_type, 1))]) as chain from part), f as (select pdb_id, chain, min(num) as assembly from a group by 1, 2)
select p_brand pdb_id, p_partkey, upper(right(p_name, 1)) as chain, assembly from part left join f on p_brand = pdb_id and upper(right(p_name, 1)) = f.chain
""")
def first_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assembly that holds a chain; none for chains outside all of them."""
    p = table(spark, sf_dir, "part")
    plan = p.select(F.col("p_brand").alias("pdb_id"), F.col("p_partkey").alias("num"), F.array(F.upper(F.substring("p_name", 1, 1)), F.upper(F.substring("p_type", 1, 1))).alias("chains"))
    return X.first_assembly(p.select(F.col("p_brand").alias("pdb_id"), "p_partkey", F.upper(F.substring("p_name", -1, 1)).alias("chain")), plan).select("pdb_id", "p_partkey", "chain", "assembly")


@query("""
with c as (select conv_id, turn, upper(left(role, 1)) code, list(upper(left(role, 1))) over (partition by conv_id order by turn rows between 1 preceding and current row) l, list(upper(left(role, 1))) over (partition by conv_id order by turn rows between 1 following and 2 following) r from conversations),
x as (select conv_id, turn, lpad(array_to_string(l, ''), 2, '?') || '*' || rpad(coalesce(array_to_string(r, ''), ''), 2, '?') d from c)
select s.conv_id, s.turn, coalesce(d, 'Unknown') dssp from (select conv_id, turn + 1 as turn from conversations) s left join x using (conv_id, turn)
""")
def site_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes around the next turn of each turn; unknown after the last."""
    c = table(spark, sf_dir, "conversations")
    codes = c.select(F.col("conv_id").alias("file"), F.lit("A").alias("chain"), _text("turn").alias("resnum"), F.col("turn").alias("seq"), F.upper(F.substring("role", 1, 1)).alias("code"))
    sites = c.select(F.col("conv_id").alias("file"), F.lit("A").alias("chain"), (F.col("turn") + 1).cast("string").alias("resnum"))
    return T.site_secondary(sites, codes, window=4).select(F.col("file").alias("conv_id"), F.col("resnum").cast("long").alias("turn"), "dssp")


@query("select event_id, case when event_type = 'error' then -1.0 else value end area, event_type <> 'view' has_secondary from events where value is not null")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as structures that are mostly backbone (error) or single atoms (view)."""
    e = table(spark, sf_dir, "events").filter("value is not null").select("event_id", F.col("event_type").alias("pdb_id"), F.col("value").alias("area"))
    share = lambda kind: F.when(F.col("pdb_id") == kind, 0.95).otherwise(0.5)
    ratios = e.select("pdb_id").distinct().select("pdb_id", F.lit(0.0).alias("incomplete"), share("view").alias("single_atom"), share("error").alias("backbone_only"))
    return T.quality_gate(e, ratios).select("event_id", "area", "has_secondary")


@query("select p_partkey, ';ALIGNMENT_SCORE:' || p_size || chr(10) || '>' || p_brand || chr(10) || p_name || chr(10) || '>' || p_type || chr(10) || p_name as record from part")
def alignment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sinks.alignment_text("p_size", "p_name", "p_name", "p_brand", "p_type").alias("record"))


@query(f"""
with {ATOMS_SQL} select file, array_to_string(list_sort(list_distinct(list(chain))), ',') chains, '0' as models, array_to_string(list_sort(list_distinct(list(cls))), ',') classes, 'R' as mode, 'C' as modified, 642::int as points, 1.4::double as probe, round(sum(v), 4) total_area from a group by 1
""")
def area_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _atoms(spark, sf_dir).withColumn("asa", F.col("x"))
    return sinks.area_provenance(a, "file", 1.4, 642, "R", "C").withColumn("total_area", F.round("total_area", 4))


@query(f"with {ATOMS_SQL} select file, count(*) n_atoms, count(distinct chain) n_ends, 1::bigint n_closed from a group by 1")
def structure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole structures: atoms, one end for each chain, one for each file."""
    lines = sinks.structure_lines(_atoms(spark, sf_dir).withColumn("serial", F.col("serial") % 100_000), ["file"])
    kind = lambda w: F.count_if(F.startswith("value", F.lit(w)))
    return lines.groupBy("file").agg(kind("ATOM").alias("n_atoms"), kind("TER").alias("n_ends"), kind("END").alias("n_closed"))


@query("select c_name as value from customer union all select s_name from supplier")
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two list files written, joined to one, and read."""
    one, two, whole = (_place(spark) for _ in range(3))
    sinks.write_list(table(spark, sf_dir, "customer"), "c_name", one)
    sinks.write_list(table(spark, sf_dir, "supplier"), "s_name", two)
    sinks.concatenate(spark, [one, two], whole)
    return fasta.lines(spark, whole)


@query("select 'run_' || p_partkey || '.txt' file_name, p_partkey series_no from part where p_partkey >= 50")
def numbered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit("run_"), _text("p_partkey"), F.lit(".txt")), F.concat(F.lit("other_"), _text("p_partkey"), F.lit(".txt")))).alias("file_name"))
    return fasta.series(names, "run_50.txt").select("file_name", "series_no")


@query("select o_custkey, null::varchar as pymol, any_value(o_custkey) same from orders group by 1")
def special_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column filled later, and a strict identity check."""
    o = table(spark, sf_dir, "orders").withColumn("same", F.col("o_custkey"))
    return G.typed_group(o, ["o_custkey"], [("pymol", "special", []), ("same", "check_identity", [])], order_by="o_orderkey", strict=True)


@query("""
with r as (select p_partkey, upper(replace(p_name, ' ', '-')) || p_brand t, upper(replace(p_type || p_name, 'E', '-')) q from part),
k as (select p_partkey, i, substring(t, i::int, 1) t, substring(q, i::int, 1) q, greatest(length(t) - length(q), 0) spare from (select *, unnest(range(1, least(length(t), length(q)) + 1)) i from r)),
f as (select *, t <> '-' and q <> '-' as both_, min(case when t <> '-' and q <> '-' then i end) over (partition by p_partkey) first_, max(case when t <> '-' and q <> '-' then i end) over (partition by p_partkey) last_ from k),
h as (select *, sum(case when t = '-' and q <> '-' and i > first_ and i < last_ then 1 else 0 end) over (partition by p_partkey order by i) held from f),
o as (select *, case when both_ and held > lag(held) over (partition by p_partkey, both_ order by i) then 1 else 0 end as opened from h)
select p_partkey, coalesce(max(last_ - first_ + 1), 0)::int length, coalesce(max(first_) - 1, -1)::int first_, coalesce(max(last_) - 1, -1)::int last_, count(*) filter (both_ and t = q)::int identity_, max(held)::int gaps, (count(*) filter (t <> '-' and q = '-') + max(spare))::int unaligned, sum(opened)::int gap_opens from o group by 1
""")
def alignment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over two gapped rows made of a part's words."""
    p = table(spark, sf_dir, "part")
    t, q = F.concat(F.upper(F.translate("p_name", " ", "-")), "p_brand"), F.upper(F.translate(F.concat("p_type", "p_name"), "E", "-"))
    s = p.select("p_partkey", S.alignment_stats(t, q).alias("s"))
    return s.select("p_partkey", "s.length", F.col("s.first").alias("first_"), F.col("s.last").alias("last_"), F.col("s.identity").alias("identity_"), "s.gaps", "s.unaligned", "s.gap_opens")


@query(f"with {_seeds_sql('select doc_id i, text t from documents', 'doc_id')}, n as (select unnest([0, 1000]) n) select item_id + n query_id, doc_id, diagonal, seeds from seeds, n")
def distinct_seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of repeated queries: the search runs once for each distinct text."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    twice = items.unionByName(items.withColumn("query_id", F.col("query_id") + 1000))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    search = lambda d: W.seed_search(d.select("q", F.col("q").alias("s")), docs, "q", "doc_id", "s", "t", k=12, least=2, most=20)
    return P.distinct_queries(twice, "q", search).select("query_id", "doc_id", "diagonal", "seeds")


@query(f"""
with {CACHE_SQL},
q as (select distinct hash from cache where n_results % 3 > 0),
a as (select 'before' as phase, hash, count, n_results, inserted from cache where hash in (select hash from q) and date_diff('day', inserted, date '{TODAY}') <= 60),
n as (select hash, count, n_results, inserted from cache where n_results = 0 union all select hash, count + 1, n_results, inserted + 1 from cache where n_results > 0
  union all select md5(hash), 5, 2, date '{TODAY}' from cache where n_results = 1)
select * from a
union all select 'after', hash, count, n_results, inserted from n where (hash in (select hash from q) or hash in (select md5(hash) from q)) and date_diff('day', inserted, date '{TODAY}') <= 60
""")
def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written to a stored cache, looked up, upserted with newer and new entries, and looked up again."""
    path, cache, today = _place(spark), _cache(spark, sf_dir), F.lit(TODAY).cast("date")
    C.create(cache, path, "hash", width=1)
    asked = C.read(spark, path).filter("n_results % 3 > 0").select("hash").distinct()
    asked = asked.unionByName(asked.select(F.md5("hash").alias("hash")))
    columns = ["phase", "hash", "count", "n_results", "inserted"]
    before = C.lookup(path, asked, "hash", today).withColumn("phase", F.lit("before")).select(*columns)
    newer = cache.filter("n_results > 0").withColumns({"count": F.col("count") + 1, "inserted": F.date_add("inserted", 1)})
    added = cache.filter("n_results = 1").withColumns({"hash": F.md5("hash"), "count": F.lit(5).cast("long"), "n_results": F.lit(2).cast("long"), "inserted": today})
    C.upsert(path, newer.unionByName(added), "hash")
    return before.unionByName(C.lookup(path, asked, "hash", today).withColumn("phase", F.lit("after")).select(*columns))


# Pieces of the evidence job.


@query(f"""
with {LOCATION_SQL},
g as (select file, residx, any_value(chain) as chain, any_value(resname) resname from s where primary_ group by 1, 2),
n1 as (select *, row_number() over (partition by file, chain order by residx)::int nth from g where resname in ('GLY', 'ALA', 'MSE'))
select a.file || '/' || a.chain || '/' || a.nth spot, b.nth, b.residx, b.resname from n1 a join n1 b on a.file = b.file and a.chain = b.chain and b.nth in (a.nth, a.nth + 1) where a.nth % 7 = 3
""")
def site_residue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residues of sites between two residues: its own and the next of the chain, where there is one."""
    atoms = T.split_locations(T.number_residues(_atoms(spark, sf_dir))).filter("primary")
    kind = F.when(F.col("resname").isin("GLY", "ALA"), "amino").when(F.col("resname") == "MSE", "modified").otherwise("other")
    nth = T.nth_residue(T.residues(atoms.withColumn("cls", kind)))
    spots = nth.filter("nth % 7 = 3").select(F.concat_ws("/", "pdb_id", "chain", F.col("nth").cast("string")).alias("spot"), "pdb_id", "chain", "nth")
    return E.site_residues(spots, nth, 0).select("spot", "nth", "residx", "resname")


EVIDENCE_SQL = """
e as (select 'o' || l_orderkey as seq_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::int as rank, l_partkey, l_linestatus as st, l_returnflag as flag,
  round(l_discount * 100 - 2, 6) as isol, round(l_tax * 100 - 3, 6) as biol, l_quantity as asym, l_quantity - 5 as heat, l_discount * 10 as lo, l_extendedprice / 100 as hi from lineitem)
"""


def _evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as evidence rows: an order is a site, a line a hit."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    l = table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(order))
    own = {
        "seq_id": F.concat(F.lit("o"), _text("l_orderkey")), "rank": F.col("rank"), "dataseries": F.col("l_linestatus"), "gene": F.col("l_returnflag"), "interface": F.col("l_returnflag"), "entry": F.concat(F.lit("o"), _text("l_orderkey"), F.lit("_"), _text("rank")),
        "isol_asa": F.col("l_linestatus"), "isol_asa_avg": F.round(F.col("l_discount") * 100 - 2, 6), "biol_asa_avg": F.round(F.col("l_tax") * 100 - 3, 6), "asym_asa_avg": F.col("l_quantity"),
        "isol_asa_poi_min": F.round(F.col("l_discount") * 100 - 2, 6), "isol_asa_poi_max": F.col("l_quantity"), "tempf_avg": F.col("l_quantity") - 5, "tempf_file_min": F.col("l_discount") * 10, "tempf_file_max": F.col("l_extendedprice") / 100,
        "pdbcode": F.concat(F.lit("p"), _text("l_partkey")), "poi_chain": F.col("l_returnflag"), "align_score": F.col("l_quantity"),
    }
    number = {"bitscore", "identity", "r_free", "resolution", "interface_asa_delta", *[f"{c}_asa_{k}" for c in E.CONTEXTS for k in ("avg", "poi_min", "poi_max")]}
    rest = {c: F.lit(None).cast("double" if c in number else "string") for c in E.EVIDENCE if c not in own}
    return l.select(*[(own | rest)[c].alias(c) for c in E.EVIDENCE])


@query(f"""
with {EVIDENCE_SQL},
v as (select seq_id, flag, count(*) n from e group by 1, 2), w as (select seq_id, st, count(*) n from e group by 1, 2),
v2 as (select seq_id, string_agg(flag, '/' order by flag) interface from (select *, max(n) over (partition by seq_id) m from v) where n = m group by 1),
w2 as (select seq_id, string_agg(st, '/' order by st) decision from (select *, max(n) over (partition by seq_id) m from w) where n = m group by 1),
g as (select seq_id, case when min(st) = max(st) then min(st) end dataseries, arg_min(flag, rank) gene, count(*) n_structures, round(avg(case when isol >= 0 then isol end), 6) isol_asa_avg, round(avg(case when biol >= 0 then biol end), 6) biol_asa_avg,
  round(coalesce(greatest(max(case when isol >= 0 then isol end), max(case when asym >= 0 then asym end)) - least(min(case when isol >= 0 then isol end), min(case when asym >= 0 then asym end)), 0), 6) poi_delta,
  round(coalesce(avg(case when abs(heat) >= 1e-5 then heat end), 0), 6) tempf_poi_avg, round(coalesce(avg(case when lo >= 1e-4 and hi >= 1e-4 and hi - lo >= 1e-4 then (heat - lo) * 100 / (hi - lo) end), -1), 6) tempf_score,
  string_agg(rank::varchar, ',' order by rank) blast_ranks, round(coalesce(avg(case when isol >= 0 then isol end), avg(case when biol >= 0 then biol end), avg(asym)), 6) asa_avg, arg_min('p' || l_partkey || ':' || flag, rank) pymol, round(avg(asym), 6) align_avg from e group by 1)
select g.*, interface, decision, 'o' || case when n_structures = 1 then substring(seq_id, 2) || '_1' else substring(seq_id, 2) end entry, -1.0::double iupred from g join v2 using (seq_id) join w2 using (seq_id)
""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouped report over lines of orders: votes, lists, means, the preferred area and the temperature score."""
    r = E.report(_evidence_rows(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("isol_asa_avg", "biol_asa_avg", "tempf_poi_avg", "tempf_score", "asa_avg", "align_avg")}
    r = r.withColumns(rounded | {"poi_delta": F.round("isol_asa_poi_delta", 6), "decision": F.col("isol_asa_decision"), "blast_ranks": F.array_join(F.col("blast_ranks").cast("array<string>"), ",")})
    return r.select("seq_id", "dataseries", "gene", "n_structures", "interface", "decision", "entry", "blast_ranks", "pymol", "iupred", "poi_delta", *rounded)


@query("""
with h as (select o_orderkey entry_id, o_totalprice b from orders where o_orderkey % 3 > 0), e as (select l_orderkey entry_id, max(l_quantity) ba, count(distinct l_partkey) ns,
  array_to_string(list_sort(list_distinct(list(l_linestatus))), '/') acc, array_to_string(list_sort(list_distinct(list('p' || l_partkey))), ',') st from lineitem group by 1)
select 'o' || o_orderkey entry_id, case when b is null then 0 else 1 end::bigint n_hits, coalesce(b, -1.0) best_bitscore, case when b >= 150000 then 'yes' else 'no' end bitscore_pass, coalesce(ns, 0) n_structures, ba best_alignment, coalesce(acc, '') accessible, coalesce(st, '') structures
from orders left join h on o_orderkey = h.entry_id left join e on o_orderkey = e.entry_id
""")
def overview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row an order, those without hits or evidence included."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), _text("o_orderkey")).alias("entry_id"), "o_orderkey", "o_totalprice")
    hits = o.filter("o_orderkey % 3 > 0").select(F.col("entry_id").alias("query_id"), F.col("o_totalprice").alias("bitscore"))
    return E.overview(o, hits, _evidence_rows(spark, sf_dir), 150_000.0)


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user with attributes as of a header; one is named like a report column."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    header = F.concat(F.lit("u"), _text("user_id"), F.lit("|KIND:"), "event_type", F.lit("|HALF:"), F.floor(F.col("user_id") / 2).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("|GENE:g"), k.cast("string"))).otherwise(""))
    return e.select("user_id", H.custom_values(header).alias("custom"))


@query("""
with g as (select user_id, case when min(event_type) = max(event_type) then min(event_type) end kind, (user_id // 2)::varchar half from events group by 1, 3)
select user_id, kind as "KIND", half as "HALF" from g
""")
def custom_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of headers grouped by user, and made columns."""
    maps, _ = G.typed_map_group(_attributes(spark, sf_dir), ["user_id"], "custom", E.TAKEN)
    return E.with_custom_columns(maps).select("user_id", "KIND", "HALF")


@query("select 'GENE' as name, count(*) n from events where event_id % 3 = 0")
def custom_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that are named like a report column."""
    return E.custom_clashes(_attributes(spark, sf_dir).withColumnRenamed("user_id", "seq_id"))


@query("select conv_id, turn, array_to_string(list(role) over w, ',') before from conversations window w as (partition by conv_id order by turn rows between 2 preceding and current row)")
def neighbours_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn and the two before it."""
    n = T.neighbours_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", -3, "role")
    return n.select("conv_id", "turn", F.array_join("role_near", ",").alias("before"))


@query(f"""
with {ATOMS_SQL}
select event_id, 'A' as mode, case when resname = 'MSE' then 'MET' else resname end resname, case when resname = 'MSE' and cls = 'modified' then 'amino' else cls end cls from a
union all select event_id, 'N', resname, cls from a
""")
def modified_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified residues with all of their atoms, and left as they are."""
    a = _atoms(spark, sf_dir)
    parts = [T.convert_modified(a, mode).withColumn("mode", F.lit(mode)).select("event_id", "mode", "resname", "cls") for mode in "AN"]
    return parts[0].unionByName(parts[1])


# Containers of structure files.


@query(f"with {ATOMS_SQL} select file, count(*) n, round(sum(round(v, 3)), 2) + 0.0 x, count(*) filter (chain = 'B') n_b from a where file in ('F001', 'F004', 'F007') group by 1")
def structure_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures written into containers; the atoms of three of them read back by name."""
    path = _place(spark)
    lines = sinks.structure_lines(_atoms(spark, sf_dir).withColumn("serial", F.col("serial") % 100_000), ["file"])
    R.write_containers(R.texts_of(lines, "file"), path)
    back = R.atoms(R.container_lines(spark, path, ["F001", "F004", "F007", "none"]))
    return back.groupBy("file").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 2) + 0.0).alias("x"), F.count_if(F.col("chain") == "B").alias("n_b"))


@query(f"""
with {ATOMS_SQL} select file || '_1' assembly_id, 2 * count(*) atoms, 2::bigint models, 2::bigint chain_ends, 1::bigint ends from a where chain = 'B' group by 1
""")
def assembly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure text of the copies of one chain in an assembly, written into containers."""
    path, a = _place(spark), _atoms(spark, sf_dir).withColumn("serial", F.col("serial") % 100_000)
    moves = [[[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]], [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 5.0], [0.0, 0.0, 1.0, -2.5]]]
    matrices = F.array(*[F.array(*[F.array(*map(F.lit, r)) for r in m]) for m in moves])
    plan = a.select("pdb_id").distinct().select("pdb_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("num"), F.array(F.lit("A"), F.lit("B")).alias("chains"), matrices.alias("matrices"))
    lines = sinks.assembly_lines(X.assembly_copies(a, plan), chains=["B"], numbers=[1])
    R.write_containers(R.texts_of(lines, "assembly_id"), path)
    kind = F.trim(F.substring("line", 1, 6))
    back = R.container_lines(spark, path).groupBy(F.col("file").alias("assembly_id"))
    return back.agg(F.count_if(kind == "ATOM").alias("atoms"), F.count_if(kind == "MODEL").alias("models"), F.count_if(kind == "TER").alias("chain_ends"), F.count_if(kind == "END").alias("ends"))


@query("""
select 'c' || c_custkey || '.asa' as file, case when c_custkey % 2 = 0 then 'Convert' else 'None' end modifications, (c_custkey % 7)::int n_modified, round(abs(c_acctbal) % 100, 2) + 0.0 area from customer
""")
def area_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of areas that were computed before: their remarks, and the area in the column of the temperature factor."""
    path, c = _place(spark), table(spark, sf_dir, "customer")
    atom = {"rec": F.lit("ATOM"), "serial": F.lit(1), "atom_name": F.lit("CA"), "altloc": F.lit(""), "resname": F.lit("GLY"), "chain": F.lit("A"), "resnum": F.lit(1), "icode": F.lit(""), "x": F.lit(1.0), "y": F.lit(2.0), "z": F.lit(3.0), "occ": F.lit(1.0), "b": F.abs("c_acctbal") % 100, "segid": F.lit(""), "element": F.lit("C"), "charge": F.lit("")}
    mode = F.concat(F.lit("REMARK   1 MODIFICATION MODE: "), F.when(F.col("c_custkey") % 2 == 0, "Convert").otherwise("None"))
    number = F.concat(F.lit("REMARK   1 NUMBER OF MODIFIED RESIDUES: "), (F.col("c_custkey") % 7).cast("string"))
    text = c.withColumns(atom).select(F.concat(F.lit("c"), _text("c_custkey"), F.lit(".asa")).alias("file"), F.concat_ws("\n", mode, number, sinks.atom_line()).alias("value"))
    R.write_containers(text, path)
    areas, notes = R.area_files(R.container_lines(spark, path))
    return areas.join(notes, "file").select("file", "modifications", "n_modified", (F.col("area") + 0.0).alias("area"))


@query(AREA_SQL + "select label::varchar as file, res_id, round(case when sum(sa) = 0 then 0 else sum(asa) * 100 / sum(sa) end, 4) area from a where label >= 3 group by 1, 2")
def unfinished_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue areas of all structures but those that are done."""
    p = _points(spark, sf_dir).withColumns({"file": F.col("label").cast("string"), "model": F.lit(0), "atom_name": F.lit("CA")})
    done = p.filter("label < 3").select("file").distinct()
    rows, _ = X.batch_areas(p, done, POINTS, max_radius=2.0, atom="vec_id", residue="res_id")
    return rows.select("file", "res_id", F.round("area", 4).alias("area"))


@query("select n_nationkey::int nation, (length(n_name) + 1)::bigint length from nation")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text files of a folder of folders, by name and size."""
    path = _place(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    files = fasta.folder(spark, path + "/*", "part-*.txt")
    return files.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("nation"), "length")


@query("""
with c as (select c_custkey, c_custkey % 20 as shift from customer),
p as (select c_custkey, unnest([2, 5, 9, 14]) off from c),
h as (select p.c_custkey, off, o_orderkey, o_totalprice, row_number() over (partition by p.c_custkey, off order by o_orderkey) rank from p join orders on o_custkey = p.c_custkey)
select 'e' || c_custkey || '_' || off || '_' || rank row_id, 'F' || c_custkey || '/A/' || (off + 5) spot, 100 align_score, 20 n_residues, rank::int as rank from h where o_totalprice >= 100000
""")
def located_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with the residue of each hit's chain that their aligned window names, weak hits left out; a customer is a structure of
    twenty different residues, its orders are the hits of four sites."""
    names = {v: k for k, v in reversed(T.AMINO.items())}
    order = sorted(set(T.AMINO.values()))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    at = c.select("c_custkey", F.posexplode(F.array(*map(F.lit, order * 2))).alias("n", "aa1")).filter((F.col("n") >= F.col("c_custkey") % 20) & (F.col("n") < F.col("c_custkey") % 20 + 20))
    res = at.select(
        F.concat(F.lit("F"), _text("c_custkey")).alias("pdb_id"), F.concat(F.lit("F"), _text("c_custkey")).alias("file"), F.lit(0).alias("model"), F.lit("A").alias("chain"), F.col("n").alias("residx"), F.col("n").alias("resnum"),
        F.lit("").alias("icode"), T.lookup(names, F.col("aa1")).alias("resname"), "aa1", F.lit("amino").alias("cls"), F.lit("ATOM").alias("rec"), F.lit(True).alias("primary"),
    )
    cut = F.substring(F.lit("".join(order * 2)), (F.col("c_custkey") % 20 + F.col("off") + 1).cast("int"), (20 - F.col("off")).cast("int"))
    site = c.select("c_custkey", F.explode(F.array(*map(F.lit, (2, 5, 9, 14)))).alias("off")).select("c_custkey", F.concat_ws("_", F.concat(F.lit("e"), _text("c_custkey")), _text("off")).alias("entry_id"), cut.alias("plain"), F.lit(5).alias("poi"))
    ranked = P.rank_hits(site.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")), "entry_id", ["o_orderkey"])
    hits = ranked.select(F.col("entry_id").alias("query_id"), F.concat(F.lit("F"), _text("c_custkey")).alias("pdb_id"), F.lit("A").alias("chain"), F.col("o_totalprice").alias("bitscore"), "rank")
    return E.located(site.drop("c_custkey"), hits, res, 100_000.0, 70, None, 1).select("row_id", "spot", "align_score", "n_residues", "rank")

