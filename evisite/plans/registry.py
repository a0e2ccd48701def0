"""Registered queries: every operator on the driver's tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisite.functions import headers as H
from evisite.functions import scores as S
from evisite.operators import align as A
from evisite.operators import group as G
from evisite.operators import markers as M
from evisite.operators import pairs as P
from evisite.operators import search as W
from evisite.operators import spatial as X
from evisite.operators import structures as T
from evisite.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
LIST_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"""
with v as (select l_orderkey, l_returnflag, count(*) n from lineitem group by 1, 2),
w as (select l_orderkey, string_agg(l_returnflag, '/' order by l_returnflag) flag_vote
      from (select *, max(n) over (partition by l_orderkey) m from v) where n = m group by 1),
g as (
  select l_orderkey, count(*) n_lines, arg_min(l_partkey, ({LIST_ORDER})) first_part, round(avg(l_quantity), 6) avg_qty,
    round(coalesce(avg(case when abs(l_discount) >= 1e-5 then l_discount end), 0), 6) avg_discount, round(avg(case when l_tax >= 0 then l_tax end), 6) avg_tax,
    min(l_quantity) min_qty, max(l_quantity) max_qty, string_agg(cast(l_partkey as varchar), ',' order by {LIST_ORDER}) parts,
    array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') statuses, round(greatest(max(l_discount), max(l_tax)) - least(min(l_discount), min(l_tax)), 6) width,
    round(max(l_quantity) - min(l_quantity), 6) qty_delta, round(sum(l_extendedprice), 4) total,
    case when min(l_linestatus) = max(l_linestatus) then min(l_linestatus) end one_status
  from lineitem group by 1)
select g.*, flag_vote from g join w using (l_orderkey)
""")
def typed_group_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed group-by with every aggregate over the lines of an order."""
    spec = [
        ("n_lines", "count", []), ("first_part", "1st", ["l_partkey"]), ("avg_qty", "avg", ["l_quantity"]), ("avg_discount", "avg_nozeroes", ["l_discount"]), ("avg_tax", "avg_no_negatives", ["l_tax"]),
        ("min_qty", "min", ["l_quantity"]), ("max_qty", "max", ["l_quantity"]), ("parts", "list", ["l_partkey"]), ("statuses", "set", ["l_linestatus"]), ("width", "delta", ["l_discount", "l_tax"]),
        ("qty_delta", "delta_no_negatives", ["l_quantity"]), ("total", "sum", ["l_extendedprice"]), ("one_status", "check_identity", ["l_linestatus"]), ("flag_vote", "vote", ["l_returnflag"]),
    ]
    g = G.typed_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], spec, order_by=ORDER)
    rounded = {c: F.round(c, 6) for c in ("avg_qty", "avg_discount", "avg_tax", "width", "qty_delta")} | {"total": F.round("total", 4)}
    return g.withColumns({"parts": F.array_join(F.col("parts").cast("array<string>"), ","), "statuses": F.array_join("statuses", ","), **rounded})


@query("""
with v as (select l_suppkey, l_returnflag, count(*) n from lineitem group by 1, 2)
select l_suppkey, string_agg(l_returnflag, '/' order by l_returnflag) flag from (select *, max(n) over (partition by l_suppkey) m from v) where n = m group by 1
""")
def vote_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vote(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "flag")


@query("""
with g as (select p_brand, min(p_name) a, max(p_name) b from part group by 1),
n as (select *, (select max(k) from range(0, least(length(a), length(b)) + 1) t(k) where left(a, k::int) = left(b, k::int)) k from g)
select p_brand, regexp_replace(left(a, k::int), '[ _]+$', '') prefix from n
""")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.typed_group(table(spark, sf_dir, "part"), ["p_brand"], [("prefix", "matching", ["p_name"])], order_by="p_partkey")


@query("select l_orderkey, case when min(l_linestatus) = max(l_linestatus) then min(l_linestatus) end status from lineitem group by 1")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.typed_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [("status", "check_identity", ["l_linestatus"])], order_by=ORDER)


@query("""
with b as (select c_nationkey k, c_acctbal v from customer union all select s_nationkey, s_acctbal from supplier)
select k, round(coalesce(avg(case when abs(v) >= 1e-5 then v end), 0), 4) nonzero, round(avg(case when v >= 0 then v end), 4) positive,
  round(coalesce(max(case when v >= 0 then v end) - min(case when v >= 0 then v end), 0), 4) spread from b group by 1
""")
def avg_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = b.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")))
    g = G.typed_group(b, ["k"], [("nonzero", "avg_nozeroes", ["v"]), ("positive", "avg_no_negatives", ["v"]), ("spread", "delta_no_negatives", ["v"])], order_by="v")
    return g.withColumns({c: F.round(c, 4) for c in ("nonzero", "positive", "spread")})


@query("""
with r as (select event_type, min(value) lo, max(value) hi from events group by 1)
select user_id, round(coalesce(avg(case when lo >= 1e-4 and hi >= 1e-4 and hi - lo >= 1e-4 then (value - lo) * 100.0 / (hi - lo) end), -1.0), 4) score
from events join r using (event_type) group by 1
""")
def tempf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(r, "event_type").groupBy("user_id").agg(F.round(S.temperature_score(F.col("value"), F.col("lo"), F.col("hi")), 4).alias("score"))


@query("""
select c_custkey, coalesce(case when c_acctbal >= 0 then c_acctbal end, case when b >= 0 then b end, case when t >= 0 then t end) area
from customer left join (select s_nationkey, min(s_acctbal) b from supplier group by 1) on c_nationkey = s_nationkey
left join (select o_custkey, max(o_totalprice) t from orders group by 1) on c_custkey = o_custkey
""")
def preferred_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_acctbal").alias("b"))
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"))
    return c.join(b, "c_nationkey", "left").join(t, "c_custkey", "left").select("c_custkey", S.preferred(F.col("c_acctbal"), F.col("b"), F.col("t")).alias("area"))


@query("""
with c as (select least(floor(l_quantity * 2 / 10), 10)::int b, count(*) n from lineitem group by 1)
select k::int as bin, coalesce(n, 0) n, k * 10 >= 70 passed from range(11) t(k) left join c on k = b
""")
def histogram11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.histogram(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2).alias("s")), "s", cutoff=70.0)


@query("""
with o as (select l_orderkey, count(*) filter (l_quantity >= 25) p, count(*) filter (l_quantity < 25) f from lineitem group by 1)
select sum(p)::bigint passed, sum(f)::bigint failed, 0::bigint unknown, round(sum(p) * 100.0 / sum(p + f), 6) passed_pct, round(sum(f) * 100.0 / sum(p + f), 6) failed_pct, 0.0::double unknown_pct,
  count(*) records, count(*) filter (p > 0) records_passed from o
""")
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.filter_report(table(spark, sf_dir, "lineitem"), "l_quantity", 25.0, "l_orderkey")
    return r.withColumns({c: F.round(c, 6) for c in ("passed_pct", "failed_pct", "unknown_pct")})


@query(f"""
with r as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, {LIST_ORDER}) rank from lineitem),
d as (select *, row_number() over (partition by l_orderkey, l_returnflag order by rank) k from r)
select l_orderkey, l_returnflag, rank from (select *, row_number() over (partition by l_orderkey order by rank) n from d where k = 1) where n <= 2
""")
def rank_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks before filters, first of each subject, two of each query."""
    ranked = P.rank_hits(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.col("l_extendedprice").desc(), *ORDER])
    once = P.dedup_hits(ranked, "l_orderkey", ["l_returnflag"])
    return P.top_k(once, ["l_orderkey"], [F.col("rank")], 2).select("l_orderkey", "l_returnflag", F.col("rank").cast("long").alias("rank"))


@query("""
with c as (select *, case when event_type = lag(event_type) over w then 0 else 1 end ch from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(ch) over (partition by user_id order by ts, event_id) run from c)
select user_id, event_id, event_type, run::bigint run from r where ch = 1 and run <= 3
""")
def consecutive_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collapse_limit(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 3).select("user_id", "event_id", "event_type", "run")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def obsolete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return P.without_obsolete(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.only_new(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("select distinct o_orderkey from orders except select l_orderkey from lineitem where l_quantity > 25")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line of more than 25 pieces."""
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.missing_ids(table(spark, sf_dir, "orders"), large, "o_orderkey")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).alias("hash")).agg(F.count("*").alias("count"), F.count_if(F.col("value") > 50).alias("n_results"), F.max("props").alias("results"), F.to_date(F.max("ts")).alias("inserted"))


CACHE_SQL = "cache as (select md5(concat_ws('/', user_id::varchar, event_type)) hash, count(*) count, count(*) filter (value > 50) n_results, max(props) results, max(ts)::date inserted from events group by 1)"
TODAY = "2024-02-15"


@query(f"with {CACHE_SQL} select u.user_id, event_type, hash, n_results, inserted from (select distinct user_id, event_type, md5(concat_ws('/', user_id::varchar, event_type)) hash from events) u join cache using (hash) where date_diff('day', inserted, date '{TODAY}') <= 60 and (count >= 2 or n_results >= 2)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "events").select("user_id", "event_type", F.md5(F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).alias("hash")).distinct()
    return P.cache_lookup(q, _cache(spark, sf_dir), "hash", F.lit(TODAY).cast("date"), wanted=2).select("user_id", "event_type", "hash", "n_results", "inserted")


@query(f"with {CACHE_SQL}, n as (select hash, count + 1 as count, n_results, results, inserted + 1 as inserted from cache where n_results > 0) select hash, count, n_results, inserted from n union all select hash, count, n_results, inserted from cache where n_results = 0")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    new = cache.filter("n_results > 0").withColumns({"count": F.col("count") + 1, "inserted": F.date_add("inserted", 1)})
    return P.cache_upsert(cache, new, "hash").select("hash", "count", "n_results", "inserted")


@query(f"with {CACHE_SQL} select hash, inserted from cache where date_diff('day', inserted, date '{TODAY}') between 1 and 30 and n_results > 0")
def cache_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cache_retain(_cache(spark, sf_dir), F.lit(TODAY).cast("date"), older_than=30, newer_than=1, drop_empty=True).select("hash", "inserted")


@query(f"with {CACHE_SQL} select hash, inserted from cache where date_diff('day', inserted, date '{TODAY}') > 20")
def cache_old_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cache_listing(_cache(spark, sf_dir), F.lit(TODAY).cast("date"), "old", 20).select("hash", "inserted")


@query("""
with h as (select o_custkey entry_id, count(*) n, max(o_totalprice) b from orders group by 1),
e as (select o_custkey entry_id, count(distinct l_suppkey) ns, max(l_quantity) ba, array_to_string(list_sort(list_distinct(list(l_returnflag))), '/') acc,
  array_to_string(list_sort(list_distinct(list(l_suppkey::varchar))), ',') st from orders join lineitem on o_orderkey = l_orderkey group by 1)
select c_custkey entry_id, coalesce(n, 0) n_hits, coalesce(b, -1.0) best_bitscore, case when b >= 100000 then 'yes' else 'no' end bitscore_pass, coalesce(ns, 0) n_structures,
  ba best_alignment, coalesce(acc, '') accessible, coalesce(st, '') structures from customer left join h on c_custkey = h.entry_id left join e on c_custkey = e.entry_id
""")
def summary_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), "o_orderkey", F.col("o_totalprice").alias("bitscore"))
    e = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("entry_id", F.col("l_suppkey").cast("string").alias("struct_id"), F.col("l_quantity").alias("align_score"), F.col("l_returnflag").alias("decision"))
    return G.summary(s, o, e, 100000.0)


@query("""
select n_nationkey, coalesce(r_name, '-') gene, coalesce(d, -1.0) disorder from nation left join (select r_regionkey, r_name from region where r_regionkey < 3) on n_regionkey = r_regionkey
left join (select s_nationkey, max(s_acctbal) d from supplier group by 1) on n_nationkey = s_nationkey
""")
def gene_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"))
    g = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("gene"))
    d = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("disorder"))
    return P.with_disorder(P.with_genes(n, g, "k"), d, "n_nationkey").select("n_nationkey", "gene", "disorder")


DOC_SITES = """
c as (select doc_id, regexp_replace(text, '[\\s-]+', '', 'g') t from documents where doc_id is not null),
p as (select doc_id, t, replace(t, '.', '') as plain, string_split(t, '.') a from c),
m as (select doc_id, plain, k - 1 as marker_no, list_sum(list_transform(a[1:k], lambda x: length(x)))::int poi from p, lateral (select unnest(range(1, len(a))) k))
"""


@query(f"with {DOC_SITES} select doc_id, marker_no::int marker_no, poi from m")
def markers_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.explode_markers(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ".").select("doc_id", "marker_no", "poi")


@query(f"with {DOC_SITES} select doc_id, poi, lpad(substring(plain, greatest(poi - 6, 0) + 1, poi - greatest(poi - 6, 0)), 6, '-') before, rpad(substring(plain, poi + 1, 6), 6, '-') after from m")
def flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.explode_markers(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ".")
    left, right = H.flanks(F.col("plain"), F.col("poi"))
    return m.select("doc_id", "poi", left.alias("before"), right.alias("after"))


@query("""
with t as (select doc_id, text, 1 + (doc_id * 37) % greatest(length(text), 1) poi from documents where text is not null)
select doc_id, substring(text, (greatest(0, least(poi - 10, length(text) - 20)) + 1)::bigint, 20) query_window, substring(text, (greatest(0, poi - 5) + 1)::bigint, 10) align_window from t
""")
def windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("poi", (1 + (F.col("doc_id") * 37) % F.greatest(F.length("text"), F.lit(1))).cast("int"))
    return d.select("doc_id", H.query_window(F.col("text"), F.col("poi"), 19).alias("query_window"), H.align_window(F.col("text"), F.col("poi")).alias("align_window"))


@query("""
with h as (select p_partkey, case p_partkey % 3 when 0 then 'sp|P' || p_partkey || '_Pos' || p_size || '|' || p_name || ' thing OS=x GN=' || p_type || ' PE=1' when 1 then 'ab:' || p_partkey else 'A;' || p_partkey || 'x|POI:' || p_size || '-' || (p_size + 1) || '|' || p_name end h from part)
select p_partkey, case p_partkey % 3 when 0 then 'P' || p_partkey || '_Pos' || split_part(split_part(h, '_Pos', 2), '|', 1) when 1 then replace(left(h, 10), ':', '_') else replace(split_part(h, '|', 1), ';', '_') end acc,
  case p_partkey % 3 when 0 then 'P' || p_partkey when 1 then replace(left(h, 10), ':', '_') else replace(split_part(h, '|', 1), ';', '_') end plain_acc,
  case p_partkey % 3 when 2 then regexp_extract(h, 'POI:(\\d+)', 1)::int else -1 end poi, regexp_extract(h, 'GN=(\\S+)', 1) gene,
  case p_partkey % 3 when 0 then regexp_extract(split_part(h, '|', 3), '(.+?) ..=', 1) when 1 then h else split_part(h, '|', 3) end description from h
""")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = lambda c: F.col(c).cast("string")
    zero = F.concat(F.lit("sp|P"), s("p_partkey"), F.lit("_Pos"), s("p_size"), F.lit("|"), "p_name", F.lit(" thing OS=x GN="), "p_type", F.lit(" PE=1"))
    two = F.concat(F.lit("A;"), s("p_partkey"), F.lit("x|POI:"), s("p_size"), F.lit("-"), (F.col("p_size") + 1).cast("string"), F.lit("|"), "p_name")
    h = F.when(F.col("p_partkey") % 3 == 0, zero).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ab:"), s("p_partkey"))).otherwise(two)
    p = p.select("p_partkey", h.alias("h"))
    c = F.col("h")
    return p.select("p_partkey", H.accession(c).alias("acc"), H.accession(c, with_pos=False).alias("plain_acc"), H.poi_position(c).alias("poi"), H.gene(c).alias("gene"), H.description(c).alias("description"))


@query("""
select event_id, 'u' || user_id || '|POI:3-4|KIND:' || event_type || '|VAL:' || event_id as header, event_type kind, event_id::varchar val, 2::int n_attrs from events
""")
def attrs_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("|POI:3-4|KIND:"), "event_type", F.lit("|VAL:"), F.col("event_id").cast("string")).alias("header"))
    m = e.withColumn("m", H.custom_values(F.col("header")))
    return m.select("event_id", "header", F.col("m")["KIND"].alias("kind"), F.col("m")["VAL"].alias("val"), F.size("m").alias("n_attrs"))


@query("select item_id, case when length(trim(text)) <= 37 then trim(text) else md5(trim(text)) || lpad(length(trim(text))::varchar, 5, '0') end hash from benchmark")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", H.sequence_hash(F.col("text")).alias("hash"))


@query("""
with w as (select distinct doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) word from documents),
k as (select word from (select distinct unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) word from benchmark) where length(word) = 4)
select doc_id, word from w where word in (select word from k)
""")
def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("word")).filter("length(word) = 4")
    return P.keyword_lines(table(spark, sf_dir, "documents"), words, "doc_id", "text")


def _seeds_sql(texts: str, name: str) -> str:
    """Pairs of items and other texts with their best diagonal, and the place of its first seed."""
    return f"""
q as (select i, k::int q_at, substring(t, k::int + 1, 12) w from (select item_id i, text t from benchmark), lateral (select unnest(range(0, greatest(length(t) - 11, 0))) k)),
d as (select i, k::int t_at, substring(t, k::int + 1, 12) w from ({texts}), lateral (select unnest(range(0, greatest(length(t) - 11, 0))) k)),
h as (select q.i item_id, d.i {name}, t_at - q_at diagonal, count(*) seeds, min(q_at) start from q join d using (w) group by 1, 2, 3 having count(*) >= 2),
b as (select *, row_number() over (partition by item_id, {name} order by seeds desc, diagonal) k from h),
seeds as (select item_id, {name}, diagonal, seeds, start from (select *, row_number() over (partition by item_id order by seeds desc, {name}) n from b where k = 1) where n <= 20)
"""


TURNS_SQL = "select conv_id * 1000 + turn i, text t from conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("text").alias("t"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))


@query(f"with {_seeds_sql(TURNS_SQL, 'turn_id')} select item_id, turn_id, diagonal, seeds from seeds")
def seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns that share 12-letter words on one diagonal with a benchmark item, whole texts on both sides."""
    found = W.seed_search(_items(spark, sf_dir), _turns(spark, sf_dir), "item_id", "turn_id", "q", "t", k=12, least=2, most=20)
    return found.select("item_id", "turn_id", "diagonal", "seeds")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))


@query(f"with {_seeds_sql('select doc_id i, text t from documents', 'doc_id')} select item_id, doc_id, diagonal, seeds from seeds")
def seed_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 12-letter words on one diagonal with a benchmark item, whole texts on both sides."""
    found = W.seed_search(_items(spark, sf_dir), _documents(spark, sf_dir), "item_id", "doc_id", "q", "t", k=12, least=2, most=20)
    return found.select("item_id", "doc_id", "diagonal", "seeds")


def _extended_sql(side: str, places: str) -> str:
    """The best score of one way from the seed, and how many letters it takes (0 if none is above 0)."""
    return f"""
{side}0 as (select item_id, doc_id, i, sum(case when substring(q, {places[0]}, 1) = substring(t, {places[1]}, 1) then 1 else -3 end) over (partition by item_id, doc_id order by i) as c
  from pairs, lateral (select unnest(range(0, {places[2]})) i)),
{side}1 as (select *, greatest(0, max(c) over (partition by item_id, doc_id order by i)) - c > 20 as fell from {side}0),
{side}2 as (select *, coalesce(min(case when fell then i end) over (partition by item_id, doc_id), 1000000) as stop from {side}1),
{side} as (select item_id, doc_id, max(c) as {side}_score, arg_min(i, (-c, i)) + 1 as {side}_n from {side}2 where i < stop group by 1, 2 having max(c) > 0)
"""


#: Statistics of +1 and -3 over 30 letters, to ten digits.
HIT_SQL = f"""
with {_seeds_sql('select doc_id i, text t from documents', 'doc_id')},
pairs as (select s.*, b.text as q, d.text as t, start + diagonal as s_at from seeds s join benchmark b using (item_id) join documents d on s.doc_id = d.doc_id),
{_extended_sql('ahead', ('(start + i + 1)::bigint', '(s_at + i + 1)::bigint', 'least(length(q) - start, length(t) - s_at)'))},
{_extended_sql('back', ('(start - i)::bigint', '(s_at - i)::bigint', 'least(start, s_at)'))},
e as (select p.*, coalesce(ahead_score, 0) + coalesce(back_score, 0) as score, start - coalesce(back_n, 0) + 1 as q_start, start + coalesce(ahead_n, 0) as q_end
  from pairs p left join ahead using (item_id, doc_id) left join back using (item_id, doc_id)),
f as (select *, (select count(*) from range(q_start, q_end + 1) r(n) where substring(q, n::bigint, 1) = substring(t, (n + diagonal)::bigint, 1)) as same from e),
g as (select *, (score * 3.4011615747 - ln(0.9665270222)) / ln(2) as bits from f)
select item_id as query_id, doc_id as subject_id, score::bigint as score, (q_end - q_start + 1)::int as alignment_length, (q_end - q_start + 1 - same)::int as mismatches, q_start::int as q_start, q_end::int as q_end,
  (q_start + diagonal)::int as s_start, (q_end + diagonal)::int as s_end, round(same * 100.0 / (q_end - q_start + 1), 6) as identity, round(bits, 4) as bitscore,
  row_number() over (partition by item_id order by score desc, doc_id)::int as rank
from g qualify bits >= 60
"""


@query(HIT_SQL)
def hit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark items in documents: seeds extended without gaps, bit scores, and the filter of weak hits."""
    q, t = _items(spark, sf_dir), _documents(spark, sf_dir)
    seeds = W.seed_search(q, t, "item_id", "doc_id", "q", "t", k=12, least=2, most=20)
    hits = P.bitscore_filter(W.extend(seeds, q, t, "item_id", "doc_id", "q", "t", match=1, mismatch=-3, drop=20, letters=30))
    return hits.select("query_id", "subject_id", "score", "alignment_length", "mismatches", "q_start", "q_end", "s_start", "s_end", F.round("identity", 6).alias("identity"), F.round("bitscore", 4).alias("bitscore"), "rank")


#: A site in every text, and the letters around it (30 and 10, as many as there are).
TEXT_SITES = """
t0 as (select doc_id, text, 1 + (doc_id * 37) % greatest(length(text), 1) poi from documents where text is not null),
w as (select doc_id, substring(text, (greatest(0, poi - 5) + 1)::bigint, 10) q, substring(text, (greatest(0, least(poi - 15, length(text) - 30)) + 1)::bigint, 30) t, substring(text, (greatest(0, poi - 4) + 1)::bigint, 10) u from t0)
"""


def _text_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").withColumn("poi", (1 + (F.col("doc_id") * 37) % F.greatest(F.length("text"), F.lit(1))).cast("int"))
    text, poi = F.col("text"), F.col("poi")
    return d.select("doc_id", H.align_window(text, poi).alias("q"), H.query_window(text, poi, 29).alias("t"), H.align_window(text, poi + 1).alias("u"))


@query(f"""
with {TEXT_SITES},
s as (select doc_id, o, coalesce((select sum(case when substring(q, i::int, 1) = substring(t, (o + i)::int, 1) then 4 else -2 end) from range(1, 11) r(i) where i <= length(q)), 0) score from w, range(0, 31) r(o) where o <= length(t) - length(q)),
b as (select *, row_number() over (partition by doc_id order by score desc, o) k from s)
select doc_id, score::int score, o::int as "offset" from b where k = 1
""")
def gapless_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters around a site of every text over all offsets of the wider window there; short texts are their own window."""
    d = _text_sites(spark, sf_dir)
    return d.select("doc_id", A.gapless(F.col("q"), F.col("t")).alias("s")).select("doc_id", "s.score", "s.offset")


@query(f"""
with {TEXT_SITES},
x as (select doc_id, rpad(translate(q, ' .', '--'), 10, '-') q, rpad(translate(u, ' .', '--'), 10, '-') t from w),
l as (select *, length(replace(q, '-', '')) n, length(q) - length(ltrim(q, '-')) s, length(rtrim(q, '-')) - 1 e from x where replace(q, '-', '') <> ''),
g as (select *, length(regexp_replace(substring(q, s + 1, e - s) || substring(t, s + 1, e - s), '[^-]', '', 'g')) gaps, (select count(*) from range(1, 11) r(i) where substring(q, i::int, 1) = substring(t, i::int, 1) and substring(q, i::int, 1) <> '-') same from l)
select doc_id, greatest(0, round(same * 100.0::double / n - gaps * 100.0::double / n))::int score from g
""")
def identity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters around a site of every text, blanks and stops as gaps, against those one letter later."""
    row = lambda c: F.rpad(F.translate(c, " .", "--"), 10, "-")
    d = _text_sites(spark, sf_dir).select("doc_id", row("q").alias("q"), row("u").alias("t"))
    return d.filter("replace(q, '-', '') <> ''").select("doc_id", S.identity_score(F.col("t"), F.col("q")).alias("score"))


@query(f"""
with {TEXT_SITES},
a as (select doc_id, q, regexp_extract_all(text, '(?s).') l from w join t0 using (doc_id)),
t as (select doc_id, unnest(l) c, unnest(range(1, len(l) + 1)) p from a),
u as (select doc_id, substring(q, i::bigint, 1) c, i from a, lateral (select unnest(range(1, length(q) + 1)) i)),
s as (select t.doc_id, p - i o, count(*) same from t join u on t.doc_id = u.doc_id and t.c = u.c group by 1, 2),
n as (select doc_id, length(q) n, len(l) - length(q) spare from a),
b as (select *, row_number() over (partition by doc_id order by same desc, o) k from s join n using (doc_id) where o between 0 and spare)
select n.doc_id, (4 * coalesce(same, 0) - 2 * (n.n - coalesce(same, 0)))::int score, coalesce(o, 0)::int as "offset" from n left join b on n.doc_id = b.doc_id and k = 1
union all select doc_id, null, null from documents where text is null
""")
def gapless_align_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters around a site of every document over all offsets of its whole text."""
    d = table(spark, sf_dir, "documents").withColumn("poi", (1 + (F.col("doc_id") * 37) % F.greatest(F.length("text"), F.lit(1))).cast("int"))
    return A.gapless_whole(d.select("doc_id", H.align_window(F.col("text"), F.col("poi")).alias("q"), F.col("text").alias("t")), "doc_id", "q", "t")


@query()
def identity_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity score of the rows of whole alignments."""
    return local_align(spark, sf_dir).select("doc_id", F.col("identity").alias("score"))


@query()
def local_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine local alignment of the twelve letters around a site of every document (all of a shorter text) with its whole text; equal pairs once."""
    d = table(spark, sf_dir, "documents").withColumn("poi", (1 + (F.col("doc_id") * 37) % F.greatest(F.length("text"), F.lit(1))).cast("int"))
    d = d.select("doc_id", H.query_window(F.col("text"), F.col("poi"), 11).alias("q"), F.col("text").alias("t"))
    matrix = A.simple_matrix(letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,")
    return A.align_pairs(d, "q", "t", matrix, measures={"identity": S.identity_score}).select("doc_id", "score", "identity")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    xyz = {c: F.col("embedding")[k].cast("double") * 100 for k, c in enumerate("xyz")}
    return e.select("vec_id", "label", *[v.alias(c) for c, v in xyz.items()], (1.2 + (F.col("vec_id") % 5) * 0.2).alias("radius"), F.floor(F.col("vec_id") / 8).alias("res_id"))


PTS = "p as (select vec_id, label, embedding[1]::double * 100 x, embedding[2]::double * 100 y, embedding[3]::double * 100 z, 1.2::double + (vec_id % 5) * 0.2::double radius, vec_id // 8 res_id from embeddings where embedding is not null and label is not null)"


@query(f"with {PTS} select a.vec_id, count(*) n, min(b.vec_id) nearest_id from p a join p b on a.label = b.label and a.vec_id <> b.vec_id and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 100 group by 1")
def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    n = X.neighbours(p, p, ["label"], 10.0).filter("l.vec_id <> r.vec_id")
    return n.groupBy(F.col("l.vec_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("r.vec_id").alias("nearest_id"))


POINTS = X.icosahedron_sphere()
#: The points apart from the operator: on every level the middles of all edges join them, and edges are the pairs at about the least distance.
_CORNERS = """
i_sign as (select * from (values (-1.0), (1.0)) t(i)),
i_raw as (select a.i as u, b.i * (1 + sqrt(5)) / 2 as v from i_sign a, i_sign b),
i_all as (select u as x, v as y, 0.0 as z from i_raw union all select 0.0, u, v from i_raw union all select v, 0.0, u from i_raw),
i_p1 as (select x / sqrt(x * x + y * y + z * z) as ux, y / sqrt(x * x + y * y + z * z) as uy, z / sqrt(x * x + y * y + z * z) as uz from i_all),
"""
_LEVEL = """
i_d{k} as (select a.ux + b.ux as x, a.uy + b.uy as y, a.uz + b.uz as z, (a.ux - b.ux) ** 2 + (a.uy - b.uy) ** 2 + (a.uz - b.uz) ** 2 as d from i_p{k} a join i_p{k} b on (a.ux, a.uy, a.uz) < (b.ux, b.uy, b.uz)),
i_p{n} as (select * from i_p{k} union all select x / sqrt(x * x + y * y + z * z), y / sqrt(x * x + y * y + z * z), z / sqrt(x * x + y * y + z * z) from i_d{k} where d < 1.8 * (select min(d) from i_d{k})),
"""
SPHERE = _CORNERS + "".join(_LEVEL.format(k=k, n=k + 1) for k in (1, 2, 3)) + "s as (select row_number() over () - 1 as k, ux, uy, uz from i_p4)"
AREA_SQL = f"""
with {PTS}, {SPHERE},
q as (select p.*, k, x + ux * (radius + 1.4) px, y + uy * (radius + 1.4) py, z + uz * (radius + 1.4) pz from p, s),
n as (select a.vec_id, a.label, a.res_id ar, b.res_id br, b.x, b.y, b.z, (b.radius + 1.4) * (b.radius + 1.4) r2 from p a join p b on a.label = b.label and a.vec_id <> b.vec_id
      and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < (a.radius + b.radius + 2.8) * (a.radius + b.radius + 2.8)),
h as (select q.vec_id, q.label, k, bool_or(ar = br) own, bool_or(ar <> br) other from q join n on q.vec_id = n.vec_id and q.label = n.label and (px-n.x)*(px-n.x) + (py-n.y)*(py-n.y) + (pz-n.z)*(pz-n.z) < r2 group by 1, 2, 3),
a as (select q.vec_id, q.label, q.res_id, 4 * pi() * (radius + 1.4) * (radius + 1.4) / {len(POINTS)} * count(*) filter (not coalesce(own, false)) sa,
      4 * pi() * (radius + 1.4) * (radius + 1.4) / {len(POINTS)} * count(*) filter (not coalesce(own, false) and not coalesce(other, false)) asa
      from q left join h on q.vec_id = h.vec_id and q.label = h.label and q.k = h.k group by 1, 2, 3, radius)
"""


def _areas(spark: SparkSession, sf_dir: str, points: list = POINTS) -> DataFrame:
    p = _points(spark, sf_dir)
    return X.accessible_area(p, p, ["label"], points, max_radius=2.0, atom="vec_id", residue="res_id")


@query(AREA_SQL + "select vec_id, label, round(sa, 4) sa, round(asa, 4) asa from a")
def accessible_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("vec_id", "label", F.round("sa", 4).alias("sa"), F.round("asa", 4).alias("asa"))


@query(AREA_SQL + "select label, res_id, round(case when sum(sa) = 0 then 0 else sum(asa) * 100 / sum(sa) end, 4) area from a group by 1, 2")
def area_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return X.residue_percent(_areas(spark, sf_dir), p, ["label", "res_id"]).select("label", "res_id", F.round("area", 4).alias("area"))


@query(AREA_SQL + """,
r as (select label, res_id, case when sum(sa) = 0 then 0 else sum(asa) * 100 / sum(sa) end area from a group by 1, 2),
g as (select label, res_id // 4 site, avg(area) m, avg(case when res_id % 4 = 0 then 14.0 else 15.0 end) t from r group by 1, 2)
select label, site, case when m - t < 0 then 'Buried' when m - t < 10 then 'Intermediate' else 'Surface' end decision, round(m, 4) area_avg from g
""")
def surface_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    r = X.residue_percent(_areas(spark, sf_dir), p, ["label", "res_id"])
    r = r.withColumn("site", F.floor(F.col("res_id") / 4)).withColumn("aa1", F.when(F.col("res_id") % 4 == 0, "G").otherwise("A"))
    return S.surface_decision(r, ["label", "site"]).withColumn("area_avg", F.round("area_avg", 4))


@query(AREA_SQL + "select vec_id, label, round(sa, 4) sa, round(asa, 4) asa from a")
def accessible_area_642(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``accessible_area``; the name of the time when that used fewer points."""
    return accessible_area(spark, sf_dir)


@query("""
with m as (select l_orderkey, max(l_discount * 10 - case when l_tax > 0.01 then l_tax * 10 else l_quantity / 50 end) d, list_distinct(list(l_returnflag)) f from lineitem group by 1)
select l_orderkey, case when abs(d) < 0.1 then 'No' when list_contains(f, 'R') then 'Homomer' else 'Heteromer' end interface, round(d, 6) + 0.0 delta from m
""")
def interface_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    areas = l.select("l_orderkey", (F.col("l_discount") * 10).alias("isolated"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 10).alias("assembly"), (F.col("l_quantity") / 50).alias("asymmetric"))
    near = l.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("chains"))
    dup = l.groupBy("l_orderkey").agg(F.array(F.lit("R")).alias("chains"))
    return S.interface_call(areas, ["l_orderkey"], "l_linenumber", near, dup).withColumn("delta", F.round("delta", 6) + 0.0)


@query("""
with p as (select vec_id, label, embedding[1]::double * 100 x, embedding[2]::double * 100 y, embedding[3]::double * 100 z from embeddings where embedding is not null and label is not null)
select vec_id, 0 as copy, round(x, 6) x, round(y, 6) y, round(z, 6) z from p union all select vec_id, 1, round(-y + 10, 6), round(x + 5, 6), round(z - 2.5, 6) from p
""")
def assembly_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumns({"pdb_id": F.col("label").cast("string"), "chain": F.lit("A")})
    one, two = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]], [[0.0, -1.0, 0.0, 10.0], [1.0, 0.0, 0.0, 5.0], [0.0, 0.0, 1.0, -2.5]]
    plan = p.select("pdb_id").distinct().withColumns({"num": F.lit(1), "chains": F.array(F.lit("A")), "matrices": F.array(*[F.array(*[F.array(*map(F.lit, r)) for r in m]) for m in (one, two)])})
    return X.assembly_copies(p, plan).select("vec_id", "copy", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("""
with p as (select vec_id, label, embedding[1]::double * 100 x, embedding[2]::double * 100 y, embedding[3]::double * 100 z from embeddings where embedding is not null and label is not null),
c as (select vec_id, label, 0 as copy, x, y, z from p union all select vec_id, label, 1, -y + 10, x + 5, z - 2.5 from p),
n as (select label, count(*) > 100 as large from c group by 1),
s as (select label, x sx, y sy, z sz from p where vec_id % 25 = 0)
select vec_id, copy, large from c join n using (label)
where not large or exists (select 1 from s where s.label = c.label and (x - sx) ** 2 + (y - sy) ** 2 + (z - sz) ** 2 <= 225)
""")
def assembly_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all points; of labels with more than 100 those within a distance of a site."""
    p = _points(spark, sf_dir).withColumns({"pdb_id": F.col("label").cast("string"), "chain": F.lit("A")})
    one, two = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]], [[0.0, -1.0, 0.0, 10.0], [1.0, 0.0, 0.0, 5.0], [0.0, 0.0, 1.0, -2.5]]
    plan = p.select("pdb_id").distinct().withColumns({"num": F.lit(1), "chains": F.array(F.lit("A")), "matrices": F.array(*[F.array(*[F.array(*map(F.lit, r)) for r in m]) for m in (one, two)])})
    kept = X.assembly_copies(p, plan, p.filter("vec_id % 25 = 0").select("pdb_id", "x", "y", "z"), most=100, keep=15.0)
    sizes = p.groupBy("label").agg((F.count(F.lit(1)) * 2 > 100).alias("large"))
    return kept.join(sizes, "label").select("vec_id", "copy", "large")


@query("""
with d as (select distinct l_orderkey, l_linenumber n from lineitem), g as (select *, greatest(0, n - coalesce(lag(n) over (partition by l_orderkey order by n) + 1, 1)) j from d)
select l_orderkey, string_agg(repeat('-', j) || n, '' order by n) seq from g group by 1
""")
def gap_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("letter")).distinct()
    return T.gap_sequence(d, ["l_orderkey"], "l_linenumber", "letter", "l_linenumber", initial=True)


@query("select conv_id, turn, array_to_string(list(role) over w, ',') near from conversations window w as (partition by conv_id order by turn rows between current row and 1 following)")
def neighbours_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.neighbours_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 0, "role")
    return n.select("conv_id", "turn", F.array_join("role_near", ",").alias("near"))


@query("""
with c as (select conv_id, turn, list(left(role, 1)) over (partition by conv_id order by turn rows between 3 preceding and current row) l, list(left(role, 1)) over (partition by conv_id order by turn rows between 1 following and 4 following) r from conversations)
select conv_id, turn, lpad(array_to_string(l, ''), 4, '?') || '*' || rpad(coalesce(array_to_string(r, ''), ''), 4, '?') context from c
""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("role", 1, 1).alias("code"))
    return T.context_window(c, ["conv_id"], "turn", "code", window=8).select("conv_id", "turn", "context")


@query("""
with d as (select distinct o_custkey, o_orderkey // 16 v from orders), g as (select *, v - row_number() over (partition by o_custkey order by v) i from d),
r as (select o_custkey, min(v) a, max(v) b from g group by o_custkey, i)
select o_custkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) ranges from r group by 1
""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 16).alias("v"))
    return H.rangify(o, ["o_custkey"], "v")


@query("""
with n as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) i from events)
select user_id, event_id, round(avg(value) over (partition by user_id order by i rows between 2 preceding and 2 following), 6) window_mean from n
""")
def window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.rank_hits(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "i")
    return T.window_mean(n, ["user_id"], "i", "value", 5).select("user_id", "event_id", F.round("window_mean", 6).alias("window_mean"))


@query("""
with s as (select doc_id, text, unnest(range(1, length(text) + 1))::int poi from documents where length(text) >= 25),
a as (select doc_id, poi, substring(text, poi, 1) aa, md5('1:' || doc_id || ':' || poi) o from s)
select doc_id, poi, aa from a where aa in ('S', 'T') order by o, doc_id, poi limit 5000
""")
def sample_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sample_positions(table(spark, sf_dir, "documents"), "doc_id", "text", "ST").select("doc_id", "poi", "aa")


def _digest_sql(*parts: str) -> str:
    """A number between 0 and 1 from twelve digits of a digest."""
    digit = "instr('0123456789abcdef', substring(md5(concat_ws(':', " + ", ".join(parts) + ")), i::bigint, 1)) - 1"
    return f"((select sum(({digit}) * pow(16, 12 - i)) from range(1, 13) r(i)) + 0.5) / pow(2, 48)"


@query(f"""
with recursive long as (select doc_id, text, length(regexp_replace(text, '[^ST]', '', 'g')) places from documents where length(text) >= 25),
s as (select doc_id, places, j, -ln({_digest_sql("'1'", "'t'", "j", "doc_id")}) step from long, lateral (select unnest(range(1, least(places, 60) + 1)) j)),
t as (select doc_id, j, sum(step) over (partition by doc_id order by j) t from s),
n as (select doc_id, count(*) draws from (select * from t order by t, doc_id, j limit 600) group by 1),
d as (select doc_id, draws, places, 0::bigint j, []::bigint[] taken from n join long using (doc_id)
  union all select doc_id, draws, places, j + 1, list_append(taken, list_reduce(list_prepend(floor({_digest_sql("'1'", "'p'", "j + 1", "doc_id")} * (places - j))::bigint, list_sort(taken)), lambda a, c: case when a >= c then a + 1 else a end)) from d where j < draws),
k as (select doc_id, unnest(taken) k from d where j = draws),
l as (select doc_id, regexp_extract_all(text, '(?s).') a from long where doc_id in (select doc_id from n)),
p as (select doc_id, unnest(range(1, len(a) + 1)) poi, unnest(a) aa from l),
q as (select *, row_number() over (partition by doc_id order by poi) - 1 k from p where aa in ('S', 'T'))
select doc_id, poi::int poi, aa from k join q using (doc_id, k)
""")
def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600 draws of a document of 25 letters or more, each as likely, and of a place of two letters in it."""
    return M.sample_uniform(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", "ST", n=600)


@query("select user_id, string_agg(n::varchar, ';' order by event_type) as values from (select user_id, event_type, count(*) n from events group by 1, 2) group by 1")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sinks.heatmap(counts, "user_id", "event_type", "n")


@query("""
with m as (select l_suppkey, string_agg(l_returnflag || ':' || n, ',' order by l_returnflag) flags from (select l_suppkey, l_returnflag, count(*) n from lineitem group by 1, 2) group by 1)
select l_suppkey, count(*) n_atoms, count(distinct l_orderkey) n_residues, min(l_quantity) b_min, max(l_quantity) b_max, round(avg(l_quantity), 6) b_avg, flags from lineitem join m using (l_suppkey) group by l_suppkey, flags
""")
def structure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    one = l.groupBy("l_suppkey").agg(F.count("*").alias("n_atoms"), F.countDistinct("l_orderkey").alias("n_residues"), F.min("l_quantity").alias("b_min"), F.max("l_quantity").alias("b_max"), F.round(F.avg("l_quantity"), 6).alias("b_avg"))
    m = T.count_map(l, "l_suppkey", "l_returnflag", "flags")
    text = F.array_join(F.transform(F.map_entries("flags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return one.join(m, "l_suppkey").withColumn("flags", text)


@query("select aa, n, round(n * 100.0 / sum(n) over (), 6) pct from (select p_brand aa, count(*) n from part group by 1)")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.composition(table(spark, sf_dir, "part").select(F.col("p_brand").alias("aa")), "aa").withColumn("pct", F.round("pct", 6))


@query("select l_orderkey, count(*) n from lineitem group by 1 having count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repeated_ids(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


@query("select l_linenumber, l_suppkey, round(coalesce(min(case when l_discount >= 0.02 then l_discount end), -1.0), 6) d_min, round(coalesce(max(case when l_discount >= 0.02 then l_discount end), -1.0), 6) d_max from lineitem group by 1, 2")
def site_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_discount") >= 0.02, F.col("l_discount")).otherwise(-1.0))
    return T.site_ranges(l, ["l_linenumber", "l_suppkey"], "v", "d").select("l_linenumber", "l_suppkey", F.round("d_min", 6).alias("d_min"), F.round("d_max", 6).alias("d_max"))


@query("""
select event_id, round((least(100, greatest(0, value * 2.5)) * 0.3 + value * 0.1 + 0.3 + 15.0) / 100, 6) combined,
  round(greatest(0.0, least(100.0, (value / 12.0 - 1.5) * 100.0)) * 0.3 + greatest(0.0, least(100.0, (1 - (value - 50) * (value - 50) / 900.0) * 100.0)) * 0.3 + 12.5 + greatest(0.0, least(100.0, value / 5.0)) * 0.1 + greatest(0.0, least(100.0, (value / 30.0 - 7.0 / 3.0) * 100.0)) * 0.05, 8) older
from events where value is not null
""")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    cleavage = F.lit((1 + 7**0.5) / 6)  # where the parabola is one half
    e = table(spark, sf_dir, "events").filter("value is not null")
    return e.select("event_id", F.round(S.combined_score(v, v, F.lit(1.0), F.lit(50.0)), 6).alias("combined"), F.round(S.older_score(v, v, cleavage, v, v), 8).alias("older"))


def queries() -> dict:
    importlib.import_module("evisite.plans.pieces")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    importlib.import_module("evisite.plans.pieces")
    return dict(SQL)
