"""The registered queries of the training-data operators: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisite.llm import gif, hardneg, htmltext, langid, lexical, minhash, mixing, packing, pii, sharding, tokenfile, urltree, vectorgraph
from evisite.llm.common import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near-equal bytes; equal texts stay together."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def vocabulary(name: str) -> str:
    """A public vocabulary file of the environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, stored in patched frame-of-reference segments, and read back from them."""
    files = tokenfile.write_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), lower=True, end_id=1)
    return tokenfile.read_files(files)


def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: strict spans, and loose ones that the boosted trees accept."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


#: The rules of the query (fixed values).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_path_template_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its path template."""
    return urltree.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_pruned_graph_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings with equal labels at a cosine of 0.93 or more."""
    return vectorgraph.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word targets per source with weights 1, 2, 3 and at most 3 epochs; words taken per document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF of 24 x 24 frames, and read back."""
    return gif.digest(gif.store_texts(table(spark, sf_dir, "documents")))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), lower=False, length=2048, end_id=1)


def op9_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four words a shingle, similarity 0.8 or more."""
    return minhash.group(table(spark, sf_dir, "documents"), k=4, least=80)


def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labelled = langid.classify(docs.select("doc_id", "text"), langid.fit(docs))
    return labelled.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_two_pass_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op12_blocked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each anchor and each of its five positives, over all embeddings."""
    other = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(table(spark, sf_dir, "embeddings"), anchor_every=50, relabel=other, n_positives=5, n_negatives=3)


OP6_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('17:' || doc_id::varchar) as u
  from documents),
src as (
  select source, sum(size)::bigint as source_size, count(*) as n_rows,
         [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source),
ranked as (
  select *, 3 * source_size as cap, row_number() over (order by 3.0 * source_size / weight, source nulls last) as k from src),
levels as (
  select k as held_k,
         (sum(source_size) over () - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
           / (sum(weight) over (order by k rows between current row and unbounded following))::double as level,
         cap, weight
  from ranked),
found as (select level from levels where weight * level < cap order by held_k limit 1),
plan as (
  select source, source_size, n_rows,
         coalesce(least(cap::double, weight * (select level from found)), 0.0) as target from ranked),
parts as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as base from plan),
rests as (select *, round(target)::bigint - base * source_size as rest from parts),
placed as (
  select d.doc_id, d.size, r.source_size, r.target, r.base, r.rest,
         coalesce(sum(d.size) over (partition by d.source order by d.u, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as gone
  from sized d join rests r on d.source is not distinct from r.source)
select doc_id, size, source_size, target,
       (base * size + greatest(0, least(size, rest - gone)))::bigint as taken
from placed
"""


OP5_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e,
         embedding is not null and label is not null and list_count(embedding) = len(embedding)
           and coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), false) and coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) as ok
  from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and a.ok and b.ok and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
degree as (select a, count(*) as n from links group by a),
least_id as (select a, min(b) as b from reach group by a)
select v.vec_id, coalesce(n, 0) as n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(l.b, v.vec_id)) as kept
from v left join degree d on v.vec_id = d.a left join least_id l on v.vec_id = l.a
"""

OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
s as (
  select distinct doc_id, case when len(t) < 4 then array_to_string(t, ' ') else array_to_string(t[k:k + 3], ' ') end as sh
  from w, lateral (select unnest(range(1, greatest(len(t) - 3, 1) + 1)) as k) where len(t) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * both_ >= 80 * (x.n + y.n - both_)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least_id as (select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) as component_id, w.doc_id = least(w.doc_id, coalesce(b, w.doc_id)) as kept
from w left join n on w.doc_id = n.doc_id left join least_id l on w.doc_id = l.a
"""

OP12_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (
  select row_number() over () as k, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
words as (select k, item_id, unnest(t) as w from i),
whole as (select count(*)::bigint as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
spread as (select r, unnest(t) as w from d),
tf as (select r, w, count(*)::bigint as tf from spread where w in (select w from words) group by r, w),
df as (select w, count(*)::bigint as df from tf group by w),
weight as (select w, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as weight from df, whole),
m as (select r, doc_id, 100 - 50 + ((50 * len(t)::bigint * n_docs) // n_terms) as m from d, whole where len(t) > 0),
scored as (
  select k, item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from words join weight using (w) join tf using (w) join m using (r) group by k, item_id, r, doc_id),
ranked as (select *, row_number() over (partition by k order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""

OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding::double[], lambda x: floor(256 * x)) as x
  from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding)
    and list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
pairs as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select *, row_number() over (partition by anchor_id order by score desc, other_id) as k from pairs where same qualify k <= 5),
fits as (
  select p.anchor_id, p.other_id as positive_id, p.k, n.other_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.k order by n.score desc, n.other_id) as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same
  where 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score, k::int as positive_rank from fits where rank <= 3
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lpt_shards, op2_boosted_pii, op3_pfor_token_files, op4_path_template_urls, op5_pruned_graph_duplicates, op6_water_filling_mix, op7_gif_media, op8_sum_of_squares_packing, op9_superminhash_groups, op10_bigru_language, op11_two_pass_main_text, op12_blocked_lexical_search, op13_multi_index_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op5_pruned_graph_duplicates": OP5_SQL, "op6_water_filling_mix": OP6_SQL, "op9_superminhash_groups": OP9_SQL, "op12_blocked_lexical_search": OP12_SQL, "op13_multi_index_negatives": OP13_SQL}
