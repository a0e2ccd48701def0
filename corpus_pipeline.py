"""A training corpus from raw documents: language, near duplicates, personal data, mix, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``. Nulls: rows with a null text or without a letter go in the first stage; a null
id is kept by all others, alone in its group of near duplicates. Of rows that share an id the first by text stays; of near
duplicates the smallest id. Repeats that the mix makes are rows of their own. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisite.llm import langid, minhash, mixing, packing, pii
from evisite.llm.common import bounded_batches, fresh, settle
from evisite.llm.registry import table, vocabulary

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is hardly told from any other.

    Without labels to learn from, only documents without a letter go.
    """
    bounded_batches(spark)
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = langid.classify(docs, model)
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words a shingle, similarity 0.8); one row of each id."""
    bounded_batches(spark)
    kept_id, row = fresh(docs, "kept_id"), fresh(docs, "row")
    kept = minhash.group(docs, k=5, least=80).filter("kept").select(F.col("doc_id").alias(kept_id))
    named = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col(kept_id), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return named.withColumn(row, once).filter(F.col(row) == 1).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    bounded_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the word targets of their sources."""
    return mixing.repeat(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    bounded_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), lower=False, length=2048, end_id=1)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: The stages learn models and encode text; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
