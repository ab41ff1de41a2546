"""Corpus preparation: language ID, toxicity, near duplicates, source mix, packing.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import language, toxicity
from canlake.llm.common import free_name, reach_workers, table
from canlake.llm.mixing import mixed_documents
from canlake.llm.near_duplicates import near_duplicate_groups
from canlake.llm.packing import pack
from canlake.storage import settle

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language, however close the next one comes; only ``und`` goes."""
    reach_workers(spark)
    found, share = (free_name(docs.columns, name) for name in ("language", "share"))
    marked = language.with_language(docs, language.trained(docs), (found, share))
    return marked.where(F.col(found) != "und").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not predicted toxic."""
    reach_workers(spark)
    score = free_name(docs.columns, "toxicity")
    marked = toxicity.with_toxicity(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")), score)
    return marked.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the first by doc_id."""
    reach_workers(spark)
    key = free_name(docs.columns, "row_key")
    stored = settle(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-documents")
    rows = stored.select(F.col(key).alias("row_key"), "doc_id", "text")
    groups = near_duplicate_groups(rows.select("row_key", "text"), "row_key", SHINGLE_WORDS, SIMILAR_PERCENT).select("row_key", "component_id")
    first = rows.select("row_key", "doc_id").join(groups, "row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    return stored.join(first.select(F.col("first.row_key").alias(key)), key, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    reach_workers(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_join", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, similarity components and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
