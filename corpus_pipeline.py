"""Corpus pipeline: language, near copies, benchmark leaks, secrets, packing, in this order.

Every stage reads what the one before has written and takes effect at once: documents of no known language go, one
document of each group of near copies stays (the one with the smallest id), documents that hold a benchmark passage
go, secrets are replaced by a mark, and what is left is packed. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common, decontaminate, jaccard_join, language_id, packing, secrets
from statekit.session import durable

ORACLE_SQL = None  # learned models and tokenizers have no SQL form; the tests hold each stage against brute force


def keep(spark: SparkSession, docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs whose document is among those that decide returns; for repeated ids see ``common.one_each``."""
    texts, names = common.one_each(spark, docs)
    if names is None:
        return docs.join(decide(docs).select(F.col("doc_id").alias("_kept")), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    kept = texts.join(decide(texts).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("_digest"))
    kept = kept.join(names, "doc_id").select(F.col("shown").alias("_kept"), "_digest")
    same = F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)) == F.col("_kept")
    return docs.join(kept, same & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_digest")), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language; learned from the rows that carry one."""
    return language_id.keep_known(spark, docs, language_id.learn(spark, docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles at a similarity of 0.8 or more."""
    return keep(spark, docs, lambda x: jaccard_join.jaccard_components(spark, x, width=5, percent=80).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = common.table(spark, sf_dir, "benchmark")
    return keep(spark, docs, lambda x: decontaminate.find_leaks(spark, x, items).where("NOT contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars brought in line."""
    clean = secrets.redact(spark, docs, secrets.learn(spark, docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("secret scans", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(spark, stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
