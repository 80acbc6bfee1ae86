"""From raw documents to packed training sequences.

Language identification, near-duplicate removal, removal of repeated passages, redaction of
secrets, best-fit packing. Every stage works on all rows the one before it kept, and its result
is written and read again before the next.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.llm import langid, neardup, packing, secret_scan, substrings
from argusframe.sources.session import checkpoint_dir

#: Share of words in the predicted language below which a text counts as no language's.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: some letter, and a clear share of words in one language."""
    whole = docs.select(F.struct("*").alias("whole"), "text")
    found = langid.label(whole, langid.fit(docs), keep=("whole",))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SHARE)).select("whole.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the least doc_id.

    Rows that repeat the kept doc_id are one document; the row with the least text stays.
    Documents with a null doc_id stay, each on its own.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    groups = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count("*").alias("rows")
    )
    whole = docs.select(F.struct("*").alias("whole"), "doc_id", "text")
    kept = whole.join(groups.where("kept"), "doc_id")
    repeated = kept.where("rows > 1").groupBy("doc_id").agg(F.min(F.struct("text", "whole")).alias("least"))
    return (
        kept.where("rows = 1").select("whole")
        .unionByName(repeated.select("least.whole"))
        .unionByName(whole.where("doc_id IS NULL").select("whole"))
        .select("whole.*")
    )


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that an earlier document holds out of the later ones; keeps all documents."""
    found = substrings.passages(docs.select("doc_id", "text"))
    return substrings.without_passages(docs, found).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the values of secrets; keeps all documents."""
    return secret_scan.redact(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the result of each but the last is written as Parquet."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
