"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of documents; the last adds n_tokens and ids. Decisions are about a row's key and text together, so rows
with a null key, or with one key and several texts, are each judged by their own text; equal rows go or stay together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaique.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from mosaique.llm.common import forget, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a language; drops documents without text or without a letter. The
    prediction fills in a language that is missing."""
    rows = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs)).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """docs with _name: a row's key, null ones last, and the digest of its text."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return docs.withColumn("_name", F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", digest.alias("digest")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one of the smallest doc_id stays; all of them if none has any."""
    found = exact_dedup.exact_dedup(docs, hashes=True).filter("kept").select(F.col("doc_id").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.withColumn("_text", exact_dedup.text_hash("text"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_key")) & F.col("_text").eqNullSafe(F.col("_hash")), "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one of the smallest doc_id stays."""
    named = _named(docs)
    kept = near_dedup.near_dedup(named, words=5, percent=80, key="_name").filter("kept").select("_name").distinct()
    return named.join(kept, "_name", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    named = _named(docs)
    leaks = decontaminate.leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_name")
    return named.join(leaks.select("_name").distinct(), "_name", "left_anti").select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and ids (array of int) by the byte-level BPE ranks."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.with_ids(docs.select(*COLUMNS), path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode_texts),
]

#: Language ID and BPE are not within SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, writing what each keeps to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i + 1}")
            forget(before)
    return docs
