"""Token counts with a digest cache (operator 3).

A text's count depends on the text and the tokenizer alone, so counts are stored by two digests: of the
normalised content and of the tokenizer's version. Texts found in the cache are joined to their counts; of the
others each distinct one is encoded once and its count appended. Normalising only turns null into the empty
text, as every other change of a text can change its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exists, joined_to_groups, pieces_of, stored, utf8_view
from .tokenizer_library import Library, tokenizer_version

CHUNK_BYTES = 8 << 20
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def cached_counts(docs: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version, one for each content; none where there is no cache yet."""
    spark = docs.sparkSession
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if exists(spark, cache_path) else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def _counted(distinct: DataFrame, path: str, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.load(path)
        for batch in batches:
            for part in pieces_of(batch, 1, CHUNK_BYTES):
                counts = np.diff(library.view(*utf8_view(part.column(1)))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tokenizer] * len(counts), pa.string()), pa.array(counts)], ["content", "tokenizer", "n_tokens"])

    return distinct.mapInArrow(run, CACHE_SCHEMA)


def token_counts(docs: DataFrame, path: str, cache_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: the key, n_bytes (UTF-8) and n_tokens. Appends the counts that the cache lacked.

    path is a tokenizers or sentencepiece file that every executor sees; cache_path a folder of Parquet files in
    a store that all share. A null text counts as empty. Repeated rows stay repeated. Texts are encoded whole.
    Copies are folded within each task before they are shuffled, so a text with very many copies is one row for
    each task; the join back is on digests only, by broadcast for the texts with most copies."""
    tokenizer = tokenizer_version(path)
    content = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), content.alias("content"))
    distinct = rows.groupBy("content").agg(F.first("_text").alias("_text"))
    if exists(docs.sparkSession, cache_path):
        distinct = distinct.join(cached_counts(docs, cache_path, tokenizer).select("content"), "content", "left_anti")
    _counted(distinct.select("content", "_text"), path, tokenizer).write.mode("append").parquet(cache_path)
    sized = stored(rows.select("_key", F.octet_length("_text").cast("long").alias("n_bytes"), "content"), "sized")
    copies = sized.groupBy("content").agg(F.count(F.lit(1)).alias("_copies"))
    counts = stored(copies.join(cached_counts(docs, cache_path, tokenizer), "content"), "counts")
    return joined_to_groups(sized, counts, "content", "_copies", sized.count()).select(F.col("_key").alias(key), "n_bytes", "n_tokens")
