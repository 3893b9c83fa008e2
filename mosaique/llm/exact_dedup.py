"""Exact dedup of incoming batches against immutable snapshots (operator 7).

A snapshot holds one entry for each distinct text: the digest of the normalised text, the key of the row that
stays and the number of rows. Entries are dealt to buckets by digest, and each bucket has a static binary fuse
filter. Duplicates inside a new batch are grouped by digest on their own; each group is screened once by the
filter of its bucket. A negative is surely new. Positives join the exact buckets, and the two texts are compared
byte by byte before the snapshot's row stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fuse_filter
from .common import joined_to_groups, stored

#: Entries of a bucket at most, about.
BUCKET_ENTRIES = 100_000


def normalised(text: str) -> Column:
    """White space runs as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class Snapshot:
    """entries: digest, keep, size; filters: bucket, filter; docs: rows (row_key, row_text) for byte checks."""

    entries: DataFrame
    filters: DataFrame
    docs: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def _keys(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(digests.to_pylist())
    return np.ascontiguousarray(np.frombuffer(raw, dtype="<u8").reshape(-1, 4)[:, 0]) if raw else np.zeros(0, dtype=np.uint64)


def freeze(entries: DataFrame, docs: DataFrame) -> Snapshot:
    """Makes a snapshot of distinct digests; docs holds the rows (row_key, row_text) the entries were made from."""
    spark = entries.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // BUCKET_ENTRIES))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.unique(_keys(table.column("digest")))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([fuse_filter.build(keys)], pa.binary())})

    filters = entries.select(_bucket(buckets), "digest").groupBy("bucket").applyInArrow(make, "bucket int, filter binary")
    return Snapshot(entries, stored(filters, "fuse-filters"), docs, buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups (digest, keep, size) that a snapshot may hold."""

    def probe(key: tuple, groups: pa.Table, filters: pa.Table) -> pa.Table:
        if not groups.num_rows or not filters.num_rows:
            return groups.slice(0, 0).select(["digest", "keep", "size"])
        maybe = fuse_filter.contains(filters.column("filter")[0].as_py(), _keys(groups.column("digest")))
        return groups.filter(pa.array(maybe)).select(["digest", "keep", "size"])

    kind = groups.schema["keep"].dataType.simpleString()
    dealt = groups.select(_bucket(snapshot.buckets), "digest", "keep", "size").groupBy("bucket")
    return dealt.cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(probe, f"digest binary, keep {kind}, size long")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("row_key").alias("keep"), F.count(F.lit(1)).alias("size"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("row_key"), normalised(text).alias("row_text"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest")


def text_hash(text: str) -> Column:
    """Tells the texts of rows with one key apart: a 64-bit hash and the number of bytes."""
    return F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, digest (SHA-256 of the normalised text) and text_hash of each row, written once."""
    rows = docs.select(F.col(key).alias("row_key"), normalised(text).alias("row_text"), text_hash(text).alias("text_hash"))
    return stored(rows.select("row_key", _digest("row_text"), "text_hash"), "digests")


def _texts_of(docs: DataFrame, pairs: DataFrame, keep: str, name: str) -> DataFrame:
    """The text of each digest of pairs, by key (null or not) and digest, as rows of other texts may have the key."""
    rows = docs.select("row_key", _digest("row_text").alias("text_digest"), "row_text")
    # by merge at every size: how much moves then grows as the table does, and no side is broadcast
    wanted = pairs.select(F.col(keep).alias("wanted_key"), "digest").hint("merge")
    found = rows.join(wanted, F.col("row_key").eqNullSafe(F.col("wanted_key")) & (F.col("text_digest") == F.col("digest")))
    return found.groupBy("digest").agg(F.first("row_text").alias(name))


def against(groups: DataFrame, docs: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The new groups whose text the snapshot holds: digest, old_keep, old_size. docs: the new rows (row_key, row_text)."""
    positive = stored(screen(groups, snapshot), "screened")
    old = snapshot.entries.select("digest", F.col("keep").alias("old_keep"), F.col("size").alias("old_size"))
    pairs = stored(positive.join(old, "digest").select("digest", F.col("keep").alias("new_keep"), "old_keep", "old_size"), "positives")
    new_text, old_text = _texts_of(docs, pairs, "new_keep", "new_text"), _texts_of(snapshot.docs, pairs, "old_keep", "old_text")
    same = new_text.join(old_text, "digest").filter(F.col("new_text") == F.col("old_text")).select("digest")
    return pairs.join(same, "digest", "left_semi").select("digest", "old_keep", "old_size")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hashes: bool = False) -> DataFrame:
    """Dedups a table as two batches: the rows of the lower half of the span of keys become the snapshot, the
    others come in against it; keys that are no whole numbers are halved by a hash. Per row: the key, keep_id,
    group_size, kept and text_sha256; with hashes also text_hash (of the text as it is).

    Of equal normalised texts the row of the smallest key stays, in whichever batch it is. Null
    texts count as empty. A null key is never the one that stays unless all keys of its group are null; then
    keep_id is null and no row of the group counts as kept but those (kept is true for them). Repeated rows with
    the key that stays are all kept, as nothing tells them apart. Only digests are shuffled, folded within each
    task first; texts move for the byte check of the positives alone."""
    rows = digests(docs, key, text)
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        span = rows.agg(F.min("row_key").alias("a"), F.max("row_key").alias("b")).first()
        middle = F.lit(None).cast("long") if span["a"] is None else F.lit(span["a"] + (span["b"] - span["a"]) // 2)
        early = F.coalesce(F.col("row_key") <= middle, F.lit(False))
    else:
        early = F.pmod(F.xxhash64("row_key"), F.lit(2)) == 0
    texts = _rows(docs, key, text)
    old, new = stored(_groups(rows.filter(early)), "groups-old"), stored(_groups(rows.filter(~early)), "groups-new")
    snapshot = freeze(old, texts.filter(early))
    matched = stored(against(new, texts.filter(~early), snapshot), "matched")
    joined = new.join(matched, "digest", "left")
    fresh = joined.filter(F.col("old_size").isNull()).select("digest", "keep", "size")
    both = joined.filter(F.col("old_size").isNotNull()).select("digest", F.least("old_keep", "keep").alias("keep"), (F.col("size") + F.col("old_size")).alias("size"))
    kept_old = old.join(matched.select("digest"), "digest", "left_anti").select("digest", "keep", "size")
    final = stored(kept_old.unionByName(fresh).unionByName(both), "groups")
    return joined_to_groups(rows, final, "digest", "size", rows.count()).select(
        F.col("row_key").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("row_key").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["text_hash"] if hashes else []),
    )
