"""The feature cache: a Parquet table of vectors with the identity of the file each was made from.

A vector is valid if path, size, modification time and length match, and, unless `legacy_keys` is set, model and
tier too. The table is a folder of versions; a write makes a new version and then names it, so readers see the
old rows or the new ones. A cache that cannot be read counts as empty.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, hadoop, remove

SCHEMA = (
    "path string, file_name string, file_size long, last_modified long, features array<float>, feature_length int, "
    "model_id string, tier string, created_at long, updated_at long"
)
IDENTITY = ["path", "file_size", "last_modified"]
FORMAT_VERSION = 1


def split(entries: DataFrame, cache: DataFrame, dim: int, model_id: str | None = None, tier: str | None = None) -> DataFrame:
    """entries with `features` of a valid cache row, null where there is none. One hash join in place of a look-up
    for each file; the length is tested before the join, on a column that the scan can skip by."""
    valid = cache.filter((F.col("feature_length") == dim) & (F.size("features") == dim))
    if model_id is not None:
        valid = valid.filter((F.col("model_id") == model_id) & (F.col("tier") == tier))
    return entries.drop("features").join(valid.select(*IDENTITY, "features"), IDENTITY, "left")


def hits(entries: DataFrame, cache: DataFrame, dim: int, **keys: str) -> DataFrame:
    return split(entries, cache, dim, **keys).filter("features IS NOT NULL")


def misses(entries: DataFrame, cache: DataFrame, dim: int, model_id: str | None = None, tier: str | None = None) -> DataFrame:
    valid = cache.filter((F.col("feature_length") == dim) & (F.size("features") == dim))
    if model_id is not None:
        valid = valid.filter((F.col("model_id") == model_id) & (F.col("tier") == tier))
    return entries.join(valid.select(*IDENTITY), IDENTITY, "left_anti")


def counts(entries: DataFrame, cache: DataFrame, dim: int, **keys: str) -> DataFrame:
    """One row: total, cache_hits, cache_misses."""
    found = F.count("features")
    total = F.count(F.lit(1))
    return split(entries, cache, dim, **keys).agg(total.alias("total"), found.alias("cache_hits"), (total - found).alias("cache_misses"))


def latest(rows: DataFrame, key: str = "path", time_: str = "updated_at", *tie: str) -> DataFrame:
    """The newest row of each key: an append-only table read as if each write had replaced its key. Rows of a key
    are folded in each task before they are shuffled."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(time_, *tie)).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, "_row.*").select(*rows.columns)


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of cache with the same path; of a path twice in new the last written stays."""
    new = latest(new, "path", "updated_at", "file_size", "last_modified")
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new)


def merged(hits_: DataFrame, extracted: DataFrame) -> DataFrame:
    """Hits and fresh rows, which have no path in common."""
    return hits_.unionByName(extracted)


class FeatureCache:
    """A cache below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _head(self) -> str:
        return f"{self.root}/_current.json"

    def _current(self) -> dict | None:
        if not exists(self.spark, self._head):
            return None
        try:
            line = self.spark.read.text(f"{self.root}/_current.json").first()
        except Exception:
            line = None
        if line is None:  # names that begin with _ are hidden from readers: read it as a stream
            at, fs = hadoop(self.spark, self._head)
            stream = fs.open(at)
            try:
                line = [bytes(stream.readAllBytes()).decode()]
            finally:
                stream.close()
        try:
            return json.loads(line[0])
        except (ValueError, TypeError):
            warnings.warn(f"cache {self.root} cannot be read and counts as empty", stacklevel=2)
            return None

    def identity(self) -> str | None:
        """Names the present contents; changes with each write."""
        now = self._current()
        return now["version"] if now else None

    def rows(self) -> DataFrame:
        now = self._current()
        if not now or not exists(self.spark, f"{self.root}/{now['version']}"):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{now['version']}")

    def load(self, dim: int) -> DataFrame:
        """All rows of one length; the scalar column lets the scan skip others."""
        return self.rows().filter((F.col("feature_length") == dim) & (F.size("features") == dim))

    def get(self, path: str, size: int, modified: int, dim: int) -> list[float] | None:
        row = self.load(dim).filter((F.col("path") == path) & (F.col("file_size") == size) & (F.col("last_modified") == modified)).limit(1).collect()
        return list(row[0]["features"]) if row else None

    def store(self, new: DataFrame, model_id: str = "default", tier: str = "fast") -> None:
        """Upserts rows with path, file_name, file_size, last_modified and features, all or none of them."""
        now = int(time.time())
        stamped = {"model_id": F.lit(model_id), "tier": F.lit(tier), "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")}
        rows = new.select(*IDENTITY, "file_name", F.col("features").cast("array<float>").alias("features"))
        rows = rows.withColumns({"feature_length": F.size("features"), **stamped}).select(*(c.split()[0] for c in SCHEMA.split(", ")))
        old, version = self._current(), f"v-{uuid.uuid4().hex}"
        upsert(self.rows(), rows).write.parquet(f"{self.root}/{version}")
        at, fs = hadoop(self.spark, self._head)
        out = fs.create(at, True)
        try:
            out.write(bytearray(json.dumps({"format": FORMAT_VERSION, "version": version}).encode()))
        finally:
            out.close()
        if old:
            remove(self.spark, f"{self.root}/{old['version']}")

    def stats(self) -> DataFrame:
        """One row: cached_count (all rows, valid or not), cache_size_bytes, is_valid."""
        now = self._current()
        size = 0
        if now and exists(self.spark, f"{self.root}/{now['version']}"):
            at, fs = hadoop(self.spark, f"{self.root}/{now['version']}")
            size = fs.getContentSummary(at).getLength()
        return self.rows().agg(F.count(F.lit(1)).alias("cached_count")).select("cached_count", F.lit(size).cast("long").alias("cache_size_bytes"), F.lit(now is not None).alias("is_valid"))

    def clear(self) -> bool:
        """Deletes the cache; True if there was one. A second call does nothing."""
        there = exists(self.spark, self.root)
        if there:
            remove(self.spark, self.root)
        return there
