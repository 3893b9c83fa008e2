"""Feature caches in SQLite files, as a data source.

Table ImageFeatures: FilePath, FileName, FileSize, LastModified (FILETIME), DinoFeatures (little-endian floats),
DinoFeatureLength, CreatedAt, UpdatedAt. A file that cannot be read counts as empty.
"""

from __future__ import annotations

import os
import sqlite3
import warnings
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, file_name string, file_size long, last_modified long, features array<float>, feature_length int, created_at long, updated_at long"
#: Fixed value: the columns of the table, in the order of SCHEMA.
COLUMNS = "FilePath, FileName, FileSize, LastModified, DinoFeatures, DinoFeatureLength, CreatedAt, UpdatedAt"
#: Rows of a file that one task reads.
ROWS = 50_000


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low))
        self.path, self.low, self.high = path, low, high


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, path: str, dim: int | None):
        self.path, self.dim = path, dim

    def partitions(self) -> list[InputPartition]:
        try:
            with _open(self.path) as db:
                last = db.execute("SELECT max(rowid) FROM ImageFeatures").fetchone()[0] or 0
        except sqlite3.Error as error:
            warnings.warn(f"{self.path} counts as empty: {error}", stacklevel=2)
            return [_Range(self.path, 0, -1)]
        return [_Range(self.path, i, i + ROWS - 1) for i in range(0, last + 1, ROWS)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.high < part.low:
            return
        where = "rowid BETWEEN ? AND ?" + (" AND DinoFeatureLength = ?" if self.dim else "")
        with _open(part.path) as db:
            for row in db.execute(f"SELECT {COLUMNS} FROM ImageFeatures WHERE {where}", (part.low, part.high, *([self.dim] if self.dim else []))):
                blob = row[4] or b""
                vector = np.frombuffer(blob[: len(blob) // 4 * 4], dtype="<f4").tolist()
                if self.dim and len(vector) != self.dim:
                    continue
                yield (*row[:4], vector, *row[5:])


class LegacyCacheSource(DataSource):
    """Format `legacy_feature_cache`: options path and dim (then rows of other lengths are not read)."""

    @classmethod
    def name(cls) -> str:
        return "legacy_feature_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        dim = self.options.get("dim")
        return _Reader(self.options["path"], int(dim) if dim else None)


def read_legacy(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Rows of an old cache; none if there is no file."""
    if not os.path.isfile(path):
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(LegacyCacheSource)
    reader = spark.read.format("legacy_feature_cache")
    return (reader.option("dim", dim) if dim else reader).load(path)
