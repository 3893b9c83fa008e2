"""The image catalog of a folder: metadata only, no pixels are read.

`scan` lists folders with a Python data source, whose rules are exact: names that begin with a dot are passed
over with all below them (not the root itself), other names count, symbolic links do not, only image extensions
do. `scan_binary` uses Spark's own listing, which scales over object stores but leaves out names that begin with
an underscore.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import files

SCHEMA = "path string, file_name string, file_size long, modified long, filetime long, thumbnail string"


class NotAFolder(ValueError):
    """The root of a scan is missing or no directory."""


#: Folders that are listed apart, at least, where there are so many.
FOLDERS = 64


def folders_in(folder: str) -> list[str]:
    """The folders in a folder, but those whose names begin with a dot; none if it cannot be listed."""
    try:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if not e.name.startswith(".") and e.is_dir(follow_symlinks=False))
    except OSError:
        return []


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


def walk(folder: str, deep: bool) -> Iterator[tuple]:
    """Rows of SCHEMA below a folder. What cannot be listed or read is passed over; an unknown time is 0."""
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for entry in found:
        if entry.name.startswith("."):
            continue
        try:
            if entry.is_dir(follow_symlinks=False):
                if deep:
                    yield from walk(entry.path, True)
                continue
            if not entry.is_file(follow_symlinks=False):
                continue
            stem, _, kind = entry.name.rpartition(".")
            if not stem or kind.lower() not in files.IMAGE_EXTENSIONS:
                continue
            stat = entry.stat(follow_symlinks=False)
        except OSError:
            continue
        ticks = stat.st_mtime_ns // 100
        yield entry.path, entry.name, stat.st_size, max(0, stat.st_mtime_ns // 1_000_000_000), files.FILETIME_EPOCH + ticks, None


class _Reader(DataSourceReader):
    def __init__(self, root: str, deep: bool):
        self.root, self.deep = root, deep

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each folder in it; a level further down while those are few, so that one deep
        tree is not one part."""
        if not self.deep:
            return [_Part(self.root, False)]
        flat, deep = [], [self.root]
        while deep and len(deep) < FOLDERS:
            below = [x for folder in deep for x in folders_in(folder)]
            flat, deep = flat + deep, below
        return [*(_Part(p, False) for p in flat), *(_Part(p, True) for p in deep)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names, held = [c.split()[0] for c in SCHEMA.split(", ")], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for row in walk(partition.folder, partition.deep):
            held.append(row)
            if len(held) == 10_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class CatalogSource(DataSource):
    """Format `image_catalog`: options path and recursive."""

    @classmethod
    def name(cls) -> str:
        return "image_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("recursive", "true").lower() == "true")


def scan(spark: SparkSession, root: str, recursive: bool = True, progress: Callable[[int, float], None] | None = None) -> DataFrame:
    """The catalog in order of file_name, then path. A root with a scheme other than `file:` is one of a store, which
    Spark lists.

    With progress the folder is listed at once, a part at a time, and progress is called with the number of files
    found so far and the seconds: every quarter of a second at most, and at the end."""
    if "://" in root and not root.startswith("file:"):
        return scan_binary(spark, root, recursive)
    if not os.path.exists(root):
        raise NotAFolder(f"folder does not exist: {root}")
    if not os.path.isdir(root):
        raise NotAFolder(f"not a directory: {root}")
    spark.dataSource.register(CatalogSource)
    rows = spark.read.format("image_catalog").option("recursive", str(recursive)).load(root)
    if progress is not None:
        rows = rows.persist()
        began = told = time.monotonic()
        found = 0
        counts = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        for row in counts.toLocalIterator(prefetchPartitions=True):
            found += row["n"]
            if time.monotonic() - told >= 0.25:
                told = time.monotonic()
                progress(found, told - began)
        progress(found, time.monotonic() - began)
    return rows.orderBy("file_name", "path")


def thumbnail_count(entries: DataFrame) -> int:
    """How many images of a catalog have a thumbnail already."""
    return entries.agg(F.count("thumbnail").alias("n")).first()["n"]


def scan_binary(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The catalog by Spark's binaryFile source; only names, lengths and times are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").load(root)
    top = root.rstrip("/")
    relative = F.substr(F.col("path"), F.instr(F.col("path"), top) + F.lit(len(top)))
    kept = rows.select("path", "length", "modificationTime").filter(files.is_image(F.col("path")) & ~files.is_hidden(relative))
    return kept.select(
        "path",
        files.file_name(F.col("path")).alias("file_name"),
        F.col("length").alias("file_size"),
        files.epoch_seconds(F.col("modificationTime")).alias("modified"),
        files.filetime(F.col("modificationTime")).alias("filetime"),
        F.lit(None).cast("string").alias("thumbnail"),
    ).orderBy("file_name", "path")


def contents(entries: DataFrame, column: str = "path") -> DataFrame:
    """entries with `content`, the bytes of each file; null where it cannot be read. A path without a scheme, or of
    `file:`, must be mounted where the task runs; others are URIs of a store."""
    names = entries.columns
    at = names.index(column)

    def read(path: str | None) -> bytes | None:
        try:
            if "://" in path and not path.startswith("file:"):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as file:
                    return file.read()
            with open(path.removeprefix("file:"), "rb") as file:
                return file.read()
        except (OSError, AttributeError, TypeError, pa.ArrowInvalid):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # few files at a time are in memory
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([read(p) for p in part.column(at).to_pylist()], pa.binary())], [*names, "content"])

    return entries.mapInArrow(run, StructType([*entries.schema.fields, StructField("content", BinaryType())]))


def read_image(path: str) -> str:
    """A whole file as base64."""
    import base64

    with open(path, "rb") as file:
        return base64.b64encode(file.read()).decode()


def file_identity(path: str) -> tuple[int, int]:
    """Size and FILETIME of a file."""
    stat = os.stat(path)
    return stat.st_size, files.FILETIME_EPOCH + stat.st_mtime_ns // 100
