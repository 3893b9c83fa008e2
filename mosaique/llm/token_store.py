"""Token ids in files of one wavelet matrix each (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ended, pieces_of, stored, utf8_view
from .tokenizer_library import Library
from .wavelet import WaveletFile, dump

CHUNK_BYTES = 8 << 20
#: Documents of one range of keys, at least; at most this many ranges; tokens after which a file is closed.
RANGE_ROWS, MOST_RANGES, FILE_TOKENS = 2048, 20_000, 2 << 20


def _bounds(docs: DataFrame, key: str) -> list[int]:
    """Keys at which ranges of about equal numbers of rows begin."""
    rows = docs.select(F.col(key).cast("long").alias("key"))
    n = min(MOST_RANGES, max(1, rows.count() // RANGE_ROWS))
    at = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("key", at, 10_000).alias("at")).first()["at"] if at else []
    return sorted(set(found or []))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, appends end_id and writes the ids in ascending order of the keys. Returns the list of
    files: range, file (its number in the range), name, tokens.

    folder is a URI in a store that all executors reach. A null text counts as empty and has the end id only; a
    null key comes first and is kept as the smallest long; repeated keys stay, ordered by their ids. Texts are
    shuffled as ids, by ranges of keys that are found from the keys alone, so the encoding runs once."""
    bounds = np.array(_bounds(docs, key), dtype=np.int64)
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.load(path)
        kind = np.uint16 if library.vocab_size <= 1 << 16 else np.uint32
        for batch in batches:
            for part in pieces_of(batch, 1, CHUNK_BYTES):
                keys = part.column(0).fill_null(np.iinfo(np.int64).min)
                ids, ends = library.view(*utf8_view(part.column(1)))
                raw = ended(ids.astype(kind, copy=False), ends, end_id)
                ends = (ends + np.arange(len(ends))) * kind().itemsize
                ids = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                ranges = np.searchsorted(bounds, keys.to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), keys, ids], ["range", "key", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.load(path)
        bits = max(1, int(library.vocab_size - 1).bit_length())
        kind = np.uint16 if library.vocab_size <= 1 << 16 else np.uint32
        now, file, keys, data, size = -1, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), dtype=kind)
            ends = np.cumsum([len(x) // kind().itemsize for x in data])
            name = f"{now:06d}-{file:06d}.wvm"
            store_file(f"{folder}/{name}", dump(ids, np.array(keys, dtype=np.int64), ends, bits))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([file], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64())], ["range", "file", "name", "tokens"])

        for batch in batches:
            for at, key_, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data and (at != now or size >= FILE_TOKENS):
                    yield close()
                    file, keys, data, size = (file + 1 if at == now else 0), [], [], 0
                now = at
                keys.append(key_)
                data.append(ids)
                size += len(ids) // kind().itemsize
        if data:
            yield close()

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(encode, "range int, key long, ids binary")
    dealt = rows.repartition(max(len(bounds) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "range").sortWithinPartitions("range", "key", "ids")
    return stored(dealt.mapInArrow(write, "range int, file int, name string, tokens long"), "token-files")


def store_file(uri: str, data: bytes) -> None:
    """Writes under another name, then renames: no reader sees half a file, and a repeated task puts the same bytes."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/_{np.random.default_rng().integers(1 << 62)}.tmp"
    with store.open_output_stream(part) as out:
        out.write(data)
    if store.get_file_info(path).type != fs.FileType.NotFound:  # of an attempt that was lost; some stores do not move onto a file
        store.delete_file(path)
    store.move(part, path)


def read_tokens(spark: SparkSession, files: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: the key, start (ids of all documents before it), n_tokens and ids_crc32
    (of its ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = WaveletFile(batch.column(1)[i].as_py())
                ids = file.all().astype("<u4")
                ends = file.ends
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n), pa.array(file.keys), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["name", "key", "inside", "n_tokens", "ids_crc32"])

    if files.isEmpty():  # then there is no folder
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids_crc32 long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = found.mapInArrow(run, "name string, key long, inside long, n_tokens long, ids_crc32 long")
    per_range = files.groupBy("range").agg(F.sum("tokens").alias("tokens")).orderBy("range").collect()  # MOST_RANGES at most
    before, bases = 0, []
    for r in per_range:
        bases.append((r["range"], before))
        before += r["tokens"]
    base = spark.createDataFrame(bases, "range int, base long")
    inner = Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.withColumn("earlier", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(base, "range").select("name", (F.col("base") + F.col("earlier")).alias("offset"))
    smallest = F.col("key") == F.lit(-(1 << 63))
    return rows.join(offsets, "name").select(F.when(~smallest, F.col("key")).alias(key), (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
