"""What the operators share: written tables, Arrow text views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaique.session import partitions_for
from mosaique.storage import exists, forget, fresh_path, remove, shared_dir, stored

__all__ = ["ended", "exists", "forget", "fresh_path", "joined_to_groups", "partitions_for", "pieces_of", "remove", "shared_dir", "stored", "texts_of", "utf8_view"]

def joined_to_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """rows joined to their groups: one row for each value of a column that all rows have, and size, the number of
    rows that have it, of total in all.

    Groups that alone have a quarter of a partition's share or more of the rows are broadcast, of which there are at
    most four for each partition. So no task gets all rows of a large group. groups is read twice, so it should be
    stored."""
    most = max(1, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(groups.filter(F.col(size) > most))
    rest = rows.join(F.broadcast(groups.filter(F.col(size) > most).select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(groups.filter(F.col(size) <= most), on))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and the n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def ended(values: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """values of n texts (n + 1 offsets) with an end put after each text's."""
    out = np.full(len(values) + len(offsets) - 1, end, dtype=values.dtype)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[a + i : b + i] = values[a:b]
    return out


def pieces_of(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = utf8_view(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
