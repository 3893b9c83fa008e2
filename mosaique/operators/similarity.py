"""Exact vector search: one query against a folder, and the best match of each target over all sources.

A folder is a DataFrame with `path`, `file_name` and `features`. Products run in numpy, a batch of rows at a time
(`gemm`), or as expressions (`sql`, while pairs are few); both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vector
from ..functions.files import normal_path
from ..storage import stored

#: Vectors of the source side that are sent to the executors, and of a block, at most.
SOURCE_BYTES = 64 << 20
#: Rows of a product that are computed together.
ROWS = 2048
#: Pairs that best_matches_sql lists, at most.
SQL_PAIRS = 1 << 22


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and the numbers of those rows; others and vectors with nulls are left out."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.flatnonzero((lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    starts = column.offsets.to_numpy()[:-1][good]
    if not len(good):
        return np.zeros((0, dim)), good
    return values[starts[:, None] + np.arange(dim)], good


def _normalised(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > vector.TINY, norms, 1.0)


def similarity_to(folder: DataFrame, query: list[float], column: str = "features", engine: str = "gemm") -> DataFrame:
    """folder with `similarity` to a query vector; rows of another length are dropped, NaN stays NaN."""
    if engine == "sql":
        values = F.array(*(F.lit(float(x)) for x in query))
        return folder.filter(F.size(column) == len(query)).withColumn("similarity", vector.dot(F.col(column), values))
    names = folder.columns
    at, want = names.index(column), np.asarray(query, dtype=np.float64)
    schema = StructType([*folder.schema.fields, StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, good = _matrix(batch.column(at), len(want))
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(m @ want)], [*names, "similarity"])

    return folder.mapInArrow(run, schema)


def ordered(results: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Best first; equal ones by file name, then path."""
    return results.orderBy(F.desc(similarity), "file_name", "path")


def similar(
    folder: DataFrame, query: list[float], source_path: str | None = None, threshold: float = 0.9, limit: int = 0, engine: str = "gemm"
) -> DataFrame:
    """Rows of a folder at least as similar as threshold, without the query's own path, best first.

    limit 0 gives all rows. With a limit Spark keeps the best of each task only."""
    rows = folder
    if source_path is not None:
        rows = rows.filter(~normal_path(F.col("path")).eqNullSafe(normal_path(F.lit(source_path))))
    found = similarity_to(rows.select("path", "file_name", "features"), query, engine=engine)
    found = ordered(found.filter(vector.at_least(F.col("similarity"), threshold)).drop("features"))
    return found.limit(limit) if limit else found


def _best(targets: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each target the largest product with a source; NaN products do not count."""
    best = np.full(len(targets), -np.inf)
    for i in range(0, len(targets), ROWS):
        for j in range(0, len(sources), ROWS):
            products = targets[i : i + ROWS] @ sources[j : j + ROWS].T
            np.fmax(best[i : i + ROWS], np.fmax.reduce(products, axis=1), out=best[i : i + ROWS])
    return best


def _best_rows(batch: pa.RecordBatch | pa.Table, sources: np.ndarray, dim: int) -> list[pa.Array]:
    """Columns path, file_name and best of the rows (path, file_name, features) whose vectors have the length."""
    vectors = batch.column(2)
    m, good = _matrix(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors, dim)
    kept = batch.take(pa.array(good))
    return [kept.column(0), kept.column(1), pa.array(_best(_normalised(m), sources))]


BEST = ["path", "file_name", "best"]


def _best_of_sent(targets: DataFrame, sources: np.ndarray, dim: int) -> DataFrame:
    sent = targets.sparkSession.sparkContext.broadcast(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_best_rows(batch, sent.value, dim), BEST)

    return targets.select("path", "file_name", "features").mapInArrow(run, "path string, file_name string, best double")


def _best_of_cells(sources: DataFrame, targets: DataFrame, dim: int, source_blocks: int, target_blocks: int) -> DataFrame:
    """A cell for each block of sources and block of targets, each a task's work; maxima are folded by target."""
    deal = lambda df, blocks: F.pmod(F.xxhash64("path", "file_name"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = sources.withColumn("i", deal(sources, source_blocks)).withColumn("j", every(target_blocks)).select("i", "j", "features")
    right = targets.withColumn("j", deal(targets, target_blocks)).withColumn("i", every(source_blocks)).select("i", "j", "path", "file_name", "features")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], BEST)
        matrix = _normalised(_matrix(a.column("features").combine_chunks(), dim)[0])
        return pa.table(_best_rows(b.select(["path", "file_name", "features"]), matrix, dim), BEST)

    cells = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "path string, file_name string, best double")
    return cells.groupBy("path", "file_name").agg(F.max("best").alias("best"))


def best_matches(sources: DataFrame, targets: DataFrame, dim: int | None = None) -> DataFrame:
    """Per target: path, file_name and best, the largest similarity over all sources; no rows without sources.

    All vectors are made unit length again. dim is that of the first source in order of file_name and path unless
    given; vectors of other lengths are left out on both sides. Sources of SOURCE_BYTES at most are sent to all
    tasks, and targets are only mapped; more of them are dealt into blocks, as the targets are, and each block of one
    meets each of the other in a cell."""
    order = F.struct(F.coalesce("file_name", F.lit("")), F.coalesce("path", F.lit("")))
    size = F.size("features")
    sizes = sources.groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"))
    found = sorted((r["first"], r["n"], r["rows"]) for r in sizes.orderBy("first").collect())  # a row for each length
    schema = "path string, file_name string, best double"
    dim = dim if dim is not None else found[0][1] if found else 0
    rows = sum(n for _, d, n in found if d == dim)
    if dim <= 0 or not rows:
        return targets.sparkSession.createDataFrame([], schema)
    fitting = sources.filter(size == dim).select("path", "file_name", F.col("features").cast("array<double>").alias("features"))
    blocks = -(-rows * dim * 8 // SOURCE_BYTES)
    if blocks == 1:
        part = fitting.select("features").toArrow().column(0).combine_chunks()
        matrix = _normalised(_matrix(part.chunk(0) if isinstance(part, pa.ChunkedArray) else part, dim)[0])
        return _best_of_sent(targets, matrix, dim) if len(matrix) else targets.sparkSession.createDataFrame([], schema)
    others = targets.filter(size == dim)
    return _best_of_cells(fitting, others, dim, blocks, max(1, -(-others.count() * dim * 8 // SOURCE_BYTES)))


def best_matches_sql(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The same as expressions: the definition that best_matches is tested against. A pair is a row there, so over
    SQL_PAIRS pairs the products come from best_matches."""
    first = sources.select(F.min_by(F.size("features"), F.struct(F.coalesce("file_name", F.lit("")), F.coalesce("path", F.lit("")))).alias("n")).first()["n"] or 0
    targets, sources = (rows.filter(F.size("features") == first) for rows in (targets, sources))
    if targets.count() * sources.count() > SQL_PAIRS:
        return best_matches(sources, targets, first).groupBy("path", "file_name").agg(F.max("best").alias("best"))
    left = targets.select("path", "file_name", vector.l2_normalize(F.col("features")).alias("t"))
    right = sources.select(vector.l2_normalize(F.col("features")).alias("s"))
    sim = F.nanvl(vector.dot(F.col("t"), F.col("s")), F.lit(float("-inf")))
    pairs = left.crossJoin(right).select("path", "file_name", sim.alias("sim"))
    return pairs.groupBy("path", "file_name").agg(F.max("sim").alias("best"))


def compare(sources: DataFrame, targets: DataFrame, threshold: float = 0.9, engine: str = "gemm", best_first: bool = True) -> DataFrame:
    """One row for each target whose best match reaches threshold: target_path, target_file_name,
    best_similarity, best first unless any order will do. A folder against itself finds each image itself; an empty
    source finds nothing."""
    best = best_matches(sources, targets) if engine == "gemm" else best_matches_sql(sources, targets)
    kept = best.filter(vector.at_least(F.col("best"), threshold)).withColumnRenamed("best", "similarity")
    named = {"path": "target_path", "file_name": "target_file_name", "similarity": "best_similarity"}
    return (ordered(kept) if best_first else kept).withColumnsRenamed(named)


def pairs_at_least(rows: DataFrame, threshold: float, key: str = "key", column: str = "features") -> DataFrame:
    """Pairs a < b of keys whose similarity reaches threshold; null keys are in none. Rows of SOURCE_BYTES at most are
    sent to all tasks; more of them are dealt into blocks, and each two blocks meet in a cell. Only pairs that reach
    the threshold leave a task."""
    dim_row = rows.select(F.size(column).alias("n")).filter("n > 0").first()
    schema = "a long, b long, similarity double"
    if dim_row is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = dim_row["n"]
    slim = rows.filter(F.size(column) == dim).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v")).filter("key IS NOT NULL")

    def pairs(keys: np.ndarray, m: np.ndarray, names: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
        for i in range(0, len(m), ROWS):
            for j in range(0, len(right), ROWS):
                products = m[i : i + ROWS] @ right[j : j + ROWS].T
                a, b = np.nonzero(products >= threshold)
                low = keys[i + a] < names[j + b]
                yield keys[i + a[low]], names[j + b[low]], products[a[low], b[low]]

    def read(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        vectors = table.column(1)
        m, good = _matrix(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors, dim)
        return table.column(0).to_numpy()[good], m

    blocks = max(1, -(-slim.count() * dim * 8 // SOURCE_BYTES))
    if blocks == 1:
        sent = rows.sparkSession.sparkContext.broadcast(read(slim.toArrow().combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in pairs(*read(batch), *sent.value):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "similarity"])

        return slim.mapInArrow(run, schema)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = dealt.select("key", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def meet(table: pa.Table) -> pa.Table:
        keys, m = read(table)
        i, j, block = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = list(pairs(keys[left], m[left], keys[right], m[right]))
        found += pairs(keys[right], m[right], keys[left], m[left]) if i != j else []
        columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, dtype=(np.int64, np.int64, np.float64)[k]) for k in range(3)]
        return pa.table([pa.array(x) for x in columns], ["a", "b", "similarity"])

    return cells.groupBy("i", "j").applyInArrow(meet, schema)


def first_vector(candidates: list[DataFrame]) -> list[float] | None:
    """The vector of the first of some one-row frames that has one: folder, then cache, then fresh."""
    for frame in candidates:
        row = frame.select("features").limit(1).collect()
        if row and row[0]["features"] is not None:
            return list(row[0]["features"])
    return None


def agreement(scores: DataFrame) -> DataFrame:
    """Scores (backend, item, similarity) of several backends: for each item the least, the most and the spread, and
    the largest spread of all."""
    each = scores.groupBy("item").agg(F.min("similarity").alias("low"), F.max("similarity").alias("high"))
    each = stored(each.withColumn("spread", F.col("high") - F.col("low")), "agreement")
    return each.withColumn("max_spread", F.lit(each.agg(F.max("spread")).first()[0]).cast("double"))


def backend_pairs(vectors: DataFrame) -> DataFrame:
    """Vectors (backend, item, features): the similarity of each item's vectors by each two backends."""
    a = vectors.select(F.col("backend").alias("backend_a"), "item", F.col("features").alias("x"))
    b = vectors.select(F.col("backend").alias("backend_b"), "item", F.col("features").alias("y"))
    both = a.join(b, "item").filter("backend_a < backend_b")
    return both.select("item", "backend_a", "backend_b", vector.dot(F.col("x"), F.col("y")).alias("similarity"))
