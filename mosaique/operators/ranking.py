"""Order, rank, pages, neighbours and grids.

Ranks over a whole listing need its total order. `numbered` finds it without one task that holds all rows: rows
are dealt by ranges of the order, and each range starts from the number of rows in the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions_for
from ..storage import stored


def numbered(rows: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """rows with their place in an order, from 0. Equal rows are numbered in any order."""
    spark = rows.sparkSession
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = partitions_for(spark, rows.count())
    ranged = stored(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sums, before, bases = sorted(ranged.groupBy("_part").count().collect()), 0, []  # a row for each partition
    for part, n in sums:
        bases.append((part, before))
        before += n
    base = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    w = Window.partitionBy("_part").orderBy(*keys)
    return ranged.withColumn("_row", F.row_number().over(w)).join(base, "_part").withColumn(name, F.col("_base") + F.col("_row") - 1).drop("_part", "_row", "_base")


def ranked(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with rank, from 1."""
    return numbered(rows, *order, name="_n").withColumn("rank", F.col("_n") + 1).drop("_n")


def ranked_top(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in order with rank, from 1; n rows fit one task."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return top(rows, n, *keys).withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long")) if n else ranked(rows, *keys)


def top(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in order, all for n = 0."""
    sorted_ = rows.orderBy(*order)
    return sorted_.limit(n) if n else sorted_


def page(rows: DataFrame, start: int, size: int, *order: str | Column) -> DataFrame:
    """Rows from start to before start + size in order."""
    return rows.orderBy(*order).offset(start).limit(size)


def neighbours(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """rows with idx, total, position (`k / n`), previous_key and next_key; the ends wrap round."""
    placed = stored(numbered(rows, *order), "placed")
    total = placed.count()
    slim = placed.select("idx", F.col(key).alias("_key"))
    before = slim.select(F.pmod(F.col("idx") + 1, F.lit(max(total, 1))).alias("idx"), F.col("_key").alias("previous_key"))
    after = slim.select(F.pmod(F.col("idx") - 1, F.lit(max(total, 1))).alias("idx"), F.col("_key").alias("next_key"))
    out = placed.join(before, "idx").join(after, "idx").withColumn("total", F.lit(total).cast("long"))
    return out.withColumn("position", F.format_string("%d / %d", F.col("idx") + 1, F.col("total")))


def chunked(rows: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """rows with chunk, the number of their chunk of so many rows."""
    return numbered(rows, *order).withColumn("chunk", F.floor(F.col("idx") / size))


def grid(rows: DataFrame, columns: int, *order: str | Column) -> DataFrame:
    """rows with grid_row and grid_col."""
    return numbered(rows, *order).withColumns({"grid_row": F.floor(F.col("idx") / columns), "grid_col": F.pmod(F.col("idx"), F.lit(columns))})


def visible(rows: DataFrame, columns: int, scroll: float, height: float, row_height: float, *order: str | Column, overscan: int = 3) -> DataFrame:
    """The rows of a grid that a window shows, with some lines more on both sides."""
    first = max(0, int(scroll // row_height) - overscan)
    last = -int(-(scroll + height) // row_height) + overscan
    return grid(rows, columns, *order).filter((F.col("grid_row") >= first) & (F.col("grid_row") < last))


def name_contains(rows: DataFrame, query: str, column: str = "file_name") -> DataFrame:
    """Rows whose name holds a text in any case; the empty text finds all."""
    return rows.filter(F.contains(F.lower(column), F.lit(query.lower()))) if query else rows


def every_nth(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """Of rows in order every (count / n)-th, n of them at most."""
    placed = stored(numbered(rows, *order), "placed")
    step = max(1, placed.count() // n)
    return placed.filter((F.col("idx") % step == 0) & (F.col("idx") < step * n))


def cycled(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """n rows (i from 0) that run through rows again and again; none if there are none."""
    placed = stored(numbered(rows, *order), "placed")
    total = placed.count()
    if not total:
        return placed.withColumn("i", F.lit(None).cast("long")).drop("idx")
    return rows.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % total).alias("idx")).join(placed, "idx").drop("idx")


def distinct_requests(requests: DataFrame, key: str = "path", attempts: str = "attempts", most: int = 3) -> DataFrame:
    """Queued requests once each, without those tried too often."""
    return requests.groupBy(key).agg(F.max(attempts).alias(attempts)).filter(F.col(attempts) < most)


def with_entries(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Results joined to their catalog rows by path; what is not in the catalog gets zeros."""
    known = entries.select("path", "file_size", "modified")
    out = results.join(known, "path", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("file_size", "modified")})
