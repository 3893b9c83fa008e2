"""Shards of consecutive groups with the smallest possible largest shard (operator 5).

Rows with equal texts are one atomic group. Groups are ordered by their smallest key and have running sums of
bytes. The smallest capacity for which a greedy walk needs no more than the wanted shards is found by binary
search; each step of a walk asks for the last group that ends at or before some byte. Those ends stay in a
table: the driver holds a histogram of fixed size, answers most steps by its bounds, and reads the ends of
single buckets where the bounds do not decide.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_to_groups, partitions_for, stored

#: Buckets of the driver's histogram, and the most ends it reads of one bucket before it divides that again.
BUCKETS, BUCKET_ENDS = 16_384, 50_000
#: Bytes that each row adds to its text.
ROW_BYTES = 8


class Ends:
    """Where groups end, as increasing numbers in a table's column end; low < end <= high."""

    def __init__(self, table: DataFrame, low: int, high: int):
        self.low, self.high = low, high
        self.step = max(1, -(-(high - low) // BUCKETS))
        self.table = table
        self.slot = F.expr(f"(end - {low + 1}) div {self.step}")
        found = table.groupBy(self.slot.alias("slot")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        found.sort()
        self.slots = [r["slot"] for r in found]
        self.mins, self.maxs, self.counts = ([r[k] for r in found] for k in ("a", "b", "n"))
        self.read: dict[int, list[int] | Ends] = {}

    def _at(self, value: int) -> int:
        """Number of the last bucket that begins at or before a value, -1 if none."""
        return bisect.bisect_right(self.mins, value) - 1

    def bounds(self, value: int) -> tuple[int, int]:
        """Between which ends the last end at or before a value lies."""
        i = self._at(value)
        if i < 0:
            return self.low, self.low
        return (self.maxs[i], self.maxs[i]) if self.maxs[i] <= value else (self.mins[i], value)

    def fetch(self, buckets: set[int]) -> None:
        """Reads the ends of several small buckets at once."""
        wanted = [i for i in sorted(buckets) if i not in self.read and self.counts[i] <= BUCKET_ENDS]
        total = 0
        while wanted:
            part = []
            while wanted and (not part or total + self.counts[wanted[0]] <= 4 * BUCKET_ENDS):
                total += self.counts[wanted[0]]
                part.append(wanted.pop(0))
            total = 0
            inside = F.col("end").between(self.mins[part[0]], self.maxs[part[-1]]) & self.slot.isin([self.slots[i] for i in part])
            ends = sorted(r[0] for r in self.table.filter(inside).select("end").collect())
            for i in part:
                self.read[i] = ends[bisect.bisect_left(ends, self.mins[i]) : bisect.bisect_right(ends, self.maxs[i])]

    def _inside(self, i: int) -> list[int] | Ends:
        """The ends of a bucket."""
        if i not in self.read:
            if self.counts[i] <= BUCKET_ENDS:
                self.fetch({i})
            else:
                self.read[i] = Ends(self.table.filter(f"end BETWEEN {self.mins[i]} AND {self.maxs[i]}"), self.mins[i] - 1, self.maxs[i])
        return self.read[i]

    def floor(self, value: int) -> int:
        """The last end at or before a value; the low bound if none."""
        a, b = self.bounds(value)
        if a == b:
            return a
        ends = self._inside(self._at(value))
        return ends.floor(value) if isinstance(ends, Ends) else ends[bisect.bisect_right(ends, value) - 1]

    def after(self, value: int) -> int:
        """The first end after a value; the high bound if none."""
        i = self._at(value)
        if i >= 0 and self.maxs[i] > value:
            ends = self._inside(i)
            return ends.after(value) if isinstance(ends, Ends) else ends[bisect.bisect_right(ends, value)]
        return self.mins[i + 1] if i + 1 < len(self.mins) else self.high


def _needed(start: int, capacity: int, total: int, step, most: int) -> int:
    """Shards of a capacity that a greedy walk from a byte needs; most + 1 if more than most or impossible."""
    used = 0
    while start < total:
        end = step(start + capacity)
        if end <= start or used == most:
            return most + 1
        start, used = end, used + 1
    return used


def smallest_capacity(ends: Ends, total: int, largest: int, shards: int) -> int:
    """The least capacity for which shards of consecutive groups hold everything."""
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    least, most = lambda v: ends.bounds(v)[0], lambda v: ends.bounds(v)[1]
    while low < high:
        middle = (low + high) // 2
        if _needed(0, middle, total, least, shards) <= shards:
            high = middle
        elif _needed(0, middle, total, most, shards) > shards:
            low = middle + 1
        else:
            walk, start = set(), [0, 0]
            for _ in range(shards):  # the buckets that this and later walks pass
                start = [ends.bounds(start[0] + low)[0], ends.bounds(start[1] + high)[1]]
                i, j = ends._at(start[0]), ends._at(start[1])
                if sum(ends.counts[max(i, 0) : j + 1]) <= BUCKET_ENDS:
                    walk.update(range(max(i, 0), j + 1))
            ends.fetch(walk)
            if _needed(0, middle, total, ends.floor, shards) <= shards:
                high = middle
            else:
                low = middle + 1
    return low


def cut_points(ends: Ends, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the last byte of each shard but the last. Within the capacity, each shard ends
    as near as can be to an even share of what is left, if the rest then fits the shards left; else where the capacity
    does."""
    capacity = smallest_capacity(ends, total, largest, shards)
    cuts, start = [], 0

    def rest_fits(end: int, left: int) -> bool:
        if _needed(end, capacity, total, lambda v: ends.bounds(v)[0], left) <= left:
            return True
        return _needed(end, capacity, total, lambda v: ends.bounds(v)[1], left) <= left and _needed(end, capacity, total, ends.floor, left) <= left

    for left in range(shards, 1, -1):
        target = start + -(-(total - start) // left)
        below, above = ends.floor(target), ends.after(target)
        end = above if above - target < target - below or below <= start else below
        fits = start < end <= start + capacity and rest_fits(end, left - 1)
        start = end if fits else ends.floor(start + capacity)
        cuts.append(start)
    return capacity, cuts


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (gapless from 0).

    A null text has no bytes and belongs to the group of empty texts. Groups with the same smallest key are told
    apart by their digests; null keys come first; repeated rows follow each other in any order. An empty table
    gives no rows. With fewer groups than shards some shards stay empty. Rows are dealt by ranges of (group,
    key), so a group with a third of all rows spreads over many tasks; what reaches the driver is a histogram of
    BUCKETS rows, single buckets of at most BUCKET_ENDS ends, and a sum for each partition."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(key).alias("row_key"),
            (F.octet_length(value) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(value.cast("binary"), 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("digest").agg(F.min("row_key").alias("first_key"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    order = ["first_key", "digest", "row_key"]
    total = rows.count()
    partitions = partitions_for(spark, total)
    ranged = stored(joined_to_groups(rows, groups, "digest", "rows", total).drop("rows").repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    sums = sorted(ranged.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())  # a row for each partition
    bases, size, count = [], 0, 0
    for part, part_size, part_rows in sums:
        bases.append((part, size, count))
        size, count = size + part_size, count + part_rows
    base = F.broadcast(spark.createDataFrame(bases, "part int, base_size long, base_rows long"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select("*", F.sum("size").over(inside).alias("s"), F.count(F.lit(1)).over(inside).alias("r")).join(base, "part")
    placed = placed.select("row_key", "size", "text_crc32", "first_key", "digest", (F.col("base_size") + F.col("s")).alias("end"), (F.col("base_rows") + F.col("r") - 1).alias("place"))
    placed = stored(placed, "shard-places")
    ends = placed.groupBy("first_key", "digest").agg(F.max("end").alias("end"), F.sum("size").alias("bytes"))
    ends = stored(ends.select("end", "bytes"), "shard-ends")
    largest = ends.agg(F.max("bytes")).first()[0]
    cuts = cut_points(Ends(ends.select("end"), 0, size), size, largest, shards)[1] if size else []
    number = sum(((F.col("end") > F.lit(cut)).cast("int") for cut in cuts), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", number)
    firsts, before = [0] * shards, 0
    for n, held in sorted(placed.groupBy("shard").count().collect()):
        firsts[n], before = before, before + held
    slot = F.col("place") - F.element_at(F.array(*(F.lit(x).cast("long") for x in firsts)), F.col("shard") + 1)
    return placed.select(F.col("row_key").alias(key), "size", "text_crc32", "shard", slot.alias("slot"))
