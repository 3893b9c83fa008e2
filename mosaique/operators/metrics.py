"""Throughput, latencies and rolling speed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def indexed_percentile(values: Column, percent: int) -> Column:
    """The element at floor(n * percent / 100) of the sorted values: a value that occurred, nothing in between."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, F.least(F.floor(F.size(ordered) * percent / 100) + 1, F.size(ordered)).cast("int"))


def latency(rows: DataFrame, group: str, value: str, percent: int = 95) -> DataFrame:
    """Per group: average, least, number of values and indexed percentile; groups without values are left out.

    Values are numbered in one order over all groups, dealt by ranges, so a group with most of the rows spreads
    over tasks; the percentile is the value at a place counted from the group's first."""
    there = rows.filter(F.col(value).isNotNull()).select(group, value)
    plain = there.groupBy(group).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.count(value).alias("n"))
    placed = numbered(there, F.col(group).asc_nulls_first(), value, name="_place")
    starts = placed.groupBy(group).agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_n"))
    wanted = starts.select((F.col("_start") + F.least(F.floor(F.col("_n") * percent / 100), F.col("_n") - 1)).alias("_place"))
    at = placed.join(wanted, "_place").select(F.col(group).alias("_g"), F.col(value).alias(f"p{percent}"))
    return plain.join(at, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def warm_average(rows: DataFrame, group: str, value: str, *order: str) -> DataFrame:
    """Per group the average without the first row in order, the warm-up; null if it has one row only."""
    first = F.min(F.struct(*order, F.col(value).alias("_v")))
    sums = rows.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"), first.alias("_f"))
    rest = F.col("_c") - F.when(F.col("_f._v").isNull(), 0).otherwise(1)
    total = F.col("_s") - F.coalesce(F.col("_f._v"), F.lit(0.0))
    return sums.select(group, F.when(rest > 0, total / rest).alias("warm_avg"))


def throughput(items: Column, seconds: Column) -> Column:
    return items / F.greatest(seconds, F.lit(1e-9))


def rolling_speeds(rows: DataFrame, group: str, t: str, processed: str, *ties: str) -> DataFrame:
    """Per group the last smoothed rate of its samples in order, as of rolling_speed. Rows are sorted within tasks and
    run through once, so a group of any size holds one state in memory."""
    kind = rows.schema[group].dataType.simpleString()
    slim = rows.select(F.col(group), F.col(t).cast("double"), F.col(processed).cast("double"), *ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = lambda name, speed: pa.RecordBatch.from_arrays([pa.array([name], schema.field(0).type), pa.array([speed.rate])], ["name", "rate"])
        speed, name, schema = None, None, None
        for batch in batches:
            schema = batch.schema
            for g, at, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if speed is None or g != name:
                    if speed is not None:
                        yield ended(name, speed)
                    speed, name = Speed(), g
                speed.sample(at, n)
        if speed is not None:
            yield ended(name, speed)

    dealt = slim.repartition(group).sortWithinPartitions(group, t, *ties)
    return dealt.mapInArrow(run, f"name {kind}, rate double").withColumnRenamed("name", group)


class Speed:
    """A rate that follows new samples by 0.4; samples without progress or within a millisecond leave it."""

    def __init__(self) -> None:
        self.rate, self._t, self._n = 0.0, None, 0

    def sample(self, t: float, processed: float) -> float:
        if self._t is None:
            self._t, self._n = t, processed
        elif processed > self._n and t - self._t > 1e-3:
            now = (processed - self._n) / (t - self._t)
            self.rate = 0.6 * self.rate + 0.4 * now if self.rate > 0 else now
            self._t, self._n = t, processed
        return self.rate


def rolling_speed(samples: Column) -> Column:
    """The last smoothed rate over an array of (t, processed), oldest first: 0.6 of the old rate and 0.4 of the
    new, the first rate as it is. Samples without progress, or within a millisecond, leave the state as it is."""
    zero = F.struct(F.lit(0.0).alias("rate"), F.element_at(samples, 1)["t"].alias("t"), F.element_at(samples, 1)["processed"].alias("processed"))

    def step(state: Column, sample: Column) -> Column:
        dt = sample["t"] - state["t"]
        now = (sample["processed"] - state["processed"]) / dt
        rate = F.when(state["rate"] > 0, 0.6 * state["rate"] + 0.4 * now).otherwise(now)
        moved = F.struct(rate.alias("rate"), sample["t"].alias("t"), sample["processed"].alias("processed"))
        return F.when((sample["processed"] > state["processed"]) & (dt > 0.001), moved).otherwise(state)

    return F.when(F.size(samples) > 0, F.aggregate(samples, zero, step)["rate"])
