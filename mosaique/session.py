"""Sessions with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC times, adaptive plans, and base64 without line breaks.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "mosaique", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cores: int | None = None, **settings: str) -> SparkSession:
    """A session for one machine, with a shuffle partition for each core."""
    cores = cores or os.cpu_count() or 4
    own = {"spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    return build(master=f"local[{cores}]", **(own | settings))


#: Rows of a range of an order that one task sorts, about.
ROWS_OF_RANGE = 2_000_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Ranges into which so many rows are dealt: as many as the session's shuffles have, more for very many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_RANGE))
