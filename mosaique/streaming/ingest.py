"""Micro-batches of new images into the cache, and their progress.

A file stream brings each file once; foreachBatch embeds a batch and upserts it, so a batch that is tried again
after a failure leaves the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import Settings
from ..functions import files
from ..operators import embed
from ..operators.cache import FeatureCache
from ..operators.metrics import Speed

#: Fixed value: the columns that Spark's binaryFile source has.
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class Progress:
    """One event; the schema of PROGRESS_SCHEMA."""

    total: int
    processed: int
    cache_hits: int
    cache_misses: int
    images_per_second: float
    elapsed_secs: float
    message: str


PROGRESS_SCHEMA = "total long, processed long, cache_hits long, cache_misses long, images_per_second double, elapsed_secs double, message string"


def ingest(
    spark: SparkSession,
    folder: str,
    cache: FeatureCache,
    checkpoint: str,
    make: Callable = embed.HistogramBackend,
    settings: Settings = Settings(),  # noqa: B008 - frozen
    files_per_batch: int = 256,
    progress: Callable[[Progress], None] = lambda _: None,
) -> StreamingQuery:
    """Starts a query that embeds all images now in a folder, files_per_batch at a time, and then ends."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    images = stream.filter(files.is_image(F.col("path"))).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        files.file_name(F.col("path")).alias("file_name"),
        F.col("length").alias("file_size"),
        files.filetime(F.col("modificationTime")).alias("last_modified"),
        "content",
    )
    began, speed, done = time.time(), Speed(), [0]

    def write(batch: DataFrame, _: int) -> None:
        made = embed.embed(batch, make, settings).persist()
        good = made.filter("features IS NOT NULL")
        n = made.count()
        if n:
            cache.store(good, settings.model_id, settings.tier)
        made.unpersist()
        done[0] += n
        now = time.time() - began
        progress(Progress(done[0], done[0], 0, done[0], speed.sample(now, done[0]), now, f"Extracting features: {done[0]} images"))

    return images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressListener(StreamingQueryListener):
    """Hands each micro-batch's rows and rate to a function."""

    def __init__(self, tell: Callable[[Progress], None]):
        self.tell, self.total, self.began = tell, 0, time.time()

    def onQueryStarted(self, event) -> None:
        self.began = time.time()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.total += p.numInputRows
        self.tell(Progress(self.total, self.total, 0, self.total, p.processedRowsPerSecond or 0.0, time.time() - self.began, p.name or ""))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
