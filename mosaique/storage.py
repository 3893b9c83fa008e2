"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a session of one machine (tests) has a temporary
    one; on a cluster each machine would write to its own, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.environ.get("MOSAIQUE_TEST_SHARED")
    if not own:
        own = os.environ["MOSAIQUE_TEST_SHARED"] = tempfile.mkdtemp(prefix="mosaique-")
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, for what DataFrames do not do: tests for files, deleting, renaming."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, fs = hadoop(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop(spark, path)
    return fs.exists(at)


def rename(spark: SparkSession, old: str, new: str) -> None:
    at, fs = hadoop(spark, old)
    if not fs.rename(at, hadoop(spark, new)[0]):
        raise OSError(f"cannot rename {old}")


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at exit
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    atexit.register(_remove_late, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    if path := getattr(df, "stored_path", None):
        remove(df.sparkSession, path)
