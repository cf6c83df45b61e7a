"""Staged tables: written below the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a driver that is its own executor and names no shared folder, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints/strataq"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir. Where it is unset, a folder of
    this machine under a local master, and ValueError on a cluster, whose machines would each write to a disk of their own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_SWEPT: set[str] = set()


def _sweep(spark: SparkSession, folder: str) -> None:
    try:
        _remove(spark, folder)
    except Exception:  # the session has ended before the interpreter: nothing can be asked of it any more
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it, which goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/strataq/{spark.sparkContext.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: With it, the shuffle files of a query go when the query ends; otherwise they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, and what follows survives lost executors.
    Once it is written, nothing needs its shuffle files, so they are removed."""
    path = new_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes what staged() wrote for df; nothing that reads it may follow."""
    if path := getattr(df, "_staged_at", None):
        _remove(df.sparkSession, path)
