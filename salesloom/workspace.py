"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_remembered: dict[tuple, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A configured folder is taken as it is: a path without a remote scheme may be
    a mounted share, which only the caller can know. Without a configured folder
    only a master that runs all tasks in the driver's own process (``local`` or
    ``local[n]``) gets a temporary one; any other master is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="salesloom-")
    return _local_dirs[app]


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared folder."""
    return f"{shared_dir(spark)}/salesloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of this application, unique to this call."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so values that differ between two evaluations (partition
    ids, sums of doubles) are fixed, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended.

    They go when the driver collects its plans, which a roomy heap puts off while the
    disks fill. Call it after writing a table that took shuffles of whole tables.
    """
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems, whatever store holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of everything in a folder, as its store knows them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for entry in store.listStatus(target):
        size = store.getContentSummary(entry.getPath()).getLength()
        found.append((entry.getPath().getName(), size, entry.getModificationTime()))
    return tuple(sorted(found))


def remembered(spark: SparkSession, key: tuple, make: Callable[[], Any]) -> Any:
    """The result of ``make``, made once per application and key until ``drop_staged``.

    A key that names data should hold their ``file_state``.
    """
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _remembered:
        _remembered[whole] = make()
    return _remembered[whole]


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application staged. Call it when results are written.

    What ``remembered`` holds goes, too, because it reads staged tables.
    """
    app = spark.sparkContext.applicationId
    for key in [k for k in _remembered if k[0] == app]:
        del _remembered[key]
    delete_path(spark, run_dir(spark))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
