"""Flat binary files in a shared store, written and read inside tasks."""

from __future__ import annotations

import re

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, for a plain path or one with a scheme."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Writer:
    """A file of this attempt of a task: ``folder/prefix-partition-attempt.suffix``.

    The attempt is part of the name, so a repeated or doubled task never writes into
    another's file. Rows name the file they belong to; files of failed attempts are
    named by no row.
    """

    def __init__(self, folder: str, prefix: str, suffix: str):
        context = TaskContext.get()
        number = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        self.name = f"{prefix}-{number}.{suffix}"
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        self.stream = store.open_output_stream(f"{path}/{self.name}")

    def write(self, values: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(values).data)

    def close(self) -> None:
        self.stream.close()


def read(path: str, offset: int, size: int) -> bytes:
    """Bytes of a part of a file."""
    store, inner = opened(path)
    with store.open_input_file(inner) as source:
        return source.read_at(size, offset)


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder with their sizes: path, length. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length")
