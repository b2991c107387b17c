"""Tables and files in the shared folder that all executors reach."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from bankspark.session import shared_dir

_scratch: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_scratch() -> None:
    for spark, folder in _scratch:
        try:
            delete(spark, folder)
        except Exception:  # the session has ended before; its folder is then left to the cluster's own clearing
            return


atexit.register(_clear_scratch)


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder below ``spark.checkpoint.dir``; deleted when the driver ends, unless ``keep``."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _scratch.append((spark, folder))
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a table below ``folder`` and read it back: later steps start from the written rows."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as on one machine or a shared folder.

    On a cluster without that, the package is given with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder in the shared store, for tasks that write or read their own file format."""
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file that a task writes under a name of its own.

    A task that is run again writes another file; the rows that Spark keeps of the task name the file that
    counts, so files left by lost tasks are never read.
    """

    def __init__(self, folder: str, prefix: str, suffix: str):
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
        self._out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def open_file(folder: str, name: str):
    system, path = opened(folder)
    return system.open_input_file(f"{path}/{name}")
