"""Keys for several writers at once.

A writer reserves a run of keys by a file that only one writer can create. Reservations are numbered; each starts where
the one before ends, so no two writers ever share a key. A writer that fails after its reservation leaves a gap, as a
database's counter does; the same write tried again takes the reservation that it had.

Needs a file system whose create or rename fails if the name is taken, as HDFS has; on stores without that, one writer
at a time must reserve.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.operators.ordering import global_positions


class KeyBlocks:
    """Reservations below ``directory``; keys start at ``base``."""

    def __init__(self, spark: SparkSession, directory: str, base: int = 1):
        self.spark, self.directory, self.base = spark, directory, base

    def reserve(self, write: str, number: int) -> int:
        """The first of ``number`` keys in a row for the write of that name."""
        held = self._read(f"write-{write}")
        if held is not None:
            start, size = held
            if size < number:
                raise ValueError(f"write {write} has reserved {size} keys before, not {number}")
            return start
        # From the last reservation known on, so that not all are looked through.
        at, start = self._read("last") or (0, self.base)
        while True:
            taken = self._read(f"reservation-{at}")
            if taken is not None:
                at, start = at + 1, taken[0] + taken[1]
            elif self._create(f"reservation-{at}", start, number):
                break
        self._create(f"write-{write}", start, number)
        self._create("last", at, start, replace=True)
        return start

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> tuple[int, int] | None:
        path, system = self._path(name)
        if not system.exists(path):
            return None
        file = system.open(path)
        out = file.readLong(), file.readLong()
        file.close()
        return out

    def _create(self, name: str, first: int, second: int, replace: bool = False) -> bool:
        """Write two numbers under a new name at once; False if the name is taken."""
        jvm = self.spark._jvm
        part, system = self._path(f".{name}-{uuid.uuid4().hex}")
        file = system.create(part, True)
        file.writeLong(first)
        file.writeLong(second)
        file.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()) \
            if part.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        try:
            context.rename(part, self._path(name)[0], options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            system.delete(part, False)
            return False
        return True


def append_with_reserved_ids(blocks: KeyBlocks, write: str, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with reserved keys, given in ``order``, which must be unique.

    ``write`` names this append; tried again under the same name it gives the same keys, whoever appends meanwhile.
    """
    numbered = global_positions(rows, order, "_position")
    number = numbered.agg(F.max("_position")).first()[0] or 0
    start = blocks.reserve(write, number)
    return numbered.withColumn(key, F.lit(start - 1).cast("bigint") + F.col("_position")).drop("_position")
