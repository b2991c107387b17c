"""Keyed state of a stream as files: hash buckets, levelled segments, the newest row of a key counts.

Each batch writes its changed keys as a segment of one batch. Whenever ``fan`` segments of a size are complete, the
batch that completes them merges them to one of the next size, so the segments that hold all batches before the n-th are
the digits of n: a few of each size, however long the stream runs. Which ones these are follows from n alone, so a
reader lists nothing and a batch that runs again writes the same segments. Merged segments are dropped by
the batch after, when the batch that merged them can't run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS, FAN = 64, 10
# The state a stream starts from.
_START = (-1, 1)


def segments(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """``(first batch, number of batches)`` of the segments that hold batches 0 to n - 1, oldest first."""
    size = 1
    while size * fan <= n:
        size *= fan
    out, first = [], 0
    while size:
        while first + size <= n:
            out.append((first, size))
            first += size
        size //= fan
    return out


def completed(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The segments that the first n batches complete, the smallest first."""
    out, size = [], fan
    while n and n % size == 0:
        out.append((n - size, size))
        size *= fan
    return out


class KeyedStore:
    """Rows by ``key`` below ``directory``; all columns of ``schema`` that are no key are replaced together.

    ``by`` is the part of the key that rows are looked up by, the whole key if not given.
    """

    def __init__(
        self, spark: SparkSession, directory: str, schema: T.StructType, key: list[str], buckets: int = BUCKETS, fan: int = FAN,
        by: list[str] | None = None,
    ):
        self.spark, self.directory, self.key, self.buckets, self.fan = spark, directory, key, buckets, fan
        self.by = by or key
        self.columns = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField("_batch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int").alias("bucket")

    def path(self, first: int, size: int) -> str:
        return f"{self.directory}/first={first}/size={size}"

    def start(self, rows: DataFrame) -> None:
        """Write the state before the first batch, once."""
        if not self._exists(f"{self.path(*_START)}/_SUCCESS"):
            self._write(rows.select(*self.columns, F.lit(-1).cast("bigint").alias("_batch"), self.bucket()), *_START)

    def before(self, batch: int, keys: DataFrame | None = None) -> DataFrame:
        """The rows as the batches before ``batch`` left them; of ``keys`` only, reading only their buckets."""
        read = self._read(segments(batch, self.fan), self._exists(self.path(*_START)))
        if keys is not None:
            keys = keys.select(*self.by).distinct()
            # At most as many numbers as there are buckets.
            used = [r.bucket for r in keys.select(self.bucket()).distinct().collect()]
            read = read.filter(F.col("bucket").isin(used)).join(keys, self.by, "left_semi")
        return self._newest(read).select(*self.columns)

    def latest(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows as all batches left them that have been put."""
        return self.before(self._batches(), keys)

    def put(self, batch: int, rows: DataFrame) -> None:
        """Replace the rows of some keys, one row per key; the same batch again replaces what it wrote."""
        self._write(rows.select(*self.columns, F.lit(batch).cast("bigint").alias("_batch"), self.bucket()), batch, 1)
        for first, size in completed(batch + 1, self.fan):
            self._write(self._newest(self._read(self._parts(first, size), False)), first, size)
        for first, size in completed(batch, self.fan):
            for part in self._parts(first, size):
                self._delete(self.path(*part))
        self._note(batch + 1)

    def unseen(self, batch: int, rows: DataFrame) -> DataFrame:
        """The rows whose key no batch before has put; of rows with one key in ``rows``, the least."""
        others = [c for c in rows.columns if c not in self.key]
        first = rows.groupBy(*self.key).agg(F.min(F.struct(*others)).alias("_row")).select(*self.key, "_row.*").select(rows.columns)
        return first.join(self.before(batch, rows), self.key, "left_anti").select(rows.columns)

    def _parts(self, first: int, size: int) -> list[tuple[int, int]]:
        step = size // self.fan
        return [(first + k * step, step) for k in range(self.fan)]

    def _read(self, parts: list[tuple[int, int]], from_start: bool) -> DataFrame:
        paths = [self.path(*p) for p in ([_START] if from_start else []) + parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.directory).parquet(*paths).select(self.schema.names)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.schema.names if c not in (*self.key, "bucket")]
        newest = rows.groupBy("bucket", *self.key).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        return newest.select(*self.key, "_row.*", "bucket").select(self.schema.names)

    def _write(self, rows: DataFrame, first: int, size: int) -> None:
        # A bucket is one task's, so it is one file.
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("bucket").parquet(self.path(first, size)))

    def _file(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        path, system = self._file(path)
        return system.exists(path)

    def _delete(self, path: str) -> None:
        path, system = self._file(path)
        system.delete(path, True)

    def _note(self, batches: int) -> None:
        path, system = self._file(f"{self.directory}/_batches")
        out = system.create(path, True)
        out.writeLong(batches)
        out.close()

    def _batches(self) -> int:
        path, system = self._file(f"{self.directory}/_batches")
        if not system.exists(path):
            return 0
        read = system.open(path)
        batches = read.readLong()
        read.close()
        return batches
