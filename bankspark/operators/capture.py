"""Change capture between stored snapshots by digests of buckets.

A snapshot is written in hash buckets of its key, with a digest of each bucket that does not depend on the order of rows.
Two snapshots are then compared by their digests first, and rows are read and joined only in the buckets that differ.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.operators.lifecycle import audit_rows
from bankspark.sources.tables import write_snapshot

BUCKETS = 256
# What the audit log is made from.
AUDITED = ["product_uid", "status_code", "latest_update_user_id", "latest_note", "latest_note_public_yn"]


def write_hashed(df: DataFrame, directory: str, version: int, key: str = "product_uid", buckets: int = BUCKETS) -> None:
    """Write one version of a table in buckets of ``key``, and its digests; a rerun replaces it."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket")
    path = write_snapshot(rows, f"{directory}/rows", version, partition_by=["bucket"])
    # Of the rows as they are stored. NULL and the place of a value count: xxhash64 skips NULLs.
    columns = [F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")) for c in df.columns]
    hashed = df.sparkSession.read.schema(rows.schema).parquet(path).select("bucket", F.xxhash64(*columns).alias("hash"))
    digests = hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("hash").alias("mixed"), F.sum(F.col("hash").cast("decimal(38,0)")).alias("total"))
    write_snapshot(digests.withColumn("buckets", F.lit(buckets)), f"{directory}/digests", version)


def _digests(spark: SparkSession, directory: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{directory}/digests/version={version}")


def differing_buckets(spark: SparkSession, directory: str, old: int, new: int) -> list[int]:
    """Buckets whose rows differ between two versions; at most as many numbers as there are buckets."""
    was, now = _digests(spark, directory, old), _digests(spark, directory, new)
    sizes = was.unionByName(now).agg(F.min("buckets"), F.max("buckets")).first()
    if sizes[0] != sizes[1]:
        raise ValueError("the versions have different numbers of buckets")
    digest = lambda name: F.struct("n", "mixed", "total").alias(name)
    both = was.select("bucket", digest("was")).join(now.select("bucket", digest("now")), "bucket", "full")
    return sorted(r.bucket for r in both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("bucket").collect())


def read_buckets(spark: SparkSession, directory: str, version: int, buckets: list[int]) -> DataFrame:
    """The rows of some buckets; the others' files are not even listed."""
    path = f"{directory}/rows/version={version}"
    there = _digests(spark, directory, version).filter(F.col("bucket").isin(buckets)).select("bucket").collect()
    if not there:
        return spark.read.parquet(path).drop("bucket").limit(0)
    return spark.read.option("basePath", path).parquet(*[f"{path}/bucket={r.bucket}" for r in there]).drop("bucket")


def audit_rows_between(
    spark: SparkSession, directory: str, old: int, new: int, as_of: dt.datetime, null_safe_notes: bool = False
) -> DataFrame:
    """``lifecycle.audit_rows`` of two stored versions, from the buckets that differ."""
    buckets = differing_buckets(spark, directory, old, new)
    was, now = (read_buckets(spark, directory, v, buckets) for v in (old, new))
    return audit_rows(was, now, as_of, null_safe_notes)
