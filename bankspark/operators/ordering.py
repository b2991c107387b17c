"""Positions, keys and pages over ordered rows, without one task ever holding a whole group.

A ``row_number`` window puts a whole partition of rows through one task. That is fine while every
group is small, so groups are counted first; a group above the limit is numbered by a range
partitioning on (group, order) instead, which splits it over tasks. Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bankspark.session import checkpointed

# Largest group that one task sorts. The other way is exact as well, so this is no cap.
GROUP_LIMIT = 1_000_000

_LOCAL_INDEX = (1 << 33) - 1


def has_large_group(df: DataFrame, keys: list[str], limit: int) -> bool:
    """True if some group has more than ``limit`` rows. Counts combine before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > limit).isEmpty()


def _range_split(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows split and sorted by ``order``, with the number of their partition and their place in it.

    Checkpointed, so that all that is computed from it sees the same split even if executors are
    lost in between.
    """
    return checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_INDEX)))
    )


def global_positions(df: DataFrame, order: list[str], position: str = "position") -> DataFrame:
    """Number all rows 1, 2, 3 … by ``order``, which must be unique.

    Rows are range-partitioned and sorted inside partitions; a row's number is its place in its
    partition plus the sizes of the partitions before.
    """
    split = _range_split(df, order)
    # One row per partition, so this window and the broadcast below are bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        split.join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_offset") + F.col("_place") + 1)
        .drop("_part", "_place", "_offset")
    )


def positions_within(
    df: DataFrame, keys: list[str], order: list[str], position: str = "position", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Number the rows of each group 1, 2, 3 … by ``order``, which must be unique in the group."""
    if not has_large_group(df, keys, limit):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(position, F.row_number().over(window).cast("bigint"))
    # Number the rows of a group inside each partition, then add the sizes of its parts before.
    split = _range_split(df, keys + order)
    inside = Window.partitionBy("_part", *keys).orderBy("_place")
    numbered = split.withColumn("_inside", F.row_number().over(inside))
    parts = split.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_of_part"), *[F.col(k).alias("_of_" + k) for k in keys],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    same_part = [F.col("_part") == F.col("_of_part")] + [F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys]
    return numbered.join(offsets, same_part).select(
        *df.columns, (F.col("_offset") + F.col("_inside")).alias(position)
    )


def append_with_ids(
    target: DataFrame | None,
    rows: DataFrame,
    key: str,
    order: list[str],
    base: int = 1,
) -> DataFrame:
    """New rows with the next free keys, given in ``order``.

    Keys go on after the highest key of ``target`` and never start below ``base``. The result holds
    the new rows only; the caller appends them.
    """
    numbered = global_positions(rows, order, "_position")
    return numbered.withColumn(key, _last_key(target, key, base) + F.col("_position")).drop("_position")


def _last_key(target: DataFrame | None, key: str, base: int) -> Column:
    start = F.lit(base - 1).cast("bigint")
    if target is None:
        return start
    highest = target.agg(F.max(key).alias("highest")).scalar()
    return F.greatest(F.coalesce(highest, start), start)


def paged(
    df: DataFrame, keys: list[str], order: list[str], page_size: int | None
) -> tuple[DataFrame, list[str]]:
    """Split the groups of ``df`` into pages of at most ``page_size`` rows in ``order``.

    Gives the rows with a ``page_no`` and the grouping columns to collect by. Without a page
    size, or while no group is larger than a page, every row gets page 0 and nothing is shuffled.
    """
    if page_size is None or not has_large_group(df, keys, page_size):
        return df.withColumn("page_no", F.lit(0).cast("bigint")), keys + ["page_no"]
    numbered = positions_within(df, keys, order, "_position", limit=page_size)
    page = F.floor((F.col("_position") - 1) / page_size).cast("bigint")
    return numbered.withColumn("page_no", page).drop("_position"), keys + ["page_no"]
