"""Instances stored by end date, and exercise dates by day, for the nightly sweeps.

A night touches the instances that end today or a week ago and those with an exercise date today or yesterday. In
this layout it reads those days' folders only; instances with exercise dates are found by their end dates, which
prune folders while the query runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bankspark.operators import lifecycle
from bankspark.sources.tables import Tables


# Folder of instances without an end date, so that every instance is found by an equality.
NO_END = dt.date(9999, 12, 31)


def _end_day() -> Column:
    return F.coalesce("product_end_date", F.lit(NO_END)).alias("end_day")


def store_dated(db: Tables, directory: str) -> None:
    """Write ``instances`` by ``end_day`` and ``exercise`` by ``day``; a rerun replaces them.

    Sorted by day first, so that a day's rows are in few files.
    """
    instances = db.product_instances.withColumn("end_day", _end_day())
    instances.repartitionByRange("end_day", "product_uid").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "end_day").parquet(f"{directory}/instances")
    defs = db.product_custom_column_def.filter(F.col("exercise_date_yn") == "Y").select("pcc_id")
    dated = db.product_custom_column_values.filter(F.col("date_value").isNotNull()).select(
        "product_uid", "pcc_id", "date_value").join(defs, "pcc_id", "left_semi")
    ends = db.product_instances.select("product_uid", _end_day())
    columns = ["product_uid", "pcc_id", "date_value", "end_day"]
    exercise = dated.join(ends, "product_uid").select(*columns, F.col("date_value").alias("day"))
    exercise.repartitionByRange("day", "product_uid").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "day").parquet(f"{directory}/exercise")


def _read(db: Tables, directory: str, name: str) -> DataFrame:
    if name == "instances":
        schema = T.StructType([*db.product_instances.schema.fields, T.StructField("end_day", T.DateType())])
    else:
        schema = "product_uid BIGINT, pcc_id BIGINT, date_value DATE, end_day DATE, day DATE"
    return db.spark.read.schema(schema).parquet(f"{directory}/{name}")


def touched(db: Tables, directory: str, as_of: dt.date, catch_up: bool = False) -> Tables:
    """``db`` with only the instances that the night of ``as_of`` may move, and their exercise dates."""
    week_before, yesterday = as_of - dt.timedelta(days=lifecycle.OVERDUE_DAYS), as_of - dt.timedelta(days=1)
    instances, exercise = _read(db, directory, "instances"), _read(db, directory, "exercise")
    day = F.col("end_day")
    due = instances.filter(day <= F.lit(as_of) if catch_up else day.isin(as_of, week_before))
    dates = exercise.filter(F.col("day").isin(as_of, yesterday))
    # One row for each end date, whose folders alone are read: Spark prunes them only by a side that it broadcasts from the start.
    days = F.broadcast(dates.select("end_day").distinct())
    exercised = instances.join(days, "end_day", "left_semi").join(
        dates.select("end_day", "product_uid"), ["end_day", "product_uid"], "left_semi").select(instances.columns)
    rows = due.unionByName(exercised).drop("end_day").dropDuplicates(["product_uid"])
    return db.replace(
        product_instances=rows.select(*[c for c in db.product_instances.columns]),
        product_custom_column_values=dates.select("product_uid", "pcc_id", "date_value"),
    )


def nightly_dated(db: Tables, directory: str, as_of: dt.date, catch_up: bool = False) -> lifecycle.Nightly:
    """``lifecycle.nightly`` on the stored layout: the audit rows, and the instances the night moved."""
    night = lifecycle.nightly(touched(db, directory, as_of, catch_up), as_of, catch_up)
    moved = night.audit.select("product_uid").distinct()
    return lifecycle.Nightly(night.instances.join(moved, "product_uid", "left_semi"), night.audit)
