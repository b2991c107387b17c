"""Custom attributes of products: definitions as rows, values in one typed column each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from bankspark.functions import columns as C
from bankspark.operators.ordering import append_with_ids
from bankspark.sources.tables import Tables

VALUE_COLUMNS = ["int_value", "float_value", "varchar_value", "text_value", "date_value", "datetime_value"]


def attribute_rows(db: Tables, visible_only: bool = False) -> DataFrame:
    """Attribute values with their definitions."""
    defs = db.product_custom_column_def.select(
        "pcc_id", "column_name", "customer_populatable_yn", "customer_visible_yn", "column_type", "exercise_date_yn"
    )
    if visible_only:
        defs = defs.filter(F.col("customer_visible_yn") == "Y")
    return db.product_custom_column_values.join(defs, "pcc_id")


def attribute_values(db: Tables, visible_only: bool = True) -> DataFrame:
    """Attribute values as text, picked by type; dates are written out, unknown types give NULL."""
    return attribute_rows(db, visible_only).select(
        "product_uid", "pcc_uid", "column_name", "column_type", C.attribute_text(F.col("column_type")).alias("value")
    )


def attributes_wide(db: Tables, names: list[str]) -> DataFrame:
    """One row per instance with the named attributes as text columns.

    The names are given, so the pivot needs no pass over the data to find them.
    """
    return (
        attribute_values(db, visible_only=False).filter(F.col("column_name").isin(names))
        .groupBy("product_uid").pivot("column_name", names).agg(F.first("value", ignorenulls=True))
    )


def init_attributes(db: Tables, new_instances: DataFrame) -> DataFrame:
    """First attribute values of ``new_instances(product_uid, application_id)``.

    One row per final definition of the product, its default cast into the column of its type.
    """
    defs = db.product_custom_column_def.select("pcc_id", "product_id", "column_type", "default_value")
    typed = C.typed_defaults(F.col("column_type"), F.col("default_value"))
    return (
        new_instances.select("product_uid", "application_id")
        .join(db.applications.select("application_id", "product_id"), "application_id")
        .join(defs, "product_id")
        .select("pcc_id", "product_uid", *[typed[c].alias(c) for c in VALUE_COLUMNS])
    )


def store_attributes(db: Tables, values: DataFrame) -> DataFrame:
    """The first values with their keys."""
    return append_with_ids(db.product_custom_column_values, values, "pcc_uid", ["product_uid", "pcc_id"])


@dataclass
class AttributeChanges:
    values: DataFrame  # all attribute values after the change
    changed: DataFrame  # rows that took a change
    rejects: DataFrame  # request_id, pcc_uid, reason


def update_attributes(db: Tables, requests: DataFrame, is_client: bool = True) -> AttributeChanges:
    """Write attribute values from ``requests(request_id, pcc_uid, <the six value columns>)``.

    Only the column of the attribute's type is written, and NULL clears it. Clients may change
    visible attributes only. The last request for a value wins.
    """
    defs = db.product_custom_column_def.select("pcc_id", "column_type", "customer_visible_yn")
    allowed = F.lit(not is_client) | F.col("customer_visible_yn").eqNullSafe("Y")
    # Reduced before the join: a value with very many requests is one row there.
    last = requests.groupBy("pcc_uid").agg(F.max_by(F.struct(*VALUE_COLUMNS), "request_id").alias("_asked"))
    typed = db.product_custom_column_values.join(defs, "pcc_id", "left")
    known = typed.filter(F.col("column_type").isNotNull()).select("pcc_uid", F.lit(True).alias("_known"), "customer_visible_yn")
    checked = requests.join(known, "pcc_uid", "left").withColumn(
        "reason", F.when(F.col("_known").isNull(), "unknown_attribute").when(~allowed, "not_allowed")
    )
    types = {
        "int_value": ["integer"], "float_value": ["float"], "varchar_value": ["char", "varchar"],
        "text_value": ["text"], "date_value": ["date"], "datetime_value": ["datetime"],
    }
    joined = typed.join(last, "pcc_uid", "left")
    changed = F.col("_asked").isNotNull() & F.col("column_type").isNotNull() & allowed
    after = ["pcc_uid", "pcc_id", "product_uid"] + [
        F.when(changed & F.col("column_type").isin(types[c]), F.col("_asked." + c)).otherwise(F.col(c)).alias(c)
        for c in VALUE_COLUMNS
    ]
    return AttributeChanges(
        joined.select(*after),
        joined.filter(changed).select(*after),
        checked.filter(F.col("reason").isNotNull()).select("request_id", "pcc_uid", "reason"),
    )
