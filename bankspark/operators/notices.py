"""Messages to clients as tables. Sending them is left to others."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from bankspark.functions import columns as C
from bankspark.sources import dims
from bankspark.sources.tables import Tables


def _recipients(instances: DataFrame, db: Tables) -> DataFrame:
    """Instances with the client's address, the product and the status name."""
    people = db.accounts.select("account_id", "email", "first_name", "last_name")
    products = db.products.select("product_id", F.col("name").alias("product_name"), "category_id")
    statuses = db.product_statuses.select(F.col("code").alias("status_code"), "status_name")
    return (
        instances.join(people, "account_id")
        .join(db.applications.select("application_id", "product_id"), "application_id")
        .join(products, "product_id").join(statuses, "status_code")
    )


_KEYS = ["product_uid", "account_id", "application_id", "status_code"]
_MESSAGE = ["product_uid", "email", "first_name", "last_name", "product_name", "status_name"]


def status_notifications(db: Tables, changes: DataFrame, by_client: bool = False) -> DataFrame:
    """Messages about ``changes(product_uid, change_id, is_code)``.

    Preference 'Y' gets all, 'P' the important ones (of the client's own changes only the
    cancellation), others none.
    """
    important = ("CNL",) if by_client else dims.NOTIFY_PARTLY
    wanted = (F.col("notifications_yn") == "Y") | (
        (F.col("notifications_yn") == "P") & F.col("is_code").isin(*important)
    )
    rows = changes.select("product_uid", "change_id", "is_code").join(
        db.product_instances.select("product_uid", "account_id", "application_id", "notifications_yn"), "product_uid"
    ).filter(wanted).withColumnRenamed("is_code", "status_code")
    template = F.when(F.col("status_code") == "APL", "received").otherwise("update")
    return _recipients(rows, db).select("change_id", *_MESSAGE, template.alias("template"))


def due_notices(db: Tables, as_of: dt.date) -> DataFrame:
    """Messages for products falling due on ``as_of`` or on an exercise date."""
    today = C.day(as_of)
    hit = ((F.col("product_end_date") == today) & (F.col("status_code") == "DUE")) | (F.col("status_code") == "EXC")
    template = F.when(F.col("category_id") == "DER", "exercise").otherwise("due")
    rows = db.product_instances.filter(hit).select(*_KEYS)
    return _recipients(rows, db).select(*_MESSAGE, "category_id", template.alias("template"))


def overdue_notices(db: Tables) -> DataFrame:
    """Messages for overdue products other than derivatives, with the date they fell due."""
    rows = db.product_instances.filter(F.col("status_code") == "ORD").select(
        *_KEYS, F.col("product_end_date").alias("due_since")
    )
    return _recipients(rows, db).filter(F.col("category_id") != "DER").select(
        *_MESSAGE, "due_since", F.lit("overdue").alias("template")
    )


def contract_notices(db: Tables, signed: DataFrame) -> DataFrame:
    """Messages that carry the contract of the instances in ``signed(product_uid)``."""
    rows = signed.select("product_uid").join(
        db.product_instances.select(*_KEYS, "contract_id"), "product_uid"
    )
    return _recipients(rows, db).select(
        "product_uid", "email", "first_name", "last_name", "contract_id", "product_name",
        F.lit("contract").alias("template"),
    )
