"""Who may ask for a change.

Requests may name who asks in ``user_id`` and ``user_role``; those without the right are refused as ``not_allowed``
before anything else is looked at. Requests without a ``user_role`` column come from the bank's own jobs and all pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bankspark.functions import columns as C


def staff() -> Column:
    return C.is_staff(F.col("user_role"))


def senior() -> Column:
    return C.is_senior(F.col("user_role"))


def admin() -> Column:
    return F.coalesce(F.col("user_role") == "A", F.lit(False))


def staff_or_own(account: str) -> Column:
    """Staff, or a client for the own account."""
    return staff() | F.coalesce(F.col("user_id") == F.col(account), F.lit(False))


def by_right(requests: DataFrame, may: Column, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """The requests that pass, and ``(request_id, keys, reason)`` of those that don't, None if nobody is named."""
    if "user_role" not in requests.columns:
        return requests, None
    refused = requests.filter(~may).select("request_id", *keys, F.lit("not_allowed").alias("reason"))
    return requests.filter(may), refused


def with_refused(rejects: DataFrame, refused: DataFrame | None) -> DataFrame:
    return rejects if refused is None else rejects.unionByName(refused)
