"""Order-insensitive comparison of a DataFrame with the rows of another SQL engine."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter


def plain(value):
    """A value as both engines can express it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def row_counts(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(columns: list[str], rows, other_columns: list[str], other_rows) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(columns) != sorted(other_columns):
        return f"columns {sorted(columns)} != {sorted(other_columns)}"
    left, right = row_counts(columns, rows), row_counts(other_columns, other_rows)
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return (
        f"{sum(left.values())} and {sum(right.values())} rows; only left {sum(only_left.values())}: "
        f"{list(only_left)[:2]}; only right {sum(only_right.values())}: {list(only_right)[:2]}"
    )
