"""Queries with a plain-SQL twin."""

import duckdb
import pytest

from bankspark.llm.queries import ORACLES, QUERIES
from bankspark.plans.compare import differences
from tests.conftest import DATA


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    plain = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        plain.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result, cursor = QUERIES[name](spark, DATA), plain.execute(ORACLES[name])
    assert differences(result.columns, result.collect(), [d[0] for d in cursor.description], cursor.fetchall()) is None
