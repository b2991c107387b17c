"""Every registered query against its plain-SQL twin."""

import duckdb
import pytest

from bankspark.plans.compare import differences
from bankspark.plans.oracles import ORACLES
from bankspark.plans.queries import QUERIES
from bankspark.sources.mapping import RAW_TABLES
from tests.conftest import DATA

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def plain():
    connection = duckdb.connect()
    for name in RAW_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, plain, name):
    result = QUERIES[name](spark, DATA)
    cursor = plain.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    assert rows, "an empty result checks nothing"
    assert differences(result.columns, result.collect(), columns, rows) is None
    types = {r[0]: r[1] for r in plain.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema} == types
