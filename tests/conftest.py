import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bankspark.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "bankspark-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mapped(spark):
    from bankspark.sources.tables import MappedTables

    return MappedTables(spark, DATA)


@pytest.fixture
def frame(spark):
    """DataFrame from rows and a DDL schema."""
    def build(schema, rows):
        return spark.createDataFrame(rows, schema)

    return build


def table(frame, name, rows):
    """Bank table from dicts; columns left out are NULL."""
    from bankspark.sources import schemas

    fields = [part.split()[0] for part in schemas.TABLES[name].split(", ")]
    return frame(schemas.TABLES[name], [tuple(row.get(f) for f in fields) for row in rows])
