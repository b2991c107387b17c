"""Physical plans: no Python, no product joins of growing tables, filters and columns in the scan."""

import itertools
import re

import pytest

from bankspark.operators import instances
from bankspark.plans.queries import QUERIES
from tests.conftest import DATA

# These run a stream or write pages before they return, so their last plan says little.
BATCH = [name for name in QUERIES if not name.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_products(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator


def test_filter_and_columns_reach_the_scan(spark, mapped):
    from bankspark.operators import lifecycle
    import datetime as dt

    plan = plan_of(lifecycle.sweep_due(mapped, dt.date(2024, 1, 15)))
    scans = re.findall(r"ReadSchema: struct<[^>]*>", plan)
    assert scans and all("o_totalprice" not in s for s in scans)


def test_assignment_keeps_best_rank_before_shuffle(mapped):
    assert plan_of(instances.assignments(mapped)).count("WindowGroupLimit") == 2


def test_growing_tables_are_not_hinted_for_broadcast(mapped):
    text = instances.product_cards(mapped)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in text.lower()


def test_bucketed_facts_join_without_shuffle(spark, mapped, tmp_path):
    import datetime as dt

    from bankspark.operators import lifecycle
    from bankspark.sources.tables import Tables, load_bucketed, store_bucketed

    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    try:
        store_bucketed(mapped, "bucketed", 4)
        facts = load_bucketed(spark, "bucketed")
        db = Tables(spark, product_custom_column_def=mapped.product_custom_column_def, **facts)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        instances_join = facts["product_instances"].join(facts["product_custom_column_values"], "product_uid")
        assert "Exchange" not in plan_of(instances_join)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        day = dt.date(2024, 1, 15)
        got = sorted(map(tuple, lifecycle.nightly(db, day).audit.select("product_uid", "step").collect()))
        want = sorted(map(tuple, lifecycle.nightly(mapped, day).audit.select("product_uid", "step").collect()))
        assert got == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE IF EXISTS bucketed CASCADE")


@pytest.mark.parametrize("name", ["clone_product_columns", "contract_json_roundtrip", "contract_text", "patch_instance_values"])
def test_definitions_are_not_broadcast_by_a_guess(spark, tmp_path, name):
    """Definitions of 1.2 million products: what one of their columns is guessed at is far below their rows."""
    import os

    for table in os.listdir(DATA):
        if table != "part.parquet":
            os.symlink(f"{DATA}/{table}", f"{tmp_path}/{table}")
    spark.sql("""
        SELECT id AS p_partkey, 'large ring' AS p_name, 'Brand#7' AS p_brand, 'PROMO' AS p_type,
               CAST(id % 50 AS INT) AS p_size, 900.0D AS p_retailprice FROM range(1200000)""").write.parquet(f"{tmp_path}/part.parquet")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for key in before:  # as in a session made elsewhere
            spark.conf.unset(key)
        lines = plan_of(QUERIES[name](spark, str(tmp_path))).splitlines()
        depth = lambda line: len(re.match(r"[ :+*-]*", line).group())
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = itertools.takewhile(lambda x, d=depth(line): depth(x) > d, lines[at + 1 :])
                assert not any("Generate inline" in x for x in below)
        assert any("Generate inline" in x for x in lines)
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == str(10 << 20)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", ["contract_json_roundtrip", "contract_text", "patch_instance_values"])
def test_well_compressed_definitions_are_not_broadcast_by_a_guess(spark, tmp_path, name):
    """Products whose file is so small that definitions are guessed below any threshold."""
    import os

    for table in os.listdir(DATA):
        if table != "part.parquet":
            os.symlink(f"{DATA}/{table}", f"{tmp_path}/{table}")
    spark.sql("""
        SELECT id AS p_partkey, 'large ring' AS p_name, 'Brand#7' AS p_brand, 'PROMO' AS p_type,
               CAST(id % 50 AS INT) AS p_size, 900.0D AS p_retailprice FROM range(1200000)""").coalesce(1).write.option(
        "compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{tmp_path}/part.parquet")
    keys = ["autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold", "sources.fileCompressionFactor"]
    before = {k: spark.conf.get(k, None) for k in ("spark.sql." + k for k in keys)}
    try:
        for key in before:  # as in a session made elsewhere
            spark.conf.unset(key)
        lines = plan_of(QUERIES[name](spark, str(tmp_path))).splitlines()
        depth = lambda line: len(re.match(r"[ :+*-]*", line).group())
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = itertools.takewhile(lambda x, d=depth(line): depth(x) > d, lines[at + 1 :])
                assert not any("Generate inline" in x for x in below)
        assert any("Generate inline" in x for x in lines)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name, times", [("contract_json_roundtrip", 1), ("contract_text", 2)])
def test_facts_of_contracts_are_put_together_once(spark, name, times):
    """Documents join owners once; lines once more, for what belongs to attribute rows."""
    scans = re.findall(r"FileScan parquet [^\n]*customer\.parquet", plan_of(QUERIES[name](spark, DATA)))
    assert len(scans) == times


@pytest.mark.parametrize("name", ["contract_json_roundtrip", "contract_text"])
@pytest.mark.parametrize("key", ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"])
def test_measured_broadcasts_are_bounded(spark, name, key):
    """A session may allow more than the driver can hold several times over."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:  # as in a session made elsewhere
            spark.conf.unset(k)
        spark.conf.set(key, "64m")
        QUERIES[name](spark, DATA)
        assert spark.conf.get(keys[1]) == str(10 << 20)
        spark.conf.set(keys[1], "256k")  # a lower bound stays
        QUERIES[name](spark, DATA)
        assert spark.conf.get(keys[1]) == "256k"
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
