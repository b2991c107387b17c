import datetime as dt
import json

from bankspark.session import shared_dir
from bankspark.sources import dims
from bankspark.sources.tables import (
    append_rows, latest_version, load_tables, menu_for_role, read_menu, write_snapshot,
)
from tests.conftest import table


def test_dimensions(spark, mapped):
    assert [r.code for r in mapped.product_statuses.orderBy("order_no").collect()][:3] == ["APL", "REV", "AGR"]
    assert mapped.product_statuses.count() == 17 and mapped.next_status.count() == 31
    first = mapped.account_groups.orderBy(mapped.account_groups.default_yn.desc()).first()
    assert first.group_code == "FTC"
    text = mapped.product_subcategories.filter("subcategory_id = 7").first().subcategory_description
    assert "asset's price" in text
    assert {row[1] for row in dims.PRODUCT_STATUSES} == set(dims.STATUS_CODES)


def test_store_and_load(spark, frame, tmp_path):
    rows = table(frame, "accounts", [{"account_id": 1, "created_dt": dt.datetime(2024, 1, 1)}])
    rows.write.parquet(f"{tmp_path}/bank/accounts")
    append_rows(rows, f"{tmp_path}/bank/accounts")
    db = load_tables(spark, f"{tmp_path}/bank")
    assert db.accounts.count() == 2 and not hasattr(db, "products") and db.user_roles.count() == 4


def test_snapshots(spark, frame, tmp_path):
    path = f"{tmp_path}/snap"
    assert latest_version(spark, path) is None
    one = frame("x BIGINT", [(1,)])
    for version in (0, 3, 3):
        write_snapshot(one, path, version)
    assert latest_version(spark, path) == 3 and latest_version(spark, path, before=3) == 0
    assert spark.read.parquet(f"{path}/version=3").count() == 1


def test_menu(spark, tmp_path):
    menu = [
        {"displayName": "Reports", "icon": "i", "privileges": ["A", "C"], "dataGroup": "g1", "children": [{"displayName": "Out", "url": "u"}]},
        {"displayName": "Catalog", "icon": "i", "privileges": ["A", "E"], "dataGroup": "g2", "children": [
            {"displayName": "All", "url": "v"}, {"displayName": "Admin", "url": "w", "privileges": ["A"]}]},
    ]
    path = tmp_path / "menu.json"
    path.write_text(json.dumps(menu, indent=2))
    seen = lambda role: [(r.group_name, r.child_name) for r in menu_for_role(read_menu(spark, str(path)), role).orderBy("data_group", "pos").collect()]
    assert seen("E") == [("Catalog", "All")]
    assert seen("A") == [("Reports", "Out"), ("Catalog", "All"), ("Catalog", "Admin")]
    assert seen("U") == []


def test_shared_dir_is_kept(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_growing_tables_are_not_read_through_one_connection(spark):
    import pytest

    from bankspark.sources.tables import load_tables_jdbc

    with pytest.raises(ValueError, match="accounts.*product_instances"):
        load_tables_jdbc(spark, "jdbc:none", {}, {"contracts": ("contract_id", 1, 10, 2)})
