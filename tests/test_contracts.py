import datetime as dt
import json

from pyspark.sql import functions as F

from bankspark.operators import contracts
from bankspark.sources.tables import Tables
from tests.conftest import table

DAY = dt.date(2024, 1, 15)


def bank(spark, frame, n_attributes=2, **more):
    products = [
        {"product_id": 1, "category_id": "LON", "name": "loan", "description": "d", "currency": "BGN"},
        {"product_id": 2, "category_id": "DER", "name": "option", "description": 'a "quoted" rule', "currency": "EUR"},
        {"product_id": 3, "category_id": "PEQ", "name": "share", "description": "d", "currency": "USD"},
        {"product_id": 4, "category_id": "ABC", "name": "other", "description": "d", "currency": "USD"},
    ]
    instances = [
        {"product_uid": u, "application_id": u, "account_id": 8, "amount": a, "yield": y, "status_code": "SGN", "contract_id": u,
         "product_start_date": dt.date(2024, 2, 1), "product_end_date": dt.date(2024, 5, 5)}
        for u, a, y in [(1, 100.5, 0.05), (2, None, 0.5), (3, 7.0, 0.25), (4, None, 0.1), (5, None, 0.1), (6, 1.0, None)]
    ]
    applications = [{"application_id": u, "product_id": p} for u, p in [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 2)]]
    defs = [{"pcc_id": i, "product_id": 2, "column_name": f"attr {i}", "column_type": "varchar", "customer_visible_yn": "Y"} for i in range(n_attributes)]
    values = [{"pcc_uid": 100 + i, "pcc_id": i, "product_uid": 2, "varchar_value": f"v{i}"} for i in range(n_attributes)]
    return Tables(
        spark, products=table(frame, "products", products), product_instances=table(frame, "product_instances", instances),
        applications=table(frame, "applications", applications),
        accounts=table(frame, "accounts", [{"account_id": 8, "first_name": "Ann", "last_name": "Lee", "country_code": "BGR", "address": "", "verification": "Y"}]),
        product_custom_column_def=table(frame, "product_custom_column_def", defs),
        product_custom_column_values=table(frame, "product_custom_column_values", values), **more,
    )


def documents(db):
    rows = contracts.render_contracts(db, DAY, bank_name="Our Bank").collect()
    return {r.product_uid: json.loads(r.unsigned_contract) for r in rows}


def test_documents(spark, frame):
    db = bank(spark, frame)
    docs = documents(db)
    assert set(docs) == {1, 2, 3, 4}
    assert "amount of BGN100.50 " in docs[1][1] and "rate of 5.00% per" in docs[1][2] and "ending on May 05, 2024." in docs[1][2]
    assert "with an address in Bulgaria" in docs[1][0] and "Our Bank" in docs[1][0] and len(docs[1]) == 13
    assert docs[2][5] == {"type": "table", "data": [["attr 0", "v0"], ["attr 1", "v1"], ["Strike Date", "May 05, 2024"]]}
    assert 'rule: a "quoted" rule.' in docs[2][3] and "Product UID 2 from" in docs[2][1]
    assert docs[3].count(None) == 2 and "for the 25.00% shares of Seller shall be USD7.00" in docs[3][10]
    assert docs[4] == ["No contract can be generated.", "Borrower's Signature: ___________________", "Date: _______________"]
    rejects = {r.product_uid: r.reason for r in contracts.contract_lines(db, DAY).rejects.collect()}
    assert rejects == {5: "missing_terms", 6: "missing_terms"}


def test_long_tables_go_on_in_further_parts(spark, frame):
    db = bank(spark, frame, n_attributes=250)
    parts = contracts.contract_documents(db, DAY, page_size=10).filter("product_uid = 2").orderBy("part_no").collect()
    elements = [e for p in parts for e in p.contents]
    assert len(parts) > 1 and max(len(p.contents) for p in parts) <= 10
    table_rows = [row for e in elements if e.kind == "table" for row in e.data]
    assert len(table_rows) == 251 and table_rows[0] == ["attr 0", "v0"] and table_rows[-1][0] == "Strike Date"
    assert elements[-1].text == "Date: _______________"


def test_json_roundtrip(spark, frame):
    db = bank(spark, frame)
    docs = contracts.contract_documents(db, DAY)
    from_lines = contracts.documents_from_lines(contracts.contract_lines(db, DAY).lines, 100)
    assert docs.exceptAll(from_lines).isEmpty() and from_lines.exceptAll(docs).isEmpty()
    back = docs.withColumn("again", contracts.contract_from_json(contracts.contract_to_json(F.col("contents"))))
    assert back.filter("NOT (contents <=> again)").isEmpty()
    spaced = frame("j STRING", [('["a", {"type": "table", "data": [["x", null]]}, null]',)])
    got = spaced.select(contracts.contract_from_json(F.col("j")).alias("c")).first().c
    assert [e.kind for e in got] == ["text", "table", "none"] and got[1].data == [["x", None]]


def test_attributes_outside_tables_and_open_ends(spark, frame):
    """Attributes of a loan make no table; an option without end still has its strike date row, also for some instances only."""
    db = bank(spark, frame)
    more = db.product_custom_column_values.withColumn("product_uid", F.lit(1).cast("bigint"))
    open_end = db.product_instances.withColumn("product_end_date", F.lit(None).cast("date"))
    db = db.replace(product_custom_column_values=db.product_custom_column_values.unionByName(more), product_instances=open_end)
    lines = contracts.contract_lines(db, DAY).lines
    table = sorted((r.product_uid, r.clause_no, r.row_no, r.text, r.label, r.value) for r in lines.filter("kind = 'table'").collect())
    assert table == [(2, 5, 100, None, "attr 0", "v0"), (2, 5, 101, None, "attr 1", "v1"), (2, 5, (1 << 63) - 1, None, "Strike Date", None)]
    docs = contracts.contract_documents(db, DAY)
    from_lines = contracts.documents_from_lines(lines, 100)
    assert docs.exceptAll(from_lines).isEmpty() and from_lines.exceptAll(docs).isEmpty()
    some = contracts.contract_documents(db, DAY, frame("product_uid BIGINT", [(2,), (2,), (5,)]))
    assert some.exceptAll(docs.filter("product_uid = 2")).isEmpty() and some.count() == 1


def test_signing(spark, frame):
    db = bank(spark, frame)
    rendered = contracts.render_contracts(db, DAY)
    stored, with_ids = contracts.store_contracts(db.replace(contracts=table(frame, "contracts", [{"contract_id": 10}])), rendered)
    ids = {r.product_uid: r.contract_id for r in with_ids.collect()}
    assert ids == {1: 11, 2: 12, 3: 13, 4: 14, 5: 5, 6: 6}
    people = db.accounts.unionByName(table(frame, "accounts", [{"account_id": 9, "verification": "N"}]))
    other = with_ids.withColumn("account_id", F.when(F.col("product_uid") == 3, 9).otherwise(F.col("account_id")).cast("bigint"))
    other = other.withColumn("status_code", F.when(F.col("product_uid") == 4, "NOR").otherwise(F.col("status_code")))
    db = db.replace(contracts=stored, product_instances=other, accounts=people)
    asked = frame("request_id BIGINT, product_uid BIGINT, account_id BIGINT", [
        (1, 1, 8), (2, 1, 8), (3, 2, 9), (4, 3, 9), (5, 4, 8), (6, 99, 8),
    ])
    done = contracts.sign_contracts(db, asked, dt.datetime(2024, 3, 7, 9))
    assert {(r.request_id, r.reason) for r in done.rejects.collect()} == {
        (2, "status_not_for_signing"), (3, "not_the_owner"), (4, "account_not_verified"), (5, "status_not_for_signing"),
        (6, "unknown_instance"),
    }
    assert {r.product_uid for r in done.instances.filter("status_code = 'AWT'").collect()} == {1}
    assert [(r.product_uid, r.is_code, r.update_user) for r in done.audit.collect()] == [(1, "AWT", 8)]
    text = {r.contract_id: json.loads(r.contract) for r in contracts.effective_contract(done.contracts).collect()}
    assert text[11][-2:] == ["Borrower's Signature: Ann Lee [digitally signed]", "Date: March 07, 2024"] and len(text[11]) == 13
    assert text[12][-1] == "Date: _______________"


def test_parts_make_one_contract(spark, frame):
    """A contract of many parts is stored under one id, signed at its end and read back whole."""
    db = bank(spark, frame)
    parts = contracts.contract_documents(db, DAY, page_size=1)
    assert parts.groupBy("product_uid").count().agg(F.max("count")).first()[0] > 2
    rendered = parts.select("product_uid", "part_no", contracts.contract_to_json(F.col("contents")).alias("unsigned_contract"))
    stored, held = contracts.store_contracts(db.replace(contracts=table(frame, "contracts", [])), rendered)
    ids = {r.product_uid: r.contract_id for r in held.collect()}
    assert stored.count() == len({i for i in ids.values() if i is not None and i < 5})
    asked = frame("request_id BIGINT, product_uid BIGINT, account_id BIGINT", [(1, 1, 8)])
    done = contracts.sign_contracts(db.replace(contracts=stored, product_instances=held), asked, dt.datetime(2024, 3, 7, 9))
    text = {r.contract_id: json.loads(r.contract) for r in contracts.effective_contract(done.contracts).collect()}
    elements = {r.product_uid: sum(len(p.contents) for p in parts.collect() if p.product_uid == r.product_uid) for r in parts.collect()}
    assert len(text[ids[1]]) == elements[1]
    assert text[ids[1]][-2:] == ["Borrower's Signature: Ann Lee [digitally signed]", "Date: March 07, 2024"]
    for uid in elements:
        assert len(text[ids[uid]]) == elements[uid]
        if uid != 1:
            assert text[ids[uid]][-1] == "Date: _______________"


def test_keys_of_contracts_are_given_without_their_texts(spark, mapped, monkeypatch):
    from bankspark.operators import ordering
    from bankspark.sources import schemas

    kept = []
    checkpointed = ordering.checkpointed
    monkeypatch.setattr(ordering, "checkpointed", lambda df: kept.append(df.columns) or checkpointed(df))
    none, open_ones = spark.createDataFrame([], schemas.TABLES["contracts"]), mapped.product_instances.withColumn(
        "contract_id", F.lit(None).cast("bigint"))
    db = mapped.replace(contracts=none, product_instances=open_ones)
    rendered = contracts.render_contracts(mapped, DAY)
    new, held = contracts.store_contracts(db, rendered)
    assert kept == [["product_uid", "_part", "_place"]]
    got = held.join(new, "contract_id").select("product_uid", "unsigned_contract").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rendered.select("product_uid", "unsigned_contract").collect()))
    ids = [r.contract_id for r in new.orderBy("contract_id").collect()]
    assert ids == list(range(1, rendered.count() + 1))
