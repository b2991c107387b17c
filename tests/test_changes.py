import datetime as dt

from pyspark.sql import functions as F

from bankspark.operators import attributes, catalog, changes
from bankspark.sources.tables import Tables
from tests.conftest import table

NOW = dt.datetime(2024, 1, 15, 10)


def bank(spark, frame):
    products = [
        {"product_id": 1, "category_id": "LON", "name": "loan", "draft_yn": "N", "percentage": 0.5, "available_till": NOW},
        {"product_id": 2, "category_id": "DER", "subcategory_id": 2, "name": "option", "draft_yn": "N", "term": 6},
        {"product_id": 3, "category_id": "DER", "name": "idea", "draft_yn": "Y", "draft_owner": 8},
    ]
    defs = [
        {"pcc_id": 5, "product_id": 2, "column_name": "b", "column_type": "integer", "default_value": "12abc", "customer_visible_yn": "Y"},
        {"pcc_id": 3, "product_id": 2, "column_name": "a", "column_type": "char", "default_value": "x", "customer_visible_yn": "N"},
    ]
    drafts = [
        {"product_id": 3, "order_no": 1, "column_name": "second", "column_type": "text"},
        {"product_id": 3, "order_no": 0, "column_name": "first", "column_type": "date"},
    ]
    return Tables(
        spark, products=table(frame, "products", products),
        product_custom_column_def=table(frame, "product_custom_column_def", defs),
        draft_product_custom_column_def=table(frame, "draft_product_custom_column_def", drafts),
        accounts=table(frame, "accounts", [{"account_id": 8, "phone": "1", "verification": "Y", "country_code": "BGR"}]),
        applications=table(frame, "applications", [{"application_id": 40, "product_id": 2}]),
        product_instances=table(frame, "product_instances", [
            {"product_uid": 300001, "application_id": 40, "account_id": 8, "amount": 1.0, "notifications_yn": "P"}
        ]),
        product_custom_column_values=table(frame, "product_custom_column_values", [
            {"pcc_uid": 1, "pcc_id": 5, "product_uid": 300001, "int_value": 4}, {"pcc_uid": 2, "pcc_id": 3, "product_uid": 300001},
        ]),
    )


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_patch_null_leaves_and_token_clears(spark, frame):
    db = bank(spark, frame)
    patches = frame("request_id BIGINT, product_id BIGINT, name STRING, percentage STRING, available_till STRING", [
        (1, 1, "renamed", None, "__null__"), (2, 1, None, "0.25", None), (3, 1, "again", "__null__", None),
        (4, 2, None, None, None), (5, 9, "x", None, None), (6, 2, "kept out", "much", None),
    ])
    done = changes.patch_products(db, patches)
    assert rows(done.changed, "product_id", "name", "percentage", "available_till") == [(1, "again", None, None)]
    assert rows(done.rejects, "request_id", "reason") == [
        (4, "nothing_to_update"), (5, "unknown_product_id"), (6, "unreadable_value")
    ]
    assert rows(done.rows.filter("product_id = 2"), "name", "term") == [("option", 6)]
    nothing = changes.patch_products(db, patches.filter("request_id = 4"))
    assert sorted(nothing.rows.collect(), key=str) == sorted(db.products.collect(), key=str)


def test_patch_flags_and_categories(spark, frame):
    db = bank(spark, frame)
    patches = frame("request_id BIGINT, category_id STRING, catalog_yn STRING, description STRING", [
        (1, "PEQ", "Y", None), (2, "LON", "maybe", None), (3, "XXX", "Y", None),
    ])
    done = changes.patch_categories(db, patches)
    assert rows(done.changed, "category_id", "catalog_yn") == [("LON", "N"), ("PEQ", "Y")]
    subs = frame("request_id BIGINT, subcategory_id BIGINT, category_id STRING, subcategory_name STRING", [
        (1, 1, "LON", None), (2, 2, "???", "lost"), (3, 3, None, "named"),
    ])
    done = changes.patch_subcategories(db, subs)
    assert rows(done.changed, "subcategory_id", "category_id", "subcategory_name") == [
        (1, "LON", "Futures Contract"), (3, "DER", "named")
    ]
    assert rows(done.rejects, "request_id", "reason") == [(2, "unknown_category")]


def test_account_patch_writes_up_to_the_first_bad_field(spark, frame):
    db = bank(spark, frame)
    schema = "request_id BIGINT, account_id BIGINT, phone STRING, email STRING, country_code STRING, address STRING"
    done = changes.patch_accounts(db, frame(schema, [(1, 8, "22", "e" * 256, "USA", "there")]))
    assert rows(done.changed, "phone", "email", "country_code", "address", "verification") == [("22", None, "BGR", None, "Y")]
    assert rows(done.rejects, "reason") == [("email_too_long",)]
    done = changes.patch_accounts(db, frame(schema, [(1, 8, None, "e@x.test", None, None)]))
    assert rows(done.changed, "email", "verification") == [("e@x.test", "R")]


def test_draft_patch_availability_and_preference(spark, frame):
    db = bank(spark, frame)
    done = changes.patch_drafts(db, frame("request_id BIGINT, product_id BIGINT, name STRING", [(1, 3, "new"), (2, 1, "no"), (3, 7, "no")]))
    assert rows(done.changed, "product_id", "name") == [(3, "new")]
    assert rows(done.rejects, "request_id", "reason") == [(2, "not_a_draft"), (3, "unknown_product")]
    dates = frame("request_id BIGINT, product_id BIGINT, available_from TIMESTAMP_NTZ, available_till TIMESTAMP_NTZ", [(1, 1, NOW, None)])
    assert rows(changes.set_availability(db, dates).changed, "available_from", "available_till") == [(NOW, None)]
    asked = frame("request_id BIGINT, product_uid BIGINT, user_id BIGINT, user_role STRING, preference STRING", [
        (1, 300001, 8, "U", "N"), (2, 300001, 9, "U", "Y"), (3, 300001, 9, "E", "Q"), (4, 1, 9, "E", "Y"),
    ])
    done = changes.set_notification_pref(db, asked)
    assert rows(done.changed, "notifications_yn") == [("N",)]
    assert rows(done.rejects, "request_id", "reason") == [(2, "not_allowed"), (3, "unknown_preference"), (4, "unknown_instance")]


def test_order_zero_sorts_as_hundred(frame):
    columns = frame("product_id BIGINT, input_pos BIGINT, order_no BIGINT, column_name STRING", [
        (1, 0, 0, "zero"), (1, 1, 2, "two"), (1, 2, 1, "one"), (1, 3, 100, "hundred"), (1, 4, 200, "late"), (1, 5, None, "none"),
    ])
    got = changes.renumber_columns(columns).orderBy("order_no").collect()
    assert [(r.order_no, r.column_name) for r in got] == list(enumerate(["one", "two", "zero", "hundred", "none", "late"]))


def test_clone_then_publish_keeps_the_attributes(spark, frame):
    db = bank(spark, frame)
    clones = changes.clone_products(db, frame("request_id BIGINT, product_id BIGINT, account_id BIGINT", [(1, 2, 77), (2, 99, 77)]))
    assert rows(clones.products, "product_id", "name", "draft_yn", "draft_owner", "available_from") == [(4, "option", "Y", 77, None)]
    assert rows(clones.columns, "order_no", "column_name") == [(1, "a"), (2, "b")]
    assert rows(clones.rejects, "request_id") == [(2,)]
    db = db.replace(
        products=db.products.unionByName(clones.products.select(*db.products.columns)),
        draft_product_custom_column_def=db.draft_product_custom_column_def.unionByName(clones.columns),
    )
    asked = frame("request_id BIGINT, product_id BIGINT, user_role STRING", [(1, 4, "A"), (2, 3, "E"), (3, 1, "A"), (4, 3, "C")])
    done = changes.publish_drafts(db, asked)
    assert rows(done.columns, "pcc_id", "product_id", "column_name") == [(6, 3, "first"), (7, 3, "second"), (8, 4, "a"), (9, 4, "b")]
    assert rows(done.counts, "product_id", "inserted_count") == [(3, 2), (4, 2)]
    assert rows(done.rejects, "request_id", "reason") == [(2, "not_allowed"), (3, "not_a_draft")]
    assert rows(done.products.filter("product_id > 2"), "product_id", "draft_yn", "draft_owner") == [(3, "N", None), (4, "N", None)]


def test_new_drafts_and_deletes(spark, frame):
    db = bank(spark, frame)
    names = [c for c in db.products.columns if c not in ("product_id", "draft_yn", "draft_owner")]
    requests = db.products.filter("product_id = 1").select(
        F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("request_id"), F.lit(u).alias("user_role")) for i, u in enumerate("AEU")])).alias("r"),
        F.lit(8).cast("bigint").alias("user_id"), *names,
    ).select("r.request_id", "r.user_role", "user_id", *names)
    columns = frame(
        "request_id BIGINT, input_pos BIGINT, order_no BIGINT, column_name STRING, customer_visible_yn STRING, customer_populatable_yn STRING, "
        "column_type STRING, default_value STRING, exercise_date_yn STRING, available_before STRING",
        [(0, 0, 0, "x", "Y", "?", "text", "", None, None), (0, 1, 5, "y", None, "Y", "text", "d", None, None)],
    )
    done = changes.create_drafts(db, requests, columns)
    assert rows(done.products, "product_id", "draft_yn", "available_till") == [(4, "Y", NOW), (5, "Y", None)]
    assert rows(done.columns, "product_id", "order_no", "column_name", "customer_visible_yn", "customer_populatable_yn") == [
        (4, 0, "y", "N", "Y"), (4, 1, "x", "Y", "N")
    ]
    assert rows(done.rejects, "request_id") == [(2,)]
    gone = changes.delete_drafts(db, frame("request_id BIGINT, product_id BIGINT", [(1, 3), (2, 1)]))
    assert rows(gone.products, "product_id") == [(1,), (2,)] and gone.columns.isEmpty()
    assert rows(gone.rejects, "request_id") == [(2,)]
    left, rejects = changes.delete_subcategories(db, frame("subcategory_id BIGINT", [(1,), (2,), (50,)]))
    assert rows(left, "subcategory_id") == [(2,), (3,), (4,), (5,), (6,), (7,)]
    assert rows(rejects, "subcategory_id", "reason") == [(2, "has_products"), (50, "unknown_subcategory")]


def test_category_codes(spark, frame):
    db = bank(spark, frame)
    requests = frame("request_id BIGINT, category_id STRING, category_name STRING, description STRING, catalog_yn STRING", [
        (1, "LONG", "n", "d", "Y"), (2, "BONDS", "n", "d", "x"), (3, "BON", "n", "d", None), (4, "LOAN", "n", "d", "Y"),
    ])
    got = {r.request_id: r.category_id for r in changes.assign_category_codes(db, requests).collect()}
    assert got[2] == "BON" and got[4] == "LOA"
    assert got[1][0] == "L" and got[1] not in ("LON", "LOA") and got[3][0] == "B" and got[3] != "BON"
    assert len(set(got.values())) == 4
    many = frame("request_id BIGINT, category_id STRING", [(i, "QQQ") for i in range(1300)])
    codes = [r.category_id for r in changes.assign_category_codes(db, many).collect()]
    assert codes.count(None) == 4 and len(set(codes)) == 1297
    made = changes.create_categories(db, requests)
    assert rows(made.categories, "request_id", "catalog_yn") == [(1, "Y"), (2, "N"), (3, "N"), (4, "Y")]
    new, bad = changes.create_subcategories(db, frame(
        "request_id BIGINT, category_id STRING, subcategory_name STRING, subcategory_description STRING, catalog_yn STRING",
        [(1, "LON", "s", "d", "Y"), (2, "???", "s", "d", "Y")],
    ))
    assert rows(new, "subcategory_id", "category_id") == [(8, "LON")] and rows(bad, "request_id") == [(2,)]


def test_sales_and_first_attributes(spark, frame):
    db = bank(spark, frame)
    requests = frame(
        "request_id BIGINT, account_id BIGINT, product_id BIGINT, standard_yn STRING, amount_requested DOUBLE, special_notes STRING, collateral STRING",
        [(5, 8, 2, "Q", 10.0, None, None), (4, 8, 1, "Y", 20.0, None, None), (6, 1, 2, "Y", 5.0, None, None)],
    )
    sales = changes.create_sales(db, requests, NOW)
    assert rows(sales.applications, "request_id", "application_id", "standard_yn") == [(4, 41, "Y"), (5, 42, "N")]
    assert rows(sales.instances, "request_id", "application_id", "product_uid", "status_code", "notifications_yn") == [
        (4, 41, 300002, "APL", "P"), (5, 42, 300003, "APL", "P")
    ]
    assert rows(sales.rejects, "request_id") == [(6,)]
    after = db.replace(applications=db.applications.unionByName(sales.applications.select(*db.applications.columns)))
    first = attributes.init_attributes(after, sales.instances)
    assert rows(first, "product_uid", "pcc_id", "int_value", "varchar_value") == [(300003, 3, None, "x"), (300003, 5, None, None)]
    assert rows(attributes.store_attributes(db, first), "pcc_uid", "pcc_id") == [(3, 3), (4, 5)]


def test_attribute_updates(spark, frame):
    db = bank(spark, frame)
    schema = "request_id BIGINT, pcc_uid BIGINT, int_value BIGINT, float_value DOUBLE, varchar_value STRING, text_value STRING, date_value DATE, datetime_value TIMESTAMP_NTZ"
    asked = frame(schema, [(1, 1, 7, 1.5, "v", None, None, None), (2, 1, None, 2.5, "w", None, None, None), (3, 2, 9, None, "z", None, None, None), (4, 5, 1, None, None, None, None, None)])
    client = attributes.update_attributes(db, asked)
    assert rows(client.changed, "pcc_uid", "int_value", "float_value", "varchar_value") == [(1, None, None, None)]
    assert rows(client.rejects, "request_id", "reason") == [(3, "not_allowed"), (4, "unknown_attribute")]
    staff = attributes.update_attributes(db, asked.filter("request_id <> 2"), is_client=False)
    assert rows(staff.values, "pcc_uid", "int_value") == [(1, 7), (2, None)]
    assert rows(staff.values.filter("pcc_uid = 2"), "varchar_value") == [("z",)]


def test_foreign_keys(spark, frame):
    db = bank(spark, frame)
    keys = [changes.ForeignKey("product", "product_id", db.products, "product_id"), changes.ForeignKey("account", "account_id", db.accounts, "account_id")]
    asked = frame("id BIGINT, product_id BIGINT, account_id BIGINT", [(1, 1, 8), (2, None, 8), (3, 9, 8), (4, 9, 9)])
    assert rows(changes.fk_rejects(asked, "id", keys), "id", "constraint_name") == [(3, "product"), (4, "account"), (4, "product")]
    assert rows(changes.fk_accepted(asked, keys), "id") == [(1,), (2,)]


def test_catalogue_edges(spark, frame):
    base = {"category_id": "LON", "draft_yn": "N"}
    midnight = dt.datetime(2024, 1, 15)
    products = [
        {"product_id": 1, **base}, {"product_id": 2, **base, "available_from": midnight}, {"product_id": 3, **base, "available_from": midnight, "available_till": midnight},
        {"product_id": 4, **base, "available_from": midnight, "available_till": NOW}, {"product_id": 5, "category_id": None, "draft_yn": "N", "available_from": midnight},
        {"product_id": 6, "category_id": "DER", "draft_yn": "Y", "available_from": midnight, "draft_owner": 3},
    ]
    db = Tables(spark, products=table(frame, "products", products))
    ids = lambda df: [r[0] for r in rows(df, "product_id")]
    assert ids(catalog.catalog(db, NOW)) == [2, 4]
    assert ids(catalog.catalog(db, NOW, only_active="N", include_drafts="Y")) == [1, 2, 3, 4, 6]
    assert ids(catalog.catalog(db, NOW, category_id="DER", include_drafts="Y")) == [6]
    assert ids(catalog.drafts(db, owner=4)) == [] and ids(catalog.drafts(db, owner=3)) == [6]
    assert rows(catalog.categories(db), "category_id") == [("DER",), ("LON",)]
    assert rows(catalog.categories(db, "N"), "category_id") == [("DER",), ("LON",), ("PEQ",)]
    lists = catalog.drop_downs(db)
    assert lists["account_groups"].first().group_code == "FTC" and lists["statuses"].first().code == "APL"
    assert [lists[k].count() for k in ("user_role", "verifications", "account_groups", "statuses")] == [4, 4, 5, 17]
    shown = {r.product_id: (r.available_from, r.available_till) for r in catalog.catalog_display(db.products).collect()}
    assert shown[1] == ("Unspecified", "Unspecified") and shown[4] == ("2024-01-15", "2024-01-15")
    db = db.replace(product_custom_column_def=table(frame, "product_custom_column_def", []), draft_product_custom_column_def=table(frame, "draft_product_custom_column_def", []))
    assert ids(catalog.product_detail(db)) == [1, 2, 3, 4, 5]
    assert ids(catalog.product_detail(db, "U", 3)) == [1, 2, 3, 4, 5, 6]


def test_sale_of_an_unknown_product_is_refused(spark, frame):
    db = Tables(
        spark, accounts=table(frame, "accounts", [{"account_id": 1}]), products=table(frame, "products", [{"product_id": 5}]),
        applications=table(frame, "applications", []), product_instances=table(frame, "product_instances", []),
    )
    asked = frame(
        "request_id BIGINT, account_id BIGINT, product_id BIGINT, standard_yn STRING, amount_requested DOUBLE, special_notes STRING, collateral STRING",
        [(1, 1, 5, "Y", 1.0, None, None), (2, 1, 6, "Y", 1.0, None, None), (3, 2, 5, "Y", 1.0, None, None)],
    )
    sales = changes.create_sales(db, asked, dt.datetime(2024, 1, 1))
    assert [r.request_id for r in sales.applications.collect()] == [1]
    assert {(r.request_id, r.reason) for r in sales.rejects.collect()} == {(2, "unknown_product"), (3, "unknown_account")}


def test_results_are_put_together_on_demand():
    made = []
    drafts = changes.Drafts(products=lambda: made.append("products") or 1, columns=lambda: made.append("columns") or 2, rejects=lambda: 3)
    assert drafts.products == 1 and drafts.products == 1 and made == ["products"]
