"""Declared schemas of the bank tables.

Money and rates are DOUBLE and keys BIGINT, so that results keep full precision. Flags stay
'Y'/'N' strings.
"""

from __future__ import annotations

# Schemas in DDL form, as ``spark.read.schema`` and ``from_json`` take them.
TABLES: dict[str, str] = {
    "accounts": (
        "account_id BIGINT, first_name STRING, last_name STRING, email STRING, phone STRING, "
        "country_code STRING, address STRING, user_role STRING, verification STRING, "
        "account_group STRING, created_dt TIMESTAMP_NTZ"
    ),
    "products": (
        "product_id BIGINT, category_id STRING, subcategory_id BIGINT, name STRING, description STRING, "
        "terms_and_conditions STRING, currency STRING, term BIGINT, percentage DOUBLE, "
        "monetary_amount DOUBLE, percentage_label STRING, mon_amt_label STRING, "
        "available_from TIMESTAMP_NTZ, available_till TIMESTAMP_NTZ, picture_name STRING, "
        "draft_yn STRING, draft_owner BIGINT"
    ),
    "applications": (
        "application_id BIGINT, account_id BIGINT, product_id BIGINT, application_dt TIMESTAMP_NTZ, "
        "standard_yn STRING, amount_requested DOUBLE, special_notes STRING, collateral STRING, "
        "approved_yn STRING, approved_by BIGINT, approval_dt TIMESTAMP_NTZ"
    ),
    "product_instances": (
        "product_uid BIGINT, application_id BIGINT, account_id BIGINT, amount DOUBLE, yield DOUBLE, "
        "status_code STRING, contract_id BIGINT, expected_revenue DOUBLE, product_start_date DATE, "
        "product_end_date DATE, special_notes STRING, actual_end_date DATE, actual_revenue DOUBLE, "
        "latest_update_user_id BIGINT, latest_note STRING, latest_note_public_yn STRING, "
        "notifications_yn STRING"
    ),
    "product_status_updates": (
        "prime_uid BIGINT, product_uid BIGINT, was_status STRING, is_code STRING, "
        "update_dt TIMESTAMP_NTZ, update_user BIGINT, update_note STRING, update_note_public_yn STRING"
    ),
    "product_custom_column_def": (
        "pcc_id BIGINT, product_id BIGINT, column_name STRING, customer_visible_yn STRING, "
        "customer_populatable_yn STRING, column_type STRING, default_value STRING, "
        "exercise_date_yn STRING, available_before STRING"
    ),
    "draft_product_custom_column_def": (
        "product_id BIGINT, order_no BIGINT, column_name STRING, customer_visible_yn STRING, "
        "customer_populatable_yn STRING, column_type STRING, default_value STRING, "
        "exercise_date_yn STRING, available_before STRING"
    ),
    "product_custom_column_values": (
        "pcc_uid BIGINT, pcc_id BIGINT, product_uid BIGINT, int_value BIGINT, float_value DOUBLE, "
        "varchar_value STRING, text_value STRING, date_value DATE, datetime_value TIMESTAMP_NTZ"
    ),
    "contracts": "contract_id BIGINT, unsigned_contract STRING, signed_contract STRING",
    "user_roles": "role STRING, description STRING",
    "verifications": "verification_status STRING, description STRING, emoji STRING",
    "account_groups": "group_code STRING, group_name STRING, group_description STRING, default_yn STRING",
    "currencies": "currency_code STRING, currency_name STRING",
    "product_categories": "category_id STRING, category_name STRING, description STRING, catalog_yn STRING",
    "product_subcategories": (
        "subcategory_id BIGINT, category_id STRING, subcategory_name STRING, "
        "subcategory_description STRING, catalog_yn STRING"
    ),
    "product_statuses": (
        "order_no BIGINT, code STRING, status_name STRING, call_to_action STRING, status_description STRING"
    ),
}

# Star-schema test tables that stand in for stored ones. Declared, so that no job reads footers first.
RAW: dict[str, str] = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

MENU = (
    "displayName STRING, icon STRING, privileges ARRAY<STRING>, dataGroup STRING, "
    "children ARRAY<STRUCT<displayName: STRING, url: STRING, privileges: ARRAY<STRING>>>"
)

# One contract element: a paragraph, a table of (label, value) rows, or nothing.
CONTRACT_ELEMENT = "kind STRING, text STRING, data ARRAY<ARRAY<STRING>>"
