"""Bank-shaped views over the star-schema test tables.

One SELECT text per view, written in the common part of both SQL dialects; ``sql_for`` fills in
the few type names that differ. Test data has no bank tables, so these views stand in for stored
ones. Every view keeps all rows of its source table.

``@name@`` marks another view or raw table.
"""

from __future__ import annotations

import re

from bankspark.sources import schemas

# k, name, visible, populatable, type, default, exercise, available_before
ATTRIBUTE_TEMPLATES = [
    (1, "Entry Fee", "Y", "N", "float", None, None, None),
    (2, "Lead Over Index", "Y", "N", "float", "2.75", None, None),
    (3, "Return Rule", "Y", "N", "varchar", "half of what the index gains", None, None),
    (4, "Swing", "N", "N", "float", "0.418", None, None),
    (5, "Opening Day", "Y", "N", "date", None, "Y", "APR"),
    (6, "Lot Size", "Y", "Y", "integer", "12abc", None, None),
    (7, "Settlement Time", "Y", "N", "datetime", "2024-06-01 12:30:00", None, None),
    (8, "Share Class", "N", "Y", "char", "A", None, None),
    (9, "Remarks", "Y", "Y", "text", "", None, None),
]


_KEYS = "k, column_name, customer_visible_yn, customer_populatable_yn, column_type, default_value, exercise_date_yn, available_before"


def _attribute_rows(row_start: str) -> str:
    def lit(value):
        if value is None:
            return "CAST(NULL AS {str})"
        return str(value) if isinstance(value, int) else "'" + value + "'"

    return ", ".join(row_start + "(" + ", ".join(lit(v) for v in row) + ")" for row in ATTRIBUTE_TEMPLATES)


# Nine definitions for each product: a generator in Spark, a join with literal rows elsewhere.
_SPARK_ATTRIBUTES = f"LATERAL VIEW inline(array({_attribute_rows('struct')})) t AS {_KEYS}"
_PLAIN_ATTRIBUTES = f"CROSS JOIN (VALUES {_attribute_rows('')}) AS t({_KEYS})"

# Status updates and requests spread over a fixed share of the instances, so that the number of
# keys grows with the data.
_EVENT_UID = "300000 + event_id % (SELECT CAST(floor(count(*) / 20) AS BIGINT) FROM @orders@)"

VIEWS: dict[str, str] = {
    "accounts": """
        SELECT c_custkey AS account_id,
               split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name,
               CASE WHEN c_custkey % 10 = 0 THEN NULL
                    ELSE lower(split_part(c_name, '#', 1)) || '.' || split_part(c_name, '#', 2) || '@bank.test'
               END AS email,
               '+359' || right(c_name, 7) AS phone,
               CASE c_nationkey % 3 WHEN 0 THEN 'BGR' WHEN 1 THEN 'USA' ELSE 'OTH' END AS country_code,
               CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Street ' || CAST(c_custkey AS {str}) END AS address,
               CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'U'
                    WHEN c_custkey % 3 = 0 THEN 'A' WHEN c_custkey % 3 = 1 THEN 'C' ELSE 'E' END AS user_role,
               CASE c_custkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'C' END AS verification,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'FTC' WHEN 'BUILDING' THEN 'FTP' WHEN 'FURNITURE' THEN 'RTC'
                    WHEN 'HOUSEHOLD' THEN 'LTP' ELSE 'EMP' END AS account_group,
               CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS {ts}) AS created_dt
        FROM @customer@""",
    "products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'MEDIUM') THEN 'LON'
                    WHEN p_type = 'LARGE' THEN 'PEQ' ELSE 'DER' END AS category_id,
               CASE WHEN p_type IN ('PROMO', 'STANDARD') AND p_size % 7 <> 4
                    THEN CAST(1 + p_size % 7 AS BIGINT) END AS subcategory_id,
               p_name AS name,
               p_name || ' by ' || p_brand AS description,
               'Terms for ' || p_name AS terms_and_conditions,
               CASE p_partkey % 3 WHEN 0 THEN 'BGN' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
               CAST(1 + p_size % 12 AS BIGINT) AS term,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 1024 END AS percentage,
               p_retailprice AS monetary_amount,
               'Rate' AS percentage_label,
               'Amount' AS mon_amt_label,
               CASE WHEN p_partkey % 10 = 0 THEN NULL
                    ELSE CAST(DATE '2023-12-01' + CAST(p_partkey % 60 AS INT) AS {ts}) END AS available_from,
               CASE WHEN p_partkey % 2 = 0 THEN NULL
                    ELSE CAST(DATE '2024-01-05' + CAST(p_partkey % 40 AS INT) AS {ts}) END AS available_till,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS picture_name,
               CASE WHEN p_partkey % 10 = 0 THEN 'Y' ELSE 'N' END AS draft_yn,
               CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 150 END AS draft_owner
        FROM @part@""",
    "applications": """
        SELECT o_orderkey AS application_id,
               o_custkey AS account_id,
               o_orderkey % (SELECT count(*) FROM @part@) AS product_id,
               o_orderdate AS application_dt,
               CASE o_orderpriority WHEN '5-LOW' THEN 'N' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Y' END AS standard_yn,
               o_totalprice AS amount_requested,
               o_orderpriority AS special_notes,
               CASE WHEN o_orderkey % 6 = 0 THEN 'Car' END AS collateral,
               CASE WHEN o_orderstatus = 'F' THEN 'Y' END AS approved_yn,
               CASE WHEN o_orderstatus = 'F' THEN o_custkey % 100 END AS approved_by,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS approval_dt
        FROM @orders@""",
    "product_instances": """
        SELECT 300000 + o_orderkey AS product_uid,
               o_orderkey AS application_id,
               o_custkey AS account_id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 64 AS DOUBLE) / 256 END AS yield,
               CASE o_orderstatus
                    WHEN 'F' THEN CASE o_orderkey % 2 WHEN 0 THEN 'CMP' ELSE 'CNL' END
                    WHEN 'O' THEN CASE o_orderkey % 4 WHEN 2 THEN 'DUE' WHEN 3 THEN 'EXC' ELSE 'NOR' END
                    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'APL' WHEN 1 THEN 'REV' WHEN 2 THEN 'SGN' ELSE 'ORD' END
               END AS status_code,
               CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 4 > 1 THEN o_orderkey + 1 END AS contract_id,
               o_totalprice / 16 AS expected_revenue,
               DATE '2023-07-01' + CAST(o_custkey % 30 AS INT) AS product_start_date,
               DATE '2024-01-01' + CAST(o_custkey % 30 AS INT) AS product_end_date,
               CASE WHEN o_orderkey % 3 = 0 THEN 'handle with care' END AS special_notes,
               CASE WHEN o_orderstatus = 'F' THEN DATE '2024-01-01' + CAST(o_custkey % 30 AS INT) END AS actual_end_date,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 32 END AS actual_revenue,
               o_custkey % 100 AS latest_update_user_id,
               CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'note ' || CAST(o_custkey % 9 AS {str}) END AS latest_note,
               CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'N' ELSE 'Y' END AS latest_note_public_yn,
               CASE o_custkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'Y' ELSE 'N' END AS notifications_yn
        FROM @orders@""",
    "product_status_updates": f"""
        SELECT event_id AS prime_uid,
               {_EVENT_UID} AS product_uid,
               CAST(NULL AS {{str}}) AS was_status,
               CASE event_type WHEN 'signup' THEN 'REV' WHEN 'view' THEN 'APR' WHEN 'click' THEN 'SGN'
                    WHEN 'purchase' THEN 'NOR' ELSE 'CNL' END AS is_code,
               ts AS update_dt,
               user_id AS update_user,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS update_note,
               CASE WHEN event_id % 2 = 0 THEN 'Y' ELSE 'N' END AS update_note_public_yn
        FROM @events@""",
    "product_custom_column_def": """
        SELECT product_id * 10 + k AS pcc_id, product_id, column_name, customer_visible_yn,
               customer_populatable_yn, column_type, default_value, exercise_date_yn, available_before
        FROM @products@ {attributes}
        WHERE category_id = 'DER'""",
    "draft_product_custom_column_def": """
        SELECT product_id, CAST(k - 1 AS BIGINT) AS order_no, column_name, customer_visible_yn,
               customer_populatable_yn, column_type, default_value, exercise_date_yn, available_before
        FROM @products@ {attributes}
        WHERE category_id = 'DER' AND draft_yn = 'Y'""",
    "product_custom_column_values": """
        SELECT pi.product_uid * 10 + d.pcc_id % 10 AS pcc_uid, d.pcc_id, pi.product_uid,
               CASE WHEN d.column_type = 'integer' THEN CASE WHEN pi.product_uid % 2 = 0 THEN pi.product_uid % 50 END END AS int_value,
               CASE WHEN d.column_type = 'float' THEN try_cast(d.default_value AS DOUBLE) END AS float_value,
               CASE WHEN d.column_type IN ('char', 'varchar') THEN d.default_value END AS varchar_value,
               CASE WHEN d.column_type = 'text' THEN d.default_value END AS text_value,
               CASE WHEN d.column_type = 'date' THEN DATE '2024-01-01' + CAST(pi.product_uid % 30 AS INT) END AS date_value,
               CASE WHEN d.column_type = 'datetime' THEN try_cast(d.default_value AS {ts}) END AS datetime_value
        FROM @product_instances@ pi
        JOIN @applications@ ap ON ap.application_id = pi.application_id
        JOIN @product_custom_column_def@ d ON d.product_id = ap.product_id""",
    "status_requests": f"""
        SELECT event_id AS request_id,
               CASE WHEN user_id % 50 = 49 THEN -1 - event_id ELSE {_EVENT_UID} END AS product_uid,
               CASE event_type
                    WHEN 'signup' THEN CASE user_id % 2 WHEN 0 THEN 'REV' ELSE 'AMD' END
                    WHEN 'view' THEN CASE user_id % 2 WHEN 0 THEN 'APR' ELSE 'DUE' END
                    WHEN 'click' THEN CASE user_id % 2 WHEN 0 THEN 'SGN' ELSE 'AGR' END
                    WHEN 'purchase' THEN CASE user_id % 2 WHEN 0 THEN 'AWT' ELSE 'EXC' END
                    ELSE CASE user_id % 9 WHEN 0 THEN 'CNL' WHEN 1 THEN 'DEN' WHEN 2 THEN 'TRG' WHEN 3 THEN 'CMP' ELSE 'NOR' END
               END AS new_status,
               user_id AS update_user,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS note,
               CASE user_id % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS public_yn,
               ts AS request_dt
        FROM @events@""",
    # --- requests and next snapshots ---
    "product_views": """
        SELECT event_id AS request_id, event_id % (SELECT count(*) FROM @part@) AS product_id, user_id AS viewer_id
        FROM @events@""",
    "instance_views": """
        SELECT o_orderkey AS request_id, 300000 + o_orderkey AS product_uid,
               CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE (o_custkey + 1) % (SELECT count(*) FROM @customer@) END AS viewer_id
        FROM @orders@""",
    "search_requests": """
        SELECT s_suppkey AS request_id,
               CASE s_suppkey % 9
                    WHEN 8 THEN ' ' || right(s_name, 7)
                    WHEN 0 THEN right(s_name, 9)
                    WHEN 1 THEN 'CUSTOMER ' || right(s_name, 9)
                    WHEN 2 THEN 'Customer.' || right(s_name, 9) || '@BANK.test'
                    WHEN 3 THEN 'phone:+359' || right(s_name, 7)
                    WHEN 4 THEN 'phone:' || right(s_name, 7)
                    WHEN 5 THEN '  ' || right(s_name, 9) || '   group:FTC  country_code:BGR '
                    WHEN 6 THEN 'group:EMP ' || right(s_name, 9) || ' O-Neill group:FTP'
                    ELSE 'phone:+359 customer.' || right(s_name, 9) || '@bank.test country_code:USA'
               END AS search_str
        FROM @supplier@""",
    "loose_search_requests": """
        SELECT request_id, CASE WHEN request_id % 7 = 0 THEN '  ' WHEN request_id % 11 = 0 THEN 'O-Neill' ELSE search_str END AS search_str
        FROM @search_requests@""",
    "sale_requesters": """
        SELECT request_id, CASE WHEN request_id % 3 = 0 THEN account_id ELSE request_id % 50 END AS user_id,
               CASE request_id % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'A' ELSE 'U' END AS user_role
        FROM @sale_requests@""",
    "part_requesters": """
        SELECT p_partkey AS request_id, CAST(p_size AS BIGINT) AS user_id,
               CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'E' ELSE 'U' END AS user_role
        FROM @part@""",
    "order_requesters": """
        SELECT o_orderkey AS request_id, o_custkey AS user_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'E' ELSE 'U' END AS user_role
        FROM @orders@""",
    "category_patches": """
        SELECT p_partkey AS request_id,
               CASE p_size % 6 WHEN 0 THEN 'LON' WHEN 1 THEN 'PEQ' WHEN 2 THEN 'DER' WHEN 3 THEN 'XXX' ELSE 'LON' END AS category_id,
               CASE WHEN p_size % 5 = 0 THEN 'new ' || p_type END AS category_name,
               CASE WHEN p_size % 7 = 0 THEN p_brand END AS description,
               CASE p_size % 8 WHEN 0 THEN 'Y' WHEN 1 THEN 'x' END AS catalog_yn
        FROM @part@""",
    "subcategory_patches": """
        SELECT p_partkey AS request_id, 1 + p_partkey % 9 AS subcategory_id,
               CASE p_size % 9 WHEN 0 THEN 'LON' WHEN 1 THEN 'ZZZ' END AS category_id,
               CASE WHEN p_size % 5 = 0 THEN 'new ' || p_type END AS subcategory_name,
               CASE p_size % 8 WHEN 0 THEN 'Y' WHEN 3 THEN 'x' END AS catalog_yn
        FROM @part@""",
    "patch_values": """
        SELECT x.request_id, v.pcc_uid, x.request_id AS int_value, CAST(x.request_id AS DOUBLE) / 8 AS float_value,
               'patched' AS varchar_value, 'patched text' AS text_value, DATE '2024-07-01' AS date_value,
               CAST('2024-07-01 10:00:00' AS {ts}) AS datetime_value
        FROM @instance_patches@ x JOIN @product_custom_column_values@ v ON v.product_uid = x.product_uid
        WHERE x.request_id % 3 <> 1""",
    "signups": """
        SELECT s_suppkey AS request_id, 'Customer' AS first_name, right(s_name, 9) AS last_name,
               'new.' || right(s_name, 9) || '@bank.test' AS email, '+1' || right(s_name, 7) AS phone,
               CASE s_nationkey % 3 WHEN 0 THEN 'BGR' WHEN 1 THEN 'USA' ELSE 'OTH' END AS country,
               CASE WHEN s_suppkey % 2 = 0 THEN 'Lane ' || right(s_name, 3) END AS address
        FROM @supplier@""",
    "sale_requests": """
        SELECT event_id AS request_id,
               CASE WHEN event_id % 11 = 0 THEN -1 - user_id ELSE user_id END AS account_id,
               event_id % (SELECT count(*) + 7 FROM @part@) AS product_id,
               CASE event_type WHEN 'view' THEN 'Y' WHEN 'click' THEN 'X' WHEN 'signup' THEN NULL ELSE 'N' END AS standard_yn,
               value AS amount_requested, props AS special_notes,
               CASE WHEN event_type = 'error' THEN 'House' END AS collateral
        FROM @events@""",
    "role_requests": """
        SELECT c_custkey AS request_id,
               CASE WHEN c_custkey % 9 = 0 THEN -1 - c_custkey ELSE CAST(floor(c_custkey / 2) AS BIGINT) END AS account_id,
               CASE c_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'E' WHEN 3 THEN 'U' ELSE 'X' END AS new_role
        FROM @customer@""",
    "account_patches": """
        SELECT c_custkey AS request_id,
               CASE WHEN c_custkey % 13 = 0 THEN -1 - c_custkey ELSE CAST(floor(c_custkey / 2) AS BIGINT) END AS account_id,
               CASE c_nationkey % 4 WHEN 0 THEN '+44' || right(c_name, 7) WHEN 1 THEN '+440000' || c_name END AS phone,
               CASE WHEN c_nationkey % 3 = 0 THEN 'changed' || right(c_name, 9) || '@bank.test' END AS email,
               CASE c_nationkey % 5 WHEN 0 THEN 'BGR' WHEN 1 THEN 'FRA' WHEN 2 THEN 'USA' END AS country_code,
               CASE WHEN c_nationkey % 2 = 0 THEN 'New road ' || right(c_name, 2) END AS address
        FROM @customer@""",
    "product_patches": """
        SELECT p_partkey AS request_id,
               CASE WHEN p_partkey % 17 = 0 THEN -1 - p_partkey ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS product_id,
               CASE WHEN p_size % 3 = 0 THEN 'new ' || p_name END AS name,
               CASE p_size % 4 WHEN 0 THEN '__null__' WHEN 1 THEN '0.25' END AS percentage,
               CASE p_size % 5 WHEN 0 THEN '__null__' WHEN 1 THEN CAST(p_partkey AS {str}) WHEN 2 THEN '12abc' END AS term,
               CASE p_size % 6 WHEN 0 THEN '__null__' WHEN 1 THEN '2024-03-01 00:00:00' END AS available_till
        FROM @part@""",
    "instance_patches": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_orderkey % 19 = 0 THEN -1 - o_orderkey ELSE 300000 + CAST(floor(o_orderkey / 2) AS BIGINT) END AS product_uid,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS amount,
               CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 16 AS DOUBLE) / 128 END AS yield,
               CASE WHEN o_custkey % 4 = 0 THEN DATE '2024-06-01' + CAST(o_custkey % 50 AS INT) END AS product_end_date,
               CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority END AS special_notes
        FROM @orders@""",
    "attribute_requests": """
        SELECT o_orderkey AS request_id, (300000 + o_orderkey) * 10 + o_custkey % 10 AS pcc_uid,
               o_custkey AS int_value, o_totalprice AS float_value, o_orderpriority AS varchar_value,
               CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus END AS text_value,
               DATE '2024-02-01' + CAST(o_custkey % 28 AS INT) AS date_value, o_orderdate AS datetime_value
        FROM @orders@""",
    "clone_requests": """
        SELECT p_partkey AS request_id,
               CASE WHEN p_size = 50 THEN -1 - p_partkey ELSE p_partkey END AS product_id,
               p_partkey % (SELECT count(*) FROM @customer@) AS account_id
        FROM @part@""",
    "publish_requests": """
        SELECT p_partkey AS request_id, p_partkey AS product_id,
               CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'E' ELSE 'U' END AS user_role
        FROM @part@""",
    "draft_column_requests": """
        SELECT p_partkey AS product_id, p_partkey % 150 + p_size % 2 AS user_id,
               CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'E' ELSE 'U' END AS user_role
        FROM @part@""",
    "draft_column_inputs": """
        SELECT product_id, order_no AS input_pos, (order_no * 7) % 5 AS order_no, column_name,
               CASE WHEN order_no % 3 = 0 THEN NULL ELSE customer_visible_yn END AS customer_visible_yn,
               CASE WHEN order_no % 4 = 0 THEN 'x' ELSE customer_populatable_yn END AS customer_populatable_yn,
               column_type, default_value, exercise_date_yn, available_before
        FROM @draft_product_custom_column_def@""",
    "category_requests": """
        SELECT p_partkey AS request_id, upper(p_name) AS category_id, p_name AS category_name, p_type AS description,
               CASE p_size % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' END AS catalog_yn
        FROM @part@""",
    "new_subcategory_requests": """
        SELECT p_partkey AS request_id, CASE p_partkey % 5 WHEN 0 THEN 'XXX' WHEN 1 THEN 'LON' ELSE 'DER' END AS category_id,
               p_name AS subcategory_name, p_type AS subcategory_description,
               CASE p_size % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' END AS catalog_yn
        FROM @part@""",
    "subcategory_requests": """
        SELECT DISTINCT CAST(1 + p_size % 9 AS BIGINT) AS subcategory_id FROM @part@""",
    "sign_requests": """
        SELECT o_orderkey AS request_id, 300000 + CAST(floor(o_orderkey / 2) AS BIGINT) * 2 AS product_uid, o_custkey AS account_id
        FROM @orders@""",
    "group_requests": """
        SELECT c_custkey AS request_id, CAST(floor(c_custkey / 3) AS BIGINT) AS account_id,
               CASE c_nationkey % 4 WHEN 0 THEN 'FTC' WHEN 1 THEN 'RTC' WHEN 2 THEN 'LTP' ELSE 'NEW' END AS new_group
        FROM @customer@""",
    "verification_requests": """
        SELECT c_custkey AS request_id, CAST(floor(c_custkey / 2) AS BIGINT) AS account_id,
               CASE c_nationkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'Q' ELSE 'C' END AS new_code,
               CAST(floor(c_custkey / 2) AS BIGINT) + c_nationkey % 2 AS user_id,
               CASE c_nationkey % 3 WHEN 0 THEN 'E' ELSE 'U' END AS user_role
        FROM @customer@""",
    "preference_requests": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_orderkey % 23 = 0 THEN -1 - o_orderkey ELSE 300000 + CAST(floor(o_orderkey / 2) AS BIGINT) * 2 END AS product_uid,
               o_custkey AS user_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' ELSE 'U' END AS user_role,
               CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE 'P' END END AS preference
        FROM @orders@""",
    "availability_requests": """
        SELECT p_partkey AS request_id,
               CASE WHEN p_partkey % 29 = 0 THEN -1 - p_partkey ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS product_id,
               CASE WHEN p_size % 4 <> 0 THEN CAST(DATE '2024-02-01' + p_size AS {ts}) END AS available_from,
               CASE WHEN p_size % 3 <> 0 THEN CAST(DATE '2024-09-01' + p_size AS {ts}) END AS available_till
        FROM @part@""",
    "new_draft_requests": """
        SELECT p_partkey AS request_id, CAST(p_size AS BIGINT) AS user_id,
               CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'E' ELSE 'U' END AS user_role,
               category_id, subcategory_id, name, description, terms_and_conditions, currency, term, percentage, monetary_amount,
               percentage_label, mon_amt_label, available_from, available_till, picture_name
        FROM @products@ JOIN @part@ ON p_partkey = product_id""",
    "instances_after": """
        SELECT product_uid,
               CASE WHEN account_id % 5 = 0 THEN 'CNL' ELSE status_code END AS status_code,
               account_id % 100 AS latest_update_user_id,
               CASE product_uid % 3 WHEN 0 THEN latest_note WHEN 1 THEN 'changed' END AS latest_note,
               'Y' AS latest_note_public_yn
        FROM @product_instances@""",
}

RAW_TABLES = tuple(schemas.RAW)

_REFERENCE = re.compile(r"@(\w+)@")


def references(name: str) -> list[str]:
    """Views and raw tables that a view reads, in order of first use."""
    return list(dict.fromkeys(_REFERENCE.findall(VIEWS[name])))


def _fill(text: str, string_type: str, timestamp_type: str) -> str:
    return text.replace("{str}", string_type).replace("{ts}", timestamp_type)


def spark_view(name: str) -> str:
    """View text for ``spark.sql(text, **dataframes)``."""
    return _REFERENCE.sub(r"{\1}", _fill(VIEWS[name].replace("{attributes}", _SPARK_ATTRIBUTES), "STRING", "TIMESTAMP_NTZ"))


def plain_view(name: str) -> str:
    """View text over tables of the same names, for another SQL engine."""
    return _REFERENCE.sub(r"\1", _fill(VIEWS[name].replace("{attributes}", _PLAIN_ATTRIBUTES), "VARCHAR", "TIMESTAMP"))
