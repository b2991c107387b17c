"""The registered queries in plain SQL, written from the rules and not from the DataFrame code.

Each text carries the views it reads as CTEs over the raw tables.
"""

from __future__ import annotations

import re

from bankspark.sources import clauses, dims, mapping

ORACLES: dict[str, str] = {}


def _cte_order(select: str) -> list[str]:
    """Views and dimensions named in a text, with those they read, sources first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in mapping.VIEWS:
            for ref in mapping.references(name):
                visit(ref)
            done.append(name)
        elif name in dims.DIMENSION_NAMES:
            done.append(name)

    for word in dict.fromkeys(re.findall(r"\w+", select)):
        visit(word)
    return done


def oracle(name: str, select: str, ctes: str = "", recursive: bool = False) -> None:
    """Register ``select``; ``ctes`` are further comma-separated CTEs it reads."""
    parts = [
        f"{view} AS ({dims.dimension_sql(view, 'VARCHAR') if view in dims.DIMENSION_NAMES else mapping.plain_view(view)})"
        for view in _cte_order(ctes + " " + select)
    ]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else ""
    ORACLES[name] = head + select


DAY = "DATE '2024-01-15'"
TIME = "TIMESTAMP '2024-01-15 10:00:00'"
STAFF = "('A', 'C', 'E')"

# --- catalogue ---------------------------------------------------------------------------------

_PRODUCT = """
    p.product_id, p.category_id, pc.category_name, p.name, p.description, p.terms_and_conditions, p.currency, p.term,
    p.percentage, p.monetary_amount, p.percentage_label, p.mon_amt_label, p.available_from, p.available_till,
    coalesce(p.picture_name, p.category_id) AS picture_name, p.subcategory_id, p.draft_yn, p.draft_owner
    FROM products p JOIN product_categories pc ON pc.category_id = p.category_id"""

oracle("catalog_active", f"""
SELECT {_PRODUCT}
WHERE p.draft_yn = 'N' AND p.available_from <= {TIME} AND coalesce(p.available_till, {TIME}) >= {TIME}""")
oracle("catalog_all", f"SELECT {_PRODUCT}")
oracle("catalog_display", """
SELECT product_id, coalesce(strftime(available_from, '%Y-%m-%d'), 'Unspecified') AS available_from,
       coalesce(strftime(available_till, '%Y-%m-%d'), 'Unspecified') AS available_till
FROM products WHERE draft_yn = 'N'""")
oracle("drafts_by_owner", f"SELECT {_PRODUCT} WHERE p.draft_yn = 'Y'")
oracle("drafts_preview", """
SELECT * FROM (SELECT p.draft_owner, p.product_id, p.name, pc.category_name,
  row_number() OVER (PARTITION BY p.draft_owner ORDER BY p.product_id) AS rn
  FROM products p JOIN product_categories pc ON pc.category_id = p.category_id WHERE p.draft_yn = 'Y') WHERE rn <= 3""")
oracle("product_terms", """
SELECT product_id, CAST(term AS VARCHAR) || ' month(s)' AS term, percentage_label, printf('%.2f', round(100 * percentage, 2)) || '%' AS percentage,
       mon_amt_label, currency || printf('%.2f', round(monetary_amount, 2)) AS monetary_amount
FROM products""")

_DETAIL = """
SELECT p.product_id, p.category_id, pc.category_name, p.name, p.description, p.terms_and_conditions, p.percentage_label, p.mon_amt_label, p.currency, p.term, p.percentage,
       p.monetary_amount, p.available_from, p.available_till, coalesce(p.picture_name, p.category_id) AS picture_name,
       p.draft_yn, p.draft_owner, a.attr_id, a.column_name, a.customer_visible_yn, a.customer_populatable_yn,
       a.column_type, a.default_value, a.exercise_date_yn, a.available_before
FROM products p LEFT JOIN product_categories pc ON pc.category_id = p.category_id LEFT JOIN attrs a ON a.product_id = p.product_id
  AND CASE WHEN p.draft_yn = 'Y' THEN a.src = 'draft' ELSE a.src = 'final' END"""
_DEFS = "column_name, customer_visible_yn, customer_populatable_yn, column_type, default_value, exercise_date_yn, available_before"
oracle("product_detail", _DETAIL, f"""
attrs AS (SELECT 'final' AS src, product_id, pcc_id AS attr_id, {_DEFS} FROM product_custom_column_def
          UNION ALL SELECT 'draft', product_id, order_no, {_DEFS} FROM draft_product_custom_column_def)""")
oracle("product_detail_public", _DETAIL + " WHERE p.draft_yn <> 'Y'", f"""
attrs AS (SELECT 'final' AS src, product_id, pcc_id AS attr_id, {_DEFS} FROM product_custom_column_def
          WHERE customer_visible_yn = 'Y')""")
oracle("publishable_attributes", """
SELECT product_id, pcc_id, column_name, default_value FROM product_custom_column_def
WHERE default_value IS NOT NULL AND default_value <> '' AND customer_visible_yn = 'Y'""")
oracle("subcategory_counts", """
SELECT DISTINCT ps.subcategory_id, ps.category_id, ps.subcategory_name, ps.subcategory_description, ps.catalog_yn,
       count(p.product_id) OVER (PARTITION BY ps.subcategory_id) AS product_count
FROM product_subcategories ps LEFT JOIN products p ON p.subcategory_id = ps.subcategory_id""")
oracle("subcategory_labels", """
SELECT p.product_id, s.subcategory_id,
       CASE WHEN s.catalog_yn = 'N' THEN s.subcategory_name || ' (Not in Catalog)' ELSE s.subcategory_name END AS display_name,
       CASE WHEN p.subcategory_id IS NOT DISTINCT FROM s.subcategory_id THEN 'Y' ELSE 'N' END AS chosen_yn
FROM products p JOIN product_subcategories s ON s.category_id = p.category_id""")
oracle("edit_privilege", """
SELECT v.request_id, v.product_id, v.viewer_id,
       CASE WHEN p.draft_yn = 'Y' THEN CASE WHEN p.draft_owner = v.viewer_id OR a.user_role IN ('A', 'C') THEN 'all' ELSE 'preview' END
            ELSE CASE a.user_role WHEN 'A' THEN 'properties' WHEN 'C' THEN 'availability' ELSE 'preview' END END AS privilege
FROM product_views v JOIN products p ON p.product_id = v.product_id JOIN accounts a ON a.account_id = v.viewer_id""")

# --- accounts ----------------------------------------------------------------------------------

_PROFILE = """
SELECT a.account_id, a.first_name, a.last_name, a.email, a.phone, a.country_code,
       CASE a.country_code WHEN 'BGR' THEN 'Bulgaria' WHEN 'USA' THEN 'United States' WHEN 'OTH' THEN 'Other' ELSE a.country_code END AS country,
       a.address, a.user_role AS user_role_code, ur.description AS user_role, a.verification AS verification_code,
       v.description AS verification, v.emoji AS verification_emoji, a.account_group AS account_group_code,
       ag.group_name AS account_group, ag.group_description AS account_group_description, a.created_dt
FROM accounts a JOIN user_roles ur ON ur.role = a.user_role JOIN verifications v ON v.verification_status = a.verification
JOIN account_groups ag ON ag.group_code = a.account_group"""
oracle("account_profile", _PROFILE)
oracle("accounts_filtered", _PROFILE + """
WHERE a.country_code IN ('BGR', 'USA') AND a.user_role IN ('U', 'E') AND a.verification IN ('Y', 'N')""")
oracle("unverified_accounts", _PROFILE + " WHERE a.verification IN ('N', 'C')")
oracle("staff_accounts", _PROFILE + f" WHERE a.user_role IN {STAFF}")
oracle("country_label", """
SELECT account_id, country_code, CASE country_code WHEN 'BGR' THEN 'Bulgaria' WHEN 'USA' THEN 'United States' ELSE 'Other' END AS country
FROM accounts""")
oracle("verification_badge", """
SELECT account_id, verification AS verification_code,
       CASE verification WHEN 'Y' THEN '✅' WHEN 'N' THEN '🟡' WHEN 'C' THEN '📩' WHEN 'R' THEN '🚫' END AS verification_emoji
FROM accounts""")
_SHOWN = """a.account_id, a.first_name, a.last_name, a.email, a.phone, a.verification AS verification_code,
       v.emoji AS verification_emoji, a.account_group AS account_group_code, ag.group_name AS account_group_name"""
_SHOWN_WITH = """JOIN account_groups ag ON ag.group_code = a.account_group JOIN verifications v ON v.verification_status = a.verification"""
_CRITERION = "(len(q.names) > 0 OR coalesce(CAST(q.id AS VARCHAR), q.email, q.grp, q.country, q.phone) IS NOT NULL)"
_PARSED = r"""
words AS (SELECT request_id, string_split_regex(trim(search_str), '\s+') AS w FROM search_requests),
parsed AS (SELECT request_id, CASE WHEN len(w) = 1 AND regexp_full_match(w[1], '[0-9]{7}') THEN CAST(w[1] AS BIGINT) END AS id,
    [lower(x) FOR x IN w IF regexp_full_match(x, '[a-zA-Z0-9]+') AND NOT (len(w) = 1 AND regexp_full_match(x, '[0-9]{7}'))] AS names,
    ([x FOR x IN w IF regexp_full_match(x, '[\w.]+@([\w-]+\.)+[\w-]{2,4}')])[-1] AS email,
    split_part(([x FOR x IN w IF regexp_full_match(x, 'group:[A-Z]{1,3}')])[-1], ':', 2) AS grp,
    split_part(([x FOR x IN w IF regexp_full_match(x, 'country_code:[A-Z]{1,3}')])[-1], ':', 2) AS country,
    split_part(([x FOR x IN w IF regexp_full_match(x, 'phone:[+0-9]{4,15}')])[-1], ':', 2) AS phone
  FROM words)"""


def _search(accounts: str) -> str:
    return f"""
SELECT q.request_id, {_SHOWN}
FROM parsed q JOIN {accounts} a ON
     (q.id IS NULL OR a.account_id = q.id) AND
     (len(q.names) = 0 OR (len(q.names) = 1 AND (list_contains(q.names, lower(a.first_name)) OR list_contains(q.names, lower(a.last_name))))
       OR (len(q.names) > 1 AND list_contains(q.names, lower(a.first_name)) AND list_contains(q.names, lower(a.last_name))))
 AND (q.email IS NULL OR lower(a.email) = lower(q.email)) AND (q.grp IS NULL OR upper(a.account_group) = q.grp)
 AND (q.country IS NULL OR upper(a.country_code) = q.country) AND (q.phone IS NULL OR a.phone LIKE '%' || q.phone || '%')
 AND ({_CRITERION} OR a.account_id <> 1)
{_SHOWN_WITH}"""


oracle("account_search", _search("accounts"), _PARSED)
_LOOSE = _PARSED.replace("search_requests", "loose_search_requests")
oracle("account_search_index", _search("accounts") + f" WHERE {_CRITERION}", _LOOSE)
oracle("account_search_changed", _search("accounts_after") + f" WHERE {_CRITERION}", _PARSED + """,
asked_groups AS (SELECT account_id, arg_max(new_group, request_id) AS new_group FROM group_requests
  WHERE new_group IN (SELECT group_code FROM account_groups) GROUP BY account_id),
accounts_after AS (SELECT o.* REPLACE (coalesce(g.new_group, o.account_group) AS account_group)
  FROM accounts o LEFT JOIN asked_groups g ON g.account_id = o.account_id)""")
oracle("account_search_unrestricted", f"SELECT request_id FROM parsed q WHERE NOT {_CRITERION}", _LOOSE)
oracle("account_search_everyone", f"SELECT {_SHOWN} FROM accounts a {_SHOWN_WITH} WHERE a.account_id <> 1")

_NEW_ACCOUNTS = f"""
new_accounts AS (SELECT request_id, first_name, last_name, email, phone, country AS country_code, address, 'U' AS user_role,
    'N' AS verification, 'FTC' AS account_group, {TIME} AS created_dt,
    greatest((SELECT max(account_id) FROM accounts), 1999999) + row_number() OVER (ORDER BY request_id) AS account_id
  FROM signups)"""
oracle("new_accounts", "SELECT * FROM new_accounts", _NEW_ACCOUNTS)
oracle("latest_account_by_name", """
SELECT first_name, last_name, account_id FROM (
  SELECT first_name, last_name, account_id, row_number() OVER (PARTITION BY first_name, last_name ORDER BY account_id DESC) AS n
  FROM (SELECT first_name, last_name, account_id FROM accounts UNION ALL SELECT first_name, last_name, account_id FROM new_accounts))
WHERE n = 1""", _NEW_ACCOUNTS)
oracle("role_groups", f"""
SELECT account_id, new_role AS user_role, CASE WHEN new_role IN {STAFF} THEN 'EMP' ELSE 'FTC' END AS account_group
FROM (SELECT r.*, row_number() OVER (PARTITION BY account_id ORDER BY request_id DESC) AS n FROM role_requests r
      WHERE new_role IN (SELECT role FROM user_roles) AND account_id IN (SELECT account_id FROM accounts))
WHERE n = 1""")
oracle("role_rejects", """
SELECT request_id, account_id,
       CASE WHEN account_id NOT IN (SELECT account_id FROM accounts) THEN 'unknown_account' ELSE 'unknown_role' END AS reason
FROM role_requests
WHERE account_id NOT IN (SELECT account_id FROM accounts) OR new_role NOT IN (SELECT role FROM user_roles)""")

oracle("group_changes", """
SELECT account_id, arg_max(new_group, request_id) AS account_group FROM group_requests
WHERE new_group IN (SELECT group_code FROM account_groups) AND account_id IN (SELECT account_id FROM accounts) GROUP BY account_id""")
_MAY_VERIFY = "(user_role IN ('A', 'C', 'E') OR (new_code = 'C' AND user_id = account_id))"
oracle("verification_changes", f"""
SELECT account_id, arg_max(new_code, request_id) AS verification FROM verification_requests
WHERE {_MAY_VERIFY} AND new_code IN (SELECT verification_status FROM verifications) GROUP BY account_id""")
oracle("verification_rejects", f"""
SELECT request_id, account_id, CASE WHEN NOT {_MAY_VERIFY} THEN 'not_allowed' ELSE 'unknown_verification' END AS reason
FROM verification_requests WHERE NOT {_MAY_VERIFY} OR new_code NOT IN (SELECT verification_status FROM verifications)""")

# --- instances ---------------------------------------------------------------------------------

_CARD = """
pi.product_uid, pi.application_id, pi.contract_id, appl.approved_by, p.name, p.description,
coalesce(pi.amount, appl.amount_requested) AS amount, pi.status_code, ps.status_name, p.category_id, p.currency,
ac.first_name, ac.last_name, ac.account_id, coalesce(p.picture_name, p.category_id) AS picture_name"""
_CARD_FROM = """
FROM product_instances pi JOIN applications appl ON appl.application_id = pi.application_id
JOIN accounts ac ON ac.account_id = pi.account_id JOIN products p ON p.product_id = appl.product_id
JOIN product_statuses ps ON ps.code = pi.status_code"""
oracle("product_cards", f"SELECT {_CARD} {_CARD_FROM}")
oracle("account_products", f"SELECT * EXCLUDE (first_name, last_name) FROM (SELECT {_CARD} {_CARD_FROM})")
oracle("instances_filtered", f"SELECT {_CARD} {_CARD_FROM} WHERE pi.status_code IN ('NOR', 'DUE', 'EXC', 'ORD')")
oracle("applications_queue", f"SELECT {_CARD} {_CARD_FROM} WHERE pi.status_code = 'APL'")


def _owners(stamp: str) -> str:
    return f"""
owners AS (SELECT DISTINCT product_uid, update_user AS updater_id FROM (
    SELECT psu.product_uid, psu.update_user, rank() OVER (PARTITION BY psu.product_uid ORDER BY {stamp} DESC) AS rnk
    FROM product_status_updates psu JOIN accounts st ON st.account_id = psu.update_user AND st.user_role IN {STAFF}
     AND st.account_id NOT IN (1, 2000000)) WHERE rnk = 1)"""


_ASSIGNED = f"SELECT o.updater_id, {_CARD} {_CARD_FROM} JOIN owners o ON o.product_uid = pi.product_uid"
oracle("assigned_instances", _ASSIGNED, _owners("psu.update_dt"))
oracle("assigned_instances_ties", _ASSIGNED, _owners("date_trunc('day', psu.update_dt)"))
oracle("active_counts", f"""
SELECT updater_id, count(*) FILTER (WHERE status_code NOT IN ('CNL', 'CMP', 'WOF', 'DEN')) AS active,
       least(3, count(*)) AS preview, count(*) AS total
FROM ({_ASSIGNED}) GROUP BY updater_id""", _owners("psu.update_dt"))
oracle("worklist_preview", f"""
SELECT * FROM (SELECT updater_id, product_uid, name, status_name,
  row_number() OVER (PARTITION BY updater_id ORDER BY product_uid) AS rn FROM ({_ASSIGNED})) WHERE rn <= 3""", _owners("psu.update_dt"))
oracle("visible_instances", f"""
SELECT v.request_id, v.viewer_id, pi.product_uid, pi.status_code, pi.amount,
       CASE WHEN ac.user_role IN {STAFF} THEN pi.actual_revenue END AS actual_revenue,
       CASE WHEN ac.user_role IN {STAFF} THEN pi.expected_revenue END AS expected_revenue
FROM instance_views v JOIN product_instances pi ON pi.product_uid = v.product_uid JOIN accounts ac ON ac.account_id = v.viewer_id
WHERE ac.user_role IN {STAFF} OR pi.account_id = v.viewer_id""")
oracle("instance_detail", """
SELECT pi.product_uid, pi.account_id, pi.status_code, ps.status_name, ps.status_description, pi.amount, pi.contract_id,
       pi.product_start_date, pi.product_end_date, pi.actual_end_date, pi.special_notes, pi.application_id, appl.approved_by,
       appl.amount_requested, appl.special_notes AS appl_special_notes, appl.collateral, appl.approved_yn, appl.approval_dt,
       pi.yield, appl.product_id, CASE WHEN appl.standard_yn = 'Y' THEN 'Standard' ELSE 'Custom' END AS standard,
       pi.notifications_yn AS notifications, pi.actual_revenue, pi.expected_revenue
FROM product_instances pi LEFT JOIN applications appl ON appl.application_id = pi.application_id
JOIN product_statuses ps ON ps.code = pi.status_code""")

_LOG = """
log AS (SELECT pi.product_uid, CAST(0 AS BIGINT) AS prime_uid, ps.code AS is_code, ps.status_name, ps.status_description,
      appl.account_id AS update_user, appl.application_dt AS update_dt, NULL AS update_note, NULL AS update_note_public_yn
    FROM applications appl JOIN product_instances pi ON pi.application_id = appl.application_id JOIN product_statuses ps ON ps.code = 'APL'
    UNION ALL
    SELECT psu.product_uid, psu.prime_uid, psu.is_code, ps.status_name, ps.status_description, psu.update_user, psu.update_dt,
      psu.update_note, psu.update_note_public_yn
    FROM product_status_updates psu JOIN product_statuses ps ON ps.code = psu.is_code)"""
_TIMELINE = """
SELECT log.product_uid, log.prime_uid, log.is_code, log.status_name, log.status_description, log.update_dt, log.update_user,
       ac.first_name, ac.last_name, CASE WHEN {readable} THEN nullif(log.update_note, '') END AS note,
       CASE WHEN {readable} THEN log.update_note_public_yn END AS public_yn,
       CASE WHEN row_number() OVER (PARTITION BY log.product_uid ORDER BY log.update_dt DESC, log.prime_uid DESC) = 1 THEN 'Y' ELSE 'N' END AS is_current
FROM log LEFT JOIN accounts ac ON ac.account_id = log.update_user"""
oracle("status_timeline", _TIMELINE.format(readable="TRUE"), _LOG)
oracle("status_timeline_public", _TIMELINE.format(readable="log.update_note_public_yn = 'Y'"), _LOG)
oracle("instance_nested", """
SELECT product_uid, CAST(0 AS BIGINT) AS page_no, count(*) AS n_statuses,
       string_agg(is_code || '|' || coalesce(CASE WHEN update_note_public_yn = 'Y' THEN nullif(update_note, '') END, '-') || '|' || prime_uid, ';'
                  ORDER BY update_dt, prime_uid) AS statuses
FROM log GROUP BY product_uid""", _LOG)
oracle("attributes_nested", """
SELECT v.product_uid, CAST(0 AS BIGINT) AS page_no, count(*) AS n_columns,
       string_agg(v.pcc_uid || '|' || d.column_name, ';' ORDER BY v.pcc_uid) AS columns
FROM product_custom_column_values v JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id
WHERE d.customer_visible_yn = 'Y' GROUP BY v.product_uid""")
_PICK = """CASE d.column_type WHEN 'integer' THEN CAST(v.int_value AS VARCHAR) WHEN 'varchar' THEN v.varchar_value
            WHEN 'char' THEN v.varchar_value WHEN 'text' THEN v.text_value WHEN 'date' THEN strftime(v.date_value, '%B %d, %Y')
            WHEN 'datetime' THEN strftime(v.datetime_value, '%B %d, %Y %H:%M:%S') END"""
oracle("attribute_values", f"""
SELECT v.product_uid, v.pcc_uid, d.column_name, {_PICK} AS value, v.float_value AS number
FROM product_custom_column_values v JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id WHERE d.customer_visible_yn = 'Y'""")
oracle("attributes_wide", f"""
SELECT product_uid, max(value) FILTER (WHERE column_name = 'Return Rule') AS pay_off_formula,
       max(value) FILTER (WHERE column_name = 'Opening Day') AS first_observation_date,
       max(value) FILTER (WHERE column_name = 'Share Class') AS share_class
FROM (SELECT v.product_uid, d.column_name, {_PICK} AS value
      FROM product_custom_column_values v JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id)
GROUP BY product_uid""")

# --- lifecycle ---------------------------------------------------------------------------------

oracle("next_actions", """
SELECT pi.product_uid, n.pos, n.to_status AS status_code, ps.call_to_action AS status_name, ps.status_description
FROM product_instances pi JOIN next_status n ON n.from_status = pi.status_code JOIN product_statuses ps ON ps.code = n.to_status""")
oracle("progression", """
SELECT pi.product_uid, n.pos, n.to_status AS status_code, ps.status_name, ps.status_description
FROM product_instances pi JOIN progression n ON n.from_status = pi.status_code JOIN product_statuses ps ON ps.code = n.to_status""")
oracle("client_actions", """
SELECT pi.product_uid, n.pos, n.to_status AS status_code, ps.call_to_action AS status_name,
       CASE WHEN n.to_status = 'AWT' THEN 'N' ELSE 'Y' END AS accepted_yn
FROM product_instances pi JOIN next_status n ON n.from_status = pi.status_code JOIN product_statuses ps ON ps.code = n.to_status
WHERE n.to_status IN ('AWT', 'AGR', 'DIS', 'CNL')""")


def _fold(accepted: str) -> str:
    """Requests one after another: the state before a request is the state the one before left."""
    return f"""
numbered AS (SELECT r.*, pi.status_code AS start_status, pi.latest_note AS start_note, pi.product_uid IS NOT NULL AS known,
      row_number() OVER (PARTITION BY r.product_uid ORDER BY r.request_dt, r.request_id) AS n
    FROM status_requests r LEFT JOIN product_instances pi ON pi.product_uid = r.product_uid),
walk AS (
    SELECT s.*, CASE WHEN ok THEN new_status ELSE was END AS status, CASE WHEN ok AND note IS NOT NULL THEN note ELSE old_note END AS kept_note
    FROM (SELECT m.*, m.start_status AS was, m.start_note AS old_note,
            EXISTS (SELECT 1 FROM next_status e WHERE e.from_status = m.start_status AND e.to_status = m.new_status) AS edge,
            EXISTS (SELECT 1 FROM next_status e WHERE e.from_status = m.start_status AND e.to_status = m.new_status) {accepted} AS ok
          FROM numbered m WHERE m.n = 1) s
    UNION ALL
    SELECT s.*, CASE WHEN ok THEN new_status ELSE was END, CASE WHEN ok AND note IS NOT NULL THEN note ELSE old_note END
    FROM (SELECT m.*, w.status AS was, w.kept_note AS old_note,
            EXISTS (SELECT 1 FROM next_status e WHERE e.from_status = w.status AND e.to_status = m.new_status) AS edge,
            EXISTS (SELECT 1 FROM next_status e WHERE e.from_status = w.status AND e.to_status = m.new_status) {accepted} AS ok
          FROM walk w JOIN numbered m ON m.product_uid = w.product_uid AND m.n = w.n + 1) s)"""


_STAFF_FOLD = _fold("")
oracle("apply_status", """
SELECT pi.product_uid, coalesce(l.status, pi.status_code) AS status_code, coalesce(u.update_user, pi.latest_update_user_id) AS latest_update_user_id,
       coalesce(l.kept_note, pi.latest_note) AS latest_note,
       CASE WHEN t.n IS NULL THEN pi.latest_note_public_yn WHEN t.public_yn = 'Y' THEN 'Y' ELSE 'N' END AS latest_note_public_yn
FROM product_instances pi
LEFT JOIN (SELECT * FROM walk QUALIFY n = max(n) OVER (PARTITION BY product_uid)) l ON l.product_uid = pi.product_uid
LEFT JOIN (SELECT * FROM walk WHERE ok QUALIFY n = max(n) OVER (PARTITION BY product_uid)) u ON u.product_uid = pi.product_uid
LEFT JOIN (SELECT * FROM walk WHERE ok AND note IS NOT NULL QUALIFY n = max(n) OVER (PARTITION BY product_uid)) t ON t.product_uid = pi.product_uid""",
       _STAFF_FOLD, recursive=True)
oracle("apply_status_fold", """
SELECT product_uid, request_id, was AS was_status, new_status AS is_code, request_dt AS update_dt, update_user,
       CASE WHEN old_note <> note THEN note END AS update_note,
       CASE WHEN old_note <> note THEN CASE WHEN public_yn = 'Y' THEN 'Y' ELSE 'N' END END AS update_note_public_yn
FROM walk WHERE ok""", _STAFF_FOLD, recursive=True)
oracle("apply_status_rejects", """
SELECT request_id, product_uid, CASE WHEN known THEN 'transition_not_allowed' ELSE 'unknown_instance' END AS reason
FROM walk WHERE NOT ok""", _STAFF_FOLD, recursive=True)
oracle("apply_status_approvals", """
SELECT a.application_id, CASE WHEN w.n IS NULL THEN a.approved_yn WHEN w.new_status = 'APR' THEN 'Y' ELSE 'N' END AS approved_yn,
       CASE WHEN w.n IS NULL THEN a.approved_by ELSE w.update_user END AS approved_by,
       CASE WHEN w.n IS NULL THEN a.approval_dt ELSE w.request_dt END AS approval_dt
FROM applications a LEFT JOIN product_instances pi ON pi.application_id = a.application_id
LEFT JOIN (SELECT * FROM walk WHERE ok AND new_status IN ('APR', 'DEN') QUALIFY n = max(n) OVER (PARTITION BY product_uid)) w
  ON w.product_uid = pi.product_uid""", _STAFF_FOLD, recursive=True)
oracle("apply_client_status", """
SELECT product_uid, request_id, was, new_status, ok,
       CASE WHEN NOT known THEN 'unknown_instance' WHEN NOT edge THEN 'transition_not_allowed' WHEN NOT ok THEN 'not_a_client_action' END AS reason
FROM walk""", _fold("AND m.new_status IN ('CNL', 'AGR', 'DIS')"), recursive=True)
oracle("audit_rows", f"""
SELECT o.product_uid, o.status_code AS was_status, n.status_code AS is_code, {TIME} AS update_dt, n.latest_update_user_id AS update_user,
       CASE WHEN o.latest_note <> n.latest_note THEN n.latest_note END AS update_note,
       CASE WHEN o.latest_note <> n.latest_note THEN n.latest_note_public_yn END AS update_note_public_yn
FROM product_instances o JOIN instances_after n ON n.product_uid = o.product_uid WHERE o.status_code <> n.status_code""")

_EXERCISE = """product_uid IN (SELECT v.product_uid FROM {values} v JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id
  WHERE d.exercise_date_yn = 'Y' AND v.date_value = {day})"""
_BEFORE = "DATE '2024-01-14'"
_WEEK_BEFORE = "DATE '2024-01-08'"
oracle("sweep_due", f"""
SELECT product_uid, status_code AS was_status, 'DUE' AS is_code FROM product_instances WHERE status_code = 'NOR' AND product_end_date = {DAY}""")
oracle("sweep_overdue", f"""
SELECT product_uid, status_code AS was_status, 'ORD' AS is_code FROM product_instances WHERE status_code = 'DUE' AND product_end_date = {_WEEK_BEFORE}""")
oracle("sweep_exercise", f"""
SELECT product_uid, status_code AS was_status, 'EXC' AS is_code FROM product_instances
WHERE status_code = 'NOR' AND {_EXERCISE.format(values='product_custom_column_values', day=DAY)}""")
oracle("sweep_back", f"""
SELECT product_uid, status_code AS was_status, 'NOR' AS is_code FROM product_instances
WHERE status_code = 'EXC' AND {_EXERCISE.format(values='product_custom_column_values', day=_BEFORE)}""")

_NIGHT_STEPS = [
    ("due", "NOR", "DUE", f"product_end_date = {DAY}"),
    ("overdue", "DUE", "ORD", f"product_end_date = {_WEEK_BEFORE}"),
    ("exercise", "NOR", "EXC", _EXERCISE.format(values="both_days", day=DAY)),
    ("back_to_normal", "EXC", "NOR", _EXERCISE.format(values="both_days", day=_BEFORE)),
]
_NIGHT = """
both_days AS (SELECT pcc_id, product_uid, date_value FROM product_custom_column_values
    UNION ALL SELECT pcc_id, product_uid, date_value + 1 FROM product_custom_column_values WHERE date_value IS NOT NULL),
step0 AS (SELECT product_uid, product_end_date, status_code, latest_update_user_id, latest_note FROM product_instances)"""
for _i, (_name, _from, _to, _hit) in enumerate(_NIGHT_STEPS):
    _NIGHT += f""",
hit{_i} AS (SELECT product_uid FROM step{_i} WHERE status_code = '{_from}' AND {_hit}),
step{_i + 1} AS (SELECT s.product_uid, s.product_end_date, CASE WHEN h.product_uid IS NULL THEN s.status_code ELSE '{_to}' END AS status_code,
    CASE WHEN h.product_uid IS NULL THEN s.latest_update_user_id ELSE 1 END AS latest_update_user_id,
    CASE WHEN h.product_uid IS NULL THEN s.latest_note END AS latest_note
  FROM step{_i} s LEFT JOIN hit{_i} h ON h.product_uid = s.product_uid)"""
_NIGHT_AUDIT = " UNION ALL ".join(
    f"SELECT product_uid, '{name}' AS step, '{src}' AS was_status, '{to}' AS is_code FROM hit{i}"
    for i, (name, src, to, _) in enumerate(_NIGHT_STEPS)
)
oracle("nightly_status", "SELECT product_uid, status_code, latest_update_user_id, latest_note FROM step4", _NIGHT)
oracle("nightly_audit", _NIGHT_AUDIT, _NIGHT)
oracle("sweep_summary", f"SELECT step, count(*) AS n_rows FROM ({_NIGHT_AUDIT}) GROUP BY step", _NIGHT)

# --- notices -----------------------------------------------------------------------------------

_MESSAGE = "pi.product_uid, ac.email, ac.first_name, ac.last_name, p.name AS product_name, ps.status_name"
_MESSAGE_FROM = """
FROM product_instances pi JOIN accounts ac ON ac.account_id = pi.account_id
JOIN applications appl ON appl.application_id = pi.application_id JOIN products p ON p.product_id = appl.product_id"""
_ON_CHANGE = f"""
SELECT u.prime_uid AS change_id, {_MESSAGE}, CASE WHEN u.is_code = 'APL' THEN 'received' ELSE 'update' END AS template
{_MESSAGE_FROM} JOIN product_status_updates u ON u.product_uid = pi.product_uid JOIN product_statuses ps ON ps.code = u.is_code
WHERE pi.notifications_yn = 'Y' OR (pi.notifications_yn = 'P' AND u.is_code IN ("""
oracle("status_notifications", _ON_CHANGE + "'AMD','APR','DEN','CNL','SGN','NOR','TRG','DUE','ORD','CMP'))")
oracle("status_notifications_client", _ON_CHANGE + "'CNL'))")
oracle("notify_due", f"""
SELECT {_MESSAGE}, p.category_id, CASE WHEN p.category_id = 'DER' THEN 'exercise' ELSE 'due' END AS template
{_MESSAGE_FROM} JOIN product_statuses ps ON ps.code = pi.status_code
WHERE (pi.product_end_date = {DAY} AND pi.status_code = 'DUE') OR pi.status_code = 'EXC'""")
oracle("notify_overdue", f"""
SELECT {_MESSAGE}, pi.product_end_date AS due_since, 'overdue' AS template
{_MESSAGE_FROM} JOIN product_statuses ps ON ps.code = pi.status_code WHERE pi.status_code = 'ORD' AND p.category_id <> 'DER'""")

# --- changes -----------------------------------------------------------------------------------

oracle("fk_rejects", """
SELECT request_id, 'unknown_account' AS constraint_name, CAST(account_id AS VARCHAR) AS value FROM sale_requests r
WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = r.account_id)
UNION ALL
SELECT request_id, 'unknown_product', CAST(product_id AS VARCHAR) FROM sale_requests r
WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = r.product_id)""")
oracle("append_ids", """
SELECT product_uid, is_code, update_dt, prime_uid AS source_uid,
       greatest((SELECT max(prime_uid) FROM product_status_updates), 4999) + row_number() OVER (ORDER BY update_dt, prime_uid) AS prime_uid
FROM product_status_updates""")
oracle("new_sales", """
SELECT r.request_id, (SELECT max(application_id) FROM applications) + n AS application_id, r.product_id,
       CASE WHEN r.standard_yn IN ('Y', 'N') THEN r.standard_yn ELSE 'N' END AS standard_yn, r.amount_requested, r.collateral,
       greatest((SELECT max(product_uid) FROM product_instances), 299999) + n AS product_uid, r.account_id, 'APL' AS status_code,
       '' AS latest_note, 'P' AS notifications_yn
FROM (SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM sale_requests WHERE account_id IN (SELECT account_id FROM accounts)
        AND (product_id IS NULL OR product_id IN (SELECT product_id FROM products))) r""")
oracle("sale_rejects", """
SELECT request_id, CASE WHEN account_id IS NULL OR account_id NOT IN (SELECT account_id FROM accounts) THEN 'unknown_account' ELSE 'unknown_product' END AS reason
FROM sale_requests WHERE account_id IS NULL OR account_id NOT IN (SELECT account_id FROM accounts) OR product_id NOT IN (SELECT product_id FROM products)""")
oracle("init_attributes", """
SELECT d.pcc_id, pi.product_uid, CASE WHEN d.column_type = 'integer' THEN try_cast(d.default_value AS BIGINT) END AS int_value,
       CASE WHEN d.column_type = 'float' THEN try_cast(d.default_value AS DOUBLE) END AS float_value,
       CASE WHEN d.column_type IN ('varchar', 'char') THEN d.default_value END AS varchar_value,
       CASE WHEN d.column_type = 'text' THEN d.default_value END AS text_value,
       CASE WHEN d.column_type = 'date' THEN try_cast(d.default_value AS DATE) END AS date_value,
       CASE WHEN d.column_type = 'datetime' THEN try_cast(d.default_value AS TIMESTAMP) END AS datetime_value
FROM product_instances pi JOIN applications appl ON appl.application_id = pi.application_id
JOIN product_custom_column_def d ON d.product_id = appl.product_id""")
oracle("update_attributes", """
SELECT v.pcc_uid, v.pcc_id, v.product_uid, CASE WHEN d.column_type = 'integer' THEN r.int_value ELSE v.int_value END AS int_value,
       CASE WHEN d.column_type = 'float' THEN r.float_value ELSE v.float_value END AS float_value,
       CASE WHEN d.column_type IN ('varchar', 'char') THEN r.varchar_value ELSE v.varchar_value END AS varchar_value,
       CASE WHEN d.column_type = 'text' THEN r.text_value ELSE v.text_value END AS text_value,
       CASE WHEN d.column_type = 'date' THEN r.date_value ELSE v.date_value END AS date_value,
       CASE WHEN d.column_type = 'datetime' THEN r.datetime_value ELSE v.datetime_value END AS datetime_value
FROM attribute_requests r JOIN product_custom_column_values v ON v.pcc_uid = r.pcc_uid
JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id WHERE d.customer_visible_yn = 'Y'""")
oracle("update_attributes_rejects", """
SELECT r.request_id, r.pcc_uid, CASE WHEN d.pcc_id IS NULL THEN 'unknown_attribute' ELSE 'not_allowed' END AS reason
FROM attribute_requests r LEFT JOIN product_custom_column_values v ON v.pcc_uid = r.pcc_uid
LEFT JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id WHERE d.pcc_id IS NULL OR d.customer_visible_yn <> 'Y'""")
_CLONES = """
clones AS (SELECT r.request_id, p.*, r.account_id,
    (SELECT max(product_id) FROM products) + row_number() OVER (ORDER BY r.request_id) AS new_id
  FROM clone_requests r JOIN products p ON p.product_id = r.product_id)"""
oracle("clone_products", """
SELECT request_id, product_id AS source_product_id, category_id, subcategory_id, name, description, terms_and_conditions, currency, term,
       percentage, monetary_amount, percentage_label, mon_amt_label, CAST(NULL AS TIMESTAMP) AS available_from,
       CAST(NULL AS TIMESTAMP) AS available_till, picture_name, 'Y' AS draft_yn, account_id AS draft_owner, new_id AS product_id
FROM clones""", _CLONES)
oracle("clone_product_columns", f"""
SELECT c.new_id AS product_id, row_number() OVER (PARTITION BY c.new_id ORDER BY d.pcc_id) AS order_no, {_DEFS}
FROM clones c JOIN product_custom_column_def d ON d.product_id = c.product_id""", _CLONES)
_PUBLISHED = """
published AS (SELECT p.product_id FROM publish_requests r JOIN products p ON p.product_id = r.product_id
  WHERE p.draft_yn = 'Y' AND r.user_role IN ('A', 'C'))"""
oracle("publish_drafts", f"""
SELECT (SELECT max(pcc_id) FROM product_custom_column_def) + row_number() OVER (ORDER BY product_id, order_no) AS pcc_id, product_id, {_DEFS}
FROM draft_product_custom_column_def WHERE product_id IN (SELECT product_id FROM published)""", _PUBLISHED)
oracle("publish_draft_products", """
SELECT p.product_id, CASE WHEN x.product_id IS NULL THEN p.draft_yn ELSE 'N' END AS draft_yn,
       CASE WHEN x.product_id IS NULL THEN p.draft_owner END AS draft_owner
FROM products p LEFT JOIN published x ON x.product_id = p.product_id""", _PUBLISHED)
_RENUMBER = "row_number() OVER (PARTITION BY i.product_id ORDER BY CASE WHEN i.order_no = 0 THEN 100 ELSE i.order_no END, i.input_pos) - 1"
oracle("replace_draft_columns", f"""
SELECT product_id, order_no, {_DEFS} FROM draft_product_custom_column_def WHERE product_id NOT IN (SELECT product_id FROM valid)
UNION ALL
SELECT i.product_id, {_RENUMBER}, i.column_name, CASE WHEN i.customer_visible_yn = 'Y' THEN 'Y' ELSE 'N' END,
       CASE WHEN i.customer_populatable_yn = 'Y' THEN 'Y' ELSE 'N' END, i.column_type, nullif(i.default_value, ''),
       i.exercise_date_yn, i.available_before
FROM draft_column_inputs i WHERE i.product_id IN (SELECT product_id FROM valid)""", """
valid AS (SELECT r.product_id FROM draft_column_requests r JOIN products p ON p.product_id = r.product_id
  WHERE r.user_role IN ('A', 'C') OR (r.user_role = 'E' AND p.draft_owner = r.user_id))""")
oracle("renumber_columns", f"SELECT i.product_id, {_RENUMBER} AS order_no, i.column_name FROM draft_column_inputs i")
oracle("next_order_no", """
SELECT p.product_id, coalesce((SELECT max(order_no) + 1 FROM draft_product_custom_column_def d WHERE d.product_id = p.product_id), 0) AS order_no
FROM products p WHERE p.draft_yn = 'Y'""")
oracle("delete_unused_subcategories", """
SELECT * FROM product_subcategories s WHERE s.subcategory_id NOT IN (SELECT subcategory_id FROM subcategory_requests)
   OR EXISTS (SELECT 1 FROM products p WHERE p.subcategory_id = s.subcategory_id)""")
oracle("delete_drafts", """
SELECT d.* FROM draft_product_custom_column_def d JOIN publish_requests r ON r.product_id = d.product_id WHERE r.user_role = 'U'""")


oracle("delete_draft_products", """
SELECT p.product_id, p.name, p.draft_yn FROM products p JOIN publish_requests r ON r.product_id = p.product_id
WHERE p.draft_yn <> 'Y' OR r.user_role = 'U'""")
_NEW_DRAFTS = """
new_drafts AS (SELECT r.*, (SELECT max(product_id) FROM products) + row_number() OVER (ORDER BY request_id) AS product_id
  FROM new_draft_requests r WHERE user_role IN ('A', 'C', 'E'))"""
oracle("new_drafts", """
SELECT request_id, category_id, subcategory_id, name, description, terms_and_conditions, currency, term, percentage, monetary_amount,
       percentage_label, mon_amt_label, CASE WHEN user_role IN ('A', 'C') THEN available_from END AS available_from,
       CASE WHEN user_role IN ('A', 'C') THEN available_till END AS available_till, picture_name, 'Y' AS draft_yn, user_id AS draft_owner, product_id
FROM new_drafts""", _NEW_DRAFTS)
oracle("new_draft_columns", f"""
SELECT n.product_id, {_RENUMBER} AS order_no, i.column_name, CASE WHEN i.customer_visible_yn = 'Y' THEN 'Y' ELSE 'N' END AS customer_visible_yn,
       CASE WHEN i.customer_populatable_yn = 'Y' THEN 'Y' ELSE 'N' END AS customer_populatable_yn, i.column_type,
       nullif(i.default_value, '') AS default_value, i.exercise_date_yn, i.available_before
FROM draft_column_inputs i JOIN new_drafts n ON n.request_id = i.product_id""", _NEW_DRAFTS)
oracle("set_availability", """
SELECT product_id, available_from, available_till FROM availability_requests WHERE product_id IN (SELECT product_id FROM products)
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY request_id DESC) = 1""")
oracle("patch_drafts", """
SELECT x.product_id, arg_max(x.name, x.request_id) AS name FROM product_patches x JOIN products p ON p.product_id = x.product_id AND p.draft_yn = 'Y'
WHERE x.name IS NOT NULL GROUP BY x.product_id""")
_PREFERENCE = """
judged AS (SELECT r.*, CASE WHEN pi.product_uid IS NULL THEN 'unknown_instance' WHEN r.user_role NOT IN ('A', 'C', 'E') AND r.user_id <> pi.account_id THEN 'not_allowed'
    WHEN r.preference NOT IN ('Y', 'N', 'P') THEN 'unknown_preference' END AS reason
  FROM preference_requests r LEFT JOIN product_instances pi ON pi.product_uid = r.product_uid)"""
oracle("notification_preferences", """
SELECT product_uid, arg_max(preference, request_id) AS notifications_yn FROM judged WHERE reason IS NULL GROUP BY product_uid""", _PREFERENCE)
oracle("notification_preference_rejects", "SELECT request_id, product_uid, reason FROM judged WHERE reason IS NOT NULL", _PREFERENCE)


def _last_given(table: str, key: str, column: str) -> str:
    return f"""(SELECT x.{column} FROM {table} x WHERE x.{key} = t.{key} AND x.{column} IS NOT NULL ORDER BY x.request_id DESC LIMIT 1)"""


_PRODUCT_PATCH_OK = """
ok AS (SELECT * FROM product_patches WHERE product_id IN (SELECT product_id FROM products)
  AND coalesce(name, percentage, term, available_till) IS NOT NULL AND (term IS NULL OR term = '__null__' OR try_cast(term AS BIGINT) IS NOT NULL))"""
oracle("patch_products", f"""
SELECT product_id, coalesce(p_name, name) AS name,
       CASE WHEN p_percentage IS NULL THEN percentage WHEN p_percentage = '__null__' THEN NULL ELSE try_cast(p_percentage AS DOUBLE) END AS percentage,
       CASE WHEN p_term IS NULL THEN term WHEN p_term = '__null__' THEN NULL ELSE try_cast(p_term AS BIGINT) END AS term,
       CASE WHEN p_till IS NULL THEN available_till WHEN p_till = '__null__' THEN NULL ELSE try_cast(p_till AS TIMESTAMP) END AS available_till
FROM (SELECT t.*, {_last_given('ok', 'product_id', 'name')} AS p_name, {_last_given('ok', 'product_id', 'percentage')} AS p_percentage,
        {_last_given('ok', 'product_id', 'term')} AS p_term, {_last_given('ok', 'product_id', 'available_till')} AS p_till
      FROM products t WHERE t.product_id IN (SELECT product_id FROM ok))""", _PRODUCT_PATCH_OK)
oracle("patch_products_rejects", """
SELECT request_id, product_id, CASE WHEN product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product_id'
         WHEN coalesce(name, percentage, term, available_till) IS NULL THEN 'nothing_to_update' ELSE 'unreadable_value' END AS reason
FROM product_patches WHERE request_id NOT IN (SELECT request_id FROM ok)""", _PRODUCT_PATCH_OK)
oracle("patch_accounts", f"""
SELECT account_id, coalesce(p_phone, phone) AS phone, coalesce(p_email, email) AS email, coalesce(p_country, country_code) AS country_code,
       coalesce(p_address, address) AS address, CASE WHEN p_email IS NOT NULL THEN 'R' ELSE verification END AS verification
FROM (SELECT t.*, {_last_given('ok', 'account_id', 'phone')} AS p_phone, {_last_given('ok', 'account_id', 'email')} AS p_email,
        {_last_given('ok', 'account_id', 'country_code')} AS p_country, {_last_given('ok', 'account_id', 'address')} AS p_address
      FROM accounts t WHERE t.account_id IN (SELECT account_id FROM ok WHERE coalesce(phone, email, country_code, address) IS NOT NULL))""", """
flagged AS (SELECT *, length(phone) > 15 AS long_phone, length(email) > 255 AS long_email, country_code NOT IN ('BGR', 'USA', 'OTH') AS bad_country
  FROM account_patches WHERE account_id IN (SELECT account_id FROM accounts)),
ok AS (SELECT request_id, account_id, CASE WHEN NOT coalesce(long_phone, FALSE) THEN phone END AS phone,
    CASE WHEN NOT coalesce(long_phone, FALSE) AND NOT coalesce(long_email, FALSE) THEN email END AS email,
    CASE WHEN NOT coalesce(long_phone, FALSE) AND NOT coalesce(long_email, FALSE) AND NOT coalesce(bad_country, FALSE) THEN country_code END AS country_code,
    CASE WHEN NOT coalesce(long_phone, FALSE) AND NOT coalesce(long_email, FALSE) AND NOT coalesce(bad_country, FALSE) THEN address END AS address
  FROM flagged)""")
oracle("patch_instances", """
SELECT t.product_uid, coalesce(x.amount, t.amount) AS amount, coalesce(x.yield, t.yield) AS yield,
       coalesce(x.product_end_date, t.product_end_date) AS product_end_date, coalesce(x.special_notes, t.special_notes) AS special_notes
FROM product_instances t JOIN (
  SELECT product_uid, arg_max(amount, request_id) AS amount, arg_max(yield, request_id) AS yield,
         arg_max(product_end_date, request_id) AS product_end_date, arg_max(special_notes, request_id) AS special_notes
  FROM instance_patches WHERE coalesce(CAST(amount AS VARCHAR), CAST(yield AS VARCHAR), CAST(product_end_date AS VARCHAR), special_notes) IS NOT NULL
  GROUP BY product_uid) x ON x.product_uid = t.product_uid""")
oracle("category_codes", """
SELECT request_id, code AS category_id FROM winners
UNION ALL
SELECT l.request_id, f.code FROM losers l LEFT JOIN free f ON f.initial = l.initial AND f.n = l.n""", """
asked AS (SELECT request_id, left(category_id, 3) AS code, left(category_id, 1) AS initial FROM category_requests),
winners AS (SELECT min(request_id) AS request_id, code FROM asked WHERE code NOT IN (SELECT category_id FROM product_categories) GROUP BY code),
losers AS (SELECT request_id, initial, row_number() OVER (PARTITION BY initial ORDER BY request_id) AS n
  FROM asked WHERE request_id NOT IN (SELECT request_id FROM winners)),
chars AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '')) AS c),
free AS (SELECT i.initial, i.initial || a.c || b.c AS code, row_number() OVER (PARTITION BY i.initial ORDER BY a.c || b.c) AS n
  FROM (SELECT DISTINCT initial FROM losers) i CROSS JOIN chars a CROSS JOIN chars b
  WHERE i.initial || a.c || b.c NOT IN (SELECT category_id FROM product_categories) AND i.initial || a.c || b.c NOT IN (SELECT code FROM winners))""")
_CODED = ORACLES["category_codes"].split("SELECT request_id, code AS category_id FROM winners")[0]
ORACLES["create_categories"] = _CODED + """
SELECT q.request_id, c.category_id, q.category_name, q.description, CASE WHEN q.catalog_yn = 'Y' THEN 'Y' ELSE 'N' END AS catalog_yn
FROM category_requests q JOIN (
  SELECT request_id, code AS category_id FROM winners
  UNION ALL
  SELECT l.request_id, f.code FROM losers l JOIN free f ON f.initial = l.initial AND f.n = l.n) c ON c.request_id = q.request_id
WHERE c.category_id IS NOT NULL"""
oracle("create_subcategories", """
SELECT request_id, category_id, subcategory_name,
       CASE WHEN catalog_yn = 'Y' THEN 'Y' ELSE 'N' END AS catalog_yn,
       (SELECT max(subcategory_id) FROM product_subcategories) + row_number() OVER (ORDER BY request_id) AS subcategory_id
FROM new_subcategory_requests WHERE category_id IN (SELECT category_id FROM product_categories)""")

ORACLES["sweep_summary_observed"] = ORACLES["sweep_summary"]
ORACLES["nightly_audit_dated"] = ORACLES["nightly_audit"]
ORACLES["audit_rows_hashed"] = ORACLES["audit_rows"]
oracle("reserved_ids", """
SELECT product_uid, is_code, prime_uid AS source_uid,
       4999 + CASE WHEN is_code = 'APR' THEN 0 ELSE count(*) FILTER (WHERE is_code = 'APR') OVER () END
       + row_number() OVER (PARTITION BY is_code = 'APR' ORDER BY prime_uid) AS prime_uid
FROM product_status_updates""")

# --- requests that name who asks ---------------------------------------------------------------

_SALES_CHECKED = """
asked AS (SELECT r.*, u.user_role IN ('A', 'C', 'E') OR coalesce(u.user_id = r.account_id, FALSE) AS may
  FROM sale_requests r JOIN sale_requesters u ON u.request_id = r.request_id),
judged AS (SELECT *, CASE WHEN NOT may THEN 'not_allowed' WHEN account_id IS NULL OR account_id NOT IN (SELECT account_id FROM accounts) THEN 'unknown_account'
    WHEN product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product' END AS reason FROM asked)"""
oracle("sales_checked", """
SELECT request_id, (SELECT max(application_id) FROM applications) + row_number() OVER (ORDER BY request_id) AS application_id, account_id, product_id
FROM judged WHERE reason IS NULL""", _SALES_CHECKED)
oracle("sale_checked_rejects", "SELECT request_id, reason FROM judged WHERE reason IS NOT NULL", _SALES_CHECKED)


def _judged(requests: str, requesters: str, roles: str, unknown: str) -> str:
    return f"""
judged AS (SELECT r.*, u.user_id, u.user_role, CASE WHEN u.user_role NOT IN ({roles}) THEN 'not_allowed' {unknown} END AS reason
  FROM {requests} r JOIN {requesters} u ON u.request_id = r.request_id)"""


_CLONES_CHECKED = _judged("clone_requests", "part_requesters", "'A', 'C', 'E'",
                          "WHEN r.product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product'")
oracle("clone_products_checked", """
SELECT request_id, (SELECT max(product_id) FROM products) + row_number() OVER (ORDER BY request_id) AS product_id, account_id AS draft_owner
FROM judged WHERE reason IS NULL""", _CLONES_CHECKED)
oracle("clone_checked_rejects", "SELECT request_id, reason FROM judged WHERE reason IS NOT NULL", _CLONES_CHECKED)
_AVAILABILITY_CHECKED = _judged("availability_requests", "part_requesters", "'A', 'C'",
                                "WHEN r.product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product'")
oracle("set_availability_checked", """
SELECT product_id, available_from, available_till FROM judged WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY request_id DESC) = 1""", _AVAILABILITY_CHECKED)
oracle("availability_checked_rejects", "SELECT request_id, product_id, reason FROM judged WHERE reason IS NOT NULL", _AVAILABILITY_CHECKED)
oracle("delete_drafts_checked_rejects", """
SELECT request_id, product_id, CASE WHEN user_role = 'U' THEN 'not_allowed' ELSE 'not_a_draft' END AS reason FROM publish_requests
WHERE user_role = 'U' OR product_id NOT IN (SELECT product_id FROM products WHERE draft_yn = 'Y')""")
oracle("patch_products_checked_rejects", """
SELECT r.request_id, r.product_id, CASE WHEN u.user_role <> 'A' THEN 'not_allowed' WHEN r.product_id NOT IN (SELECT product_id FROM products) THEN 'unknown_product_id'
         WHEN coalesce(name, percentage, term, available_till) IS NULL THEN 'nothing_to_update' ELSE 'unreadable_value' END AS reason
FROM product_patches r JOIN part_requesters u ON u.request_id = r.request_id
WHERE u.user_role <> 'A' OR r.request_id NOT IN (SELECT request_id FROM ok)""", _PRODUCT_PATCH_OK)
oracle("patch_drafts_checked_rejects", """
SELECT request_id, product_id, reason FROM (
  SELECT r.request_id, r.product_id, CASE WHEN u.user_role = 'U' THEN 'not_allowed' WHEN p.product_id IS NULL THEN 'unknown_product'
         WHEN p.draft_yn <> 'Y' THEN 'not_a_draft' WHEN r.name IS NULL THEN 'nothing_to_update' END AS reason
  FROM product_patches r JOIN part_requesters u ON u.request_id = r.request_id LEFT JOIN products p ON p.product_id = r.product_id)
WHERE reason IS NOT NULL""")
_VALUES_CHECKED = """
judged AS (SELECT r.*, CASE WHEN u.user_role = 'U' THEN 'not_allowed' WHEN r.product_uid NOT IN (SELECT product_uid FROM product_instances) THEN 'unknown_product_uid'
    WHEN coalesce(CAST(amount AS VARCHAR), CAST(yield AS VARCHAR), CAST(product_end_date AS VARCHAR), special_notes) IS NULL
         AND r.request_id NOT IN (SELECT request_id FROM patch_values) THEN 'nothing_to_update' END AS reason
  FROM instance_patches r JOIN order_requesters u ON u.request_id = r.request_id)"""
oracle("patch_instance_rejects", "SELECT request_id, product_uid, reason FROM judged WHERE reason IS NOT NULL", _VALUES_CHECKED)
oracle("patch_instance_values", """
SELECT v.pcc_uid, v.pcc_id, v.product_uid, CASE WHEN d.column_type = 'integer' THEN r.int_value ELSE v.int_value END AS int_value,
       CASE WHEN d.column_type = 'float' THEN r.float_value ELSE v.float_value END AS float_value,
       CASE WHEN d.column_type IN ('char', 'varchar') THEN r.varchar_value ELSE v.varchar_value END AS varchar_value,
       CASE WHEN d.column_type = 'text' THEN r.text_value ELSE v.text_value END AS text_value,
       CASE WHEN d.column_type = 'date' THEN r.date_value ELSE v.date_value END AS date_value,
       CASE WHEN d.column_type = 'datetime' THEN r.datetime_value ELSE v.datetime_value END AS datetime_value
FROM product_custom_column_values v JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id
JOIN (SELECT x.* FROM patch_values x JOIN judged j ON j.request_id = x.request_id WHERE j.reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY x.pcc_uid ORDER BY x.request_id DESC) = 1) r ON r.pcc_uid = v.pcc_uid""", _VALUES_CHECKED)
oracle("patch_categories", """
SELECT c.category_id, coalesce(x.category_name, c.category_name) AS category_name, coalesce(x.description, c.description) AS description,
       CASE WHEN x.catalog_yn IS NULL THEN c.catalog_yn WHEN x.catalog_yn = 'Y' THEN 'Y' ELSE 'N' END AS catalog_yn
FROM product_categories c JOIN (
  SELECT category_id, arg_max(category_name, request_id) AS category_name, arg_max(description, request_id) AS description,
         arg_max(catalog_yn, request_id) AS catalog_yn
  FROM category_patches WHERE coalesce(category_name, description, catalog_yn) IS NOT NULL GROUP BY category_id) x ON x.category_id = c.category_id""")
oracle("patch_category_rejects", """
SELECT request_id, category_id, reason FROM (
  SELECT r.request_id, r.category_id, CASE WHEN u.user_role NOT IN ('A', 'C') THEN 'not_allowed'
         WHEN r.category_id NOT IN (SELECT category_id FROM product_categories) THEN 'unknown_category_id'
         WHEN coalesce(category_name, description, catalog_yn) IS NULL THEN 'nothing_to_update' END AS reason
  FROM category_patches r JOIN part_requesters u ON u.request_id = r.request_id) WHERE reason IS NOT NULL""")
_SUBCATEGORY_PATCHES = """
judged AS (SELECT r.*, u.user_role, CASE WHEN r.category_id NOT IN (SELECT category_id FROM product_categories) THEN 'unknown_category'
    WHEN r.subcategory_id NOT IN (SELECT subcategory_id FROM product_subcategories) THEN 'unknown_subcategory_id'
    WHEN coalesce(r.category_id, subcategory_name, catalog_yn) IS NULL THEN 'nothing_to_update' END AS problem
  FROM subcategory_patches r JOIN part_requesters u ON u.request_id = r.request_id)"""
oracle("patch_subcategories", """
SELECT s.subcategory_id, coalesce(x.category_id, s.category_id) AS category_id, coalesce(x.subcategory_name, s.subcategory_name) AS subcategory_name,
       CASE WHEN x.catalog_yn IS NULL THEN s.catalog_yn WHEN x.catalog_yn = 'Y' THEN 'Y' ELSE 'N' END AS catalog_yn
FROM product_subcategories s JOIN (
  SELECT subcategory_id, arg_max(category_id, request_id) AS category_id, arg_max(subcategory_name, request_id) AS subcategory_name,
         arg_max(catalog_yn, request_id) AS catalog_yn
  FROM judged WHERE problem IS NULL GROUP BY subcategory_id) x ON x.subcategory_id = s.subcategory_id""", _SUBCATEGORY_PATCHES)
oracle("patch_subcategory_rejects", """
SELECT request_id, subcategory_id, CASE WHEN user_role NOT IN ('A', 'C') THEN 'not_allowed' ELSE problem END AS reason
FROM judged WHERE user_role NOT IN ('A', 'C') OR problem IS NOT NULL""", _SUBCATEGORY_PATCHES)
oracle("categories_reversed", """
SELECT c.category_id, c.category_name, c.description, count(p.product_id) AS n_products,
       row_number() OVER (ORDER BY c.category_id DESC) AS position
FROM product_categories c LEFT JOIN products p ON p.category_id = c.category_id GROUP BY c.category_id, c.category_name, c.description""")
oracle("audit_log_appended", f"""
SELECT prime_uid, product_uid, was_status, is_code, update_dt, update_user FROM product_status_updates
UNION ALL
SELECT (SELECT max(prime_uid) FROM product_status_updates) + row_number() OVER (ORDER BY o.product_uid), o.product_uid, o.status_code, n.status_code,
       {TIME}, n.latest_update_user_id
FROM product_instances o JOIN instances_after n ON n.product_uid = o.product_uid WHERE o.status_code <> n.status_code""")

# --- streams: the same rows as their batch twins ------------------------------------------------

ORACLES["stream_status"] = ORACLES["apply_status_fold"]
ORACLES["stream_status_state"] = ORACLES["apply_status_fold"]
ORACLES["stream_rejects"] = ORACLES["apply_status_rejects"]
ORACLES["stream_instances"] = ORACLES["apply_status"]
oracle("stream_to_contract", "SELECT DISTINCT product_uid FROM walk WHERE ok AND new_status = 'APR'", _STAFF_FOLD, recursive=True)
oracle("stream_messages", """
SELECT w.request_id AS change_id, pi.product_uid, ac.email, ac.first_name, ac.last_name, p.name AS product_name, ps.status_name,
       CASE WHEN w.new_status = 'APL' THEN 'received' ELSE 'update' END AS template
FROM walk w JOIN product_instances pi ON pi.product_uid = w.product_uid JOIN accounts ac ON ac.account_id = pi.account_id
JOIN applications a ON a.application_id = pi.application_id JOIN products p ON p.product_id = a.product_id
JOIN product_statuses ps ON ps.code = w.new_status
WHERE w.ok AND (pi.notifications_yn = 'Y' OR (pi.notifications_yn = 'P'
      AND w.new_status IN ('AMD','APR','DEN','CNL','SGN','NOR','TRG','DUE','ORD','CMP')))""", _STAFF_FOLD, recursive=True)
oracle("stream_log", "SELECT * FROM product_status_updates")
ORACLES["stream_assigned"] = ORACLES["assigned_instances"]
ORACLES["stream_notices"] = ORACLES["status_notifications"]
oracle("stream_approvals", """
SELECT pi.application_id, CASE WHEN w.new_status = 'APR' THEN 'Y' ELSE 'N' END AS approved_yn, w.update_user AS approved_by,
       w.request_dt AS approval_dt
FROM product_instances pi
JOIN (SELECT * FROM walk WHERE ok AND new_status IN ('APR', 'DEN') QUALIFY n = max(n) OVER (PARTITION BY product_uid)) w
  ON w.product_uid = pi.product_uid""", _STAFF_FOLD, recursive=True)
oracle("stream_current_status", """
SELECT product_uid, is_code AS status_code, update_dt FROM product_status_updates
QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY update_dt DESC, prime_uid DESC) = 1""")

# --- contracts ---------------------------------------------------------------------------------

_FACTS = """
facts AS (SELECT pi.product_uid, pr.currency, pi.amount, pi.yield * 100 AS rate_pct, strftime(pi.product_start_date, '%B %d, %Y') AS begin_date,
    strftime(pi.product_end_date, '%B %d, %Y') AS end_date, ac.first_name, ac.last_name,
    CASE WHEN ac.country_code IN ('BGR', 'USA') THEN
           CASE WHEN ac.address IS NULL OR ac.address = '' THEN 'in ' ELSE ac.address || ', ' END
           || CASE ac.country_code WHEN 'BGR' THEN 'Bulgaria' ELSE 'United States' END
         WHEN ac.address IS NULL OR ac.address = '' THEN 'Not Specified' ELSE ac.address END AS address,
    pr.category_id, pr.name AS product_name, pr.description AS product_description
  FROM product_instances pi JOIN accounts ac ON ac.account_id = pi.account_id
  JOIN applications appl ON appl.application_id = pi.application_id JOIN products pr ON pr.product_id = appl.product_id)"""
oracle("contract_facts", "SELECT * FROM facts", _FACTS)
oracle("contract_address", "SELECT product_uid, address FROM facts", _FACTS)
oracle("contract_rejects", """
SELECT product_uid, 'missing_terms' AS reason FROM facts WHERE rate_pct IS NULL OR (amount IS NULL AND category_id IN ('LON', 'PEQ'))""", _FACTS)


def _template_rows() -> str:
    rows = []
    for category, items in clauses.BY_CATEGORY.items():
        for number, item in enumerate(items):
            if item is clauses.TABLE:
                rows.append((category, number, "table", ""))
            elif item is clauses.SALE_DETAILS:
                rows.append((category, number, "heading", clauses.SALE_DETAILS_TEXT))
            else:
                rows.append((category, number, "text", item))
    return ", ".join("('%s', %d, '%s', '%s')" % (c, n, k, t.replace("'", "''")) for c, n, k, t in rows)


def _money(column: str) -> str:
    return f"printf('%.2f', round({column}, 2))"


_FILLED = "t.text"
for _field, _value in {
    "now": "'January 15, 2024'", "bank": "'" + dims.BANK_NAME + "'", "first_name": "f.first_name", "last_name": "f.last_name",
    "address": "f.address", "currency": "f.currency", "amount": f"coalesce({_money('f.amount')}, 'None')", "rate": _money("f.rate_pct"),
    "begin": "f.begin_date", "end": "f.end_date", "product_uid": "CAST(f.product_uid AS VARCHAR)", "product_name": "f.product_name",
    "product_description": "f.product_description",
}.items():
    _FILLED = f"replace({_FILLED}, '{{{_field}}}', {_value})"

_LINES = _FACTS + f""",
usable AS (SELECT * FROM facts WHERE rate_pct IS NOT NULL AND (amount IS NOT NULL OR category_id = 'DER')),
templates AS (SELECT category_id, CAST(clause_no AS BIGINT) AS clause_no, kind, text
  FROM (VALUES {_template_rows()}) AS t(category_id, clause_no, kind, text)),
visible AS (SELECT v.product_uid, v.pcc_uid, d.column_name AS label,
    CASE d.column_type WHEN 'float' THEN CAST(v.float_value AS VARCHAR) ELSE {_PICK} END AS value
  FROM product_custom_column_values v JOIN product_custom_column_def d ON d.pcc_id = v.pcc_id WHERE d.customer_visible_yn = 'Y'),
filled AS (SELECT f.product_uid, f.category_id, f.end_date, t.clause_no, t.kind, {_FILLED} AS text,
    f.product_uid IN (SELECT product_uid FROM visible) AS has_rows
  FROM usable f JOIN templates t ON t.category_id = f.category_id)"""
oracle("contract_text", """
SELECT product_uid, clause_no, CAST(0 AS BIGINT) AS row_no,
       CASE WHEN kind = 'text' OR has_rows THEN 'text' ELSE 'none' END AS kind, CASE WHEN kind = 'text' OR has_rows THEN text END AS text,
       CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS value
FROM filled WHERE kind <> 'table'
UNION ALL
SELECT product_uid, clause_no, 0, 'none', NULL, NULL, NULL FROM filled WHERE kind = 'table' AND NOT has_rows AND category_id <> 'DER'
UNION ALL
SELECT f.product_uid, f.clause_no, v.pcc_uid, 'table', NULL, v.label, v.value FROM filled f JOIN visible v ON v.product_uid = f.product_uid WHERE f.kind = 'table'
UNION ALL
SELECT product_uid, clause_no, 9223372036854775807, 'table', NULL, 'Strike Date', end_date FROM filled WHERE kind = 'table' AND category_id = 'DER'""", _LINES)
oracle("contract_json_roundtrip", """
SELECT f.product_uid, CAST(0 AS BIGINT) AS part_no, count(*) AS n_elements,
       CAST(sum(CASE WHEN f.kind = 'table' THEN (SELECT count(*) FROM visible v WHERE v.product_uid = f.product_uid)
                     + CASE WHEN f.category_id = 'DER' THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS n_table_rows,
       'Borrower''s Signature: ___________________' AS signature_line
FROM filled f GROUP BY f.product_uid""", _LINES)
_SIGN = """
checked AS (SELECT r.*, CASE WHEN pi.product_uid IS NULL THEN 'unknown_instance' WHEN pi.account_id <> r.account_id THEN 'not_the_owner'
      WHEN pi.status_code <> 'SGN' THEN 'status_not_for_signing' WHEN ac.verification <> 'Y' THEN 'account_not_verified' END AS reason
  FROM sign_requests r LEFT JOIN product_instances pi ON pi.product_uid = r.product_uid LEFT JOIN accounts ac ON ac.account_id = r.account_id),
signed AS (SELECT *, row_number() OVER (PARTITION BY product_uid ORDER BY request_id) AS n FROM checked WHERE reason IS NULL)"""
oracle("sign_contracts", "SELECT product_uid, 'SGN' AS was_status, 'AWT' AS is_code, account_id AS update_user FROM signed WHERE n = 1", _SIGN)
oracle("effective_contracts", """
SELECT f.product_uid, count(*) AS n_elements,
       max(CASE WHEN s.product_uid IS NULL THEN 'Borrower''s Signature: ___________________'
                ELSE 'Borrower''s Signature: ' || a.first_name || ' ' || a.last_name || ' [digitally signed]' END) AS signature_line,
       max(CASE WHEN s.product_uid IS NULL THEN 'Date: _______________' ELSE 'Date: January 15, 2024' END) AS date_line
FROM filled f LEFT JOIN (SELECT * FROM signed WHERE n = 1) s ON s.product_uid = f.product_uid
LEFT JOIN accounts a ON a.account_id = s.account_id GROUP BY f.product_uid""", _LINES + "," + _SIGN)
oracle("sign_rejects", """
SELECT request_id, product_uid, reason FROM checked WHERE reason IS NOT NULL
UNION ALL SELECT request_id, product_uid, 'status_not_for_signing' FROM signed WHERE n > 1""", _SIGN)
oracle("contract_notices", f"""
SELECT pi.product_uid, ac.email, ac.first_name, ac.last_name, pi.contract_id, p.name AS product_name, 'contract' AS template
{_MESSAGE_FROM} JOIN signed s ON s.product_uid = pi.product_uid AND s.n = 1""", _SIGN)
