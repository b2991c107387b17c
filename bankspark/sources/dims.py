"""Reference data: code tables and the two lifecycle edge tables.

Each dimension is one ``VALUES`` statement. It becomes a local relation of known, tiny size, so
Catalyst broadcasts it without a hint. The same text runs on any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------------
# Codes, labels and the order of the lifecycle. They must equal those of the bank's
# own tables for results to be right.
# ---------------------------------------------------------------------------------------------
BANK_NAME = "the Bank"

CURRENCIES = [
    ("BGN", "Bulgarian Lev"),
    ("EUR", "Euro"),
    ("USD", "United States Dollar"),
]

USER_ROLES = [
    ("A", "Administrator"),
    ("C", "C-level Executive"),
    ("E", "Employee"),
    ("U", "User"),
]

VERIFICATIONS = [
    ("Y", "Verified", "✅"),
    ("N", "Unverified", "🟡"),
    ("R", "Revoked Verification", "🚫"),
    ("C", "Contacted for Verification", "📩"),
]

ACCOUNT_GROUPS = [
    ("FTC", "First-Time Client", "Regular first-time client", "Y"),
    ("FTP", "First-Time Partner", "Credible first-time client", "N"),
    ("RTC", "Returning Client", "Client with at least one completed product", "N"),
    ("LTP", "Long Term Partner", f"Long term partner of {BANK_NAME} or affiliated entities", "N"),
    ("EMP", "Employee", "Code for any employee, inlcuding admins, C-suite, and regular employees", "N"),
]

PRODUCT_CATEGORIES = [
    ("LON", "Loan", f"Loans are agreements in which {BANK_NAME} lends money out to the loan applicant in exchange for an interest.", "Y"),
    ("PEQ", "Private Equity Offerring", f"Private Equity Offerings involve the sale of private equity, facilitated by {BANK_NAME}.", "N"),
    ("DER", "Exotic Derivative", "Instruments whose price depends on the performance of some underlying asset or condition.", "Y"),
]

PRODUCT_SUBCATEGORIES = [
    (1, "DER", "Futures Contract", "A financial contract which compels the exchange of the underlying on the exercise date.", "N"),
    (2, "DER", "European Option", "A financial derivative that can only be exercised at expiration.", "Y"),
    (3, "DER", "American Option", "A financial derivative that can be exercised at any time before or on its expiration date.", "N"),
    (4, "DER", "Bermudan Option", "A financial derivative that can be exercised at specific dates before expiration.", "Y"),
    (5, "DER", "Asian Option", "A financial derivative whose payoff depends on the average price of the underlying asset over a set period.", "N"),
    (6, "DER", "Basket Option", "A financial derivative based on the value of a weighted portfolio of multiple underlying assets.", "N"),
    (7, "DER", "Range Option", "A financial derivative that provides a payoff if the underlying asset's price stays within a predetermined range during a specified period.", "N"),
]

PRODUCT_STATUSES = [
    (10, "APL", "Applied", None, "Application submitted"),
    (20, "REV", "Reviewed", "Review", "Application is under review"),
    (21, "AGR", "Agreed", "Agree", "The client agrees to the change proposed by the employee"),
    (22, "DIS", "Disagreed", "Disagree", "The client does not agree with the change proposed by the employee"),
    (23, "AMD", "Amended", "Amend", "An employee made a change, and the client has to agree to it"),
    (30, "APR", "Approved", "Approve", "Application is approved"),
    (35, "SGN", "Sent for Signing", "Send for Signing", "Contract has been sent for signing"),
    (40, "AWT", "Awaiting Disbursement Date", "Sign", "Awaiting Begin Date"),
    (50, "NOR", "Current", "Disbursed", "Exchange of the underlying occurred and the end date is not reached yet"),
    (60, "EXC", "Exercise Date", "Exercise Date", "Indicates that the current date is an exercise date"),
    (65, "TRG", "Exercised", "Exercise", "An instrument condition has been triggered"),
    (70, "DUE", "Final Exchange Due", "Final Exchange Due", "Final exchange is due"),
    (80, "ORD", "Overdue", "Overdue", "Overdue"),
    (100, "CMP", "Complete", "Complete", "Complete"),
    (101, "CNL", "Cancelled", "Cancel", "The application or the exchange of the underlying was cancelled"),
    (102, "DEN", "Denied", "Deny", "Application is denied"),
    (103, "WOF", "Written Off", "Write Off", "Written Off"),
]

# from -> statuses a request may move to
NEXT_STATUS = {
    "APL": ["REV", "APR", "DEN", "AMD", "CNL"],
    "REV": ["APR", "DEN", "AMD", "CNL"],
    "AMD": ["AGR", "DIS", "CNL"],
    "AGR": ["APR", "CNL"],
    "DIS": ["AMD", "CNL"],
    "APR": ["SGN", "CNL"],
    "SGN": ["AWT", "CNL"],
    "AWT": ["NOR", "CNL"],
    "NOR": ["DUE", "EXC"],
    "EXC": ["TRG", "NOR"],
    "TRG": ["DUE"],
    "DUE": ["CMP", "ORD"],
    "ORD": ["CMP", "WOF"],
}

# from -> statuses still ahead when all goes well
PROGRESSION = {
    "APL": ["REV", "APR", "SGN", "AWT", "NOR", "DUE", "CMP"],
    "REV": ["APR", "SGN", "AWT", "NOR", "DUE", "CMP"],
    "AMD": ["AGR", "APR", "SGN", "AWT", "NOR", "DUE", "CMP"],
    "AGR": ["APR", "SGN", "AWT", "NOR", "DUE", "CMP"],
    "DIS": ["AMD", "AGR", "APR", "SGN", "AWT", "NOR", "DUE", "CMP"],
    "APR": ["SGN", "AWT", "NOR", "DUE", "CMP"],
    "SGN": ["AWT", "NOR", "DUE", "CMP"],
    "AWT": ["NOR", "DUE", "CMP"],
    "NOR": ["DUE", "CMP"],
    "EXC": ["TRG", "DUE", "CMP"],
    "TRG": ["DUE", "CMP"],
    "DUE": ["CMP"],
    "ORD": ["CMP"],
}

STAFF_ROLES = ("A", "C", "E")
SENIOR_ROLES = ("A", "C")
CLOSED_STATUSES = ("CNL", "CMP", "WOF", "DEN")
CLIENT_OFFERED = ("AWT", "AGR", "DIS", "CNL")
CLIENT_ACCEPTED = ("CNL", "AGR", "DIS")
NOTIFY_PARTLY = ("AMD", "APR", "DEN", "CNL", "SGN", "NOR", "TRG", "DUE", "ORD", "CMP")
SYSTEM_ACCOUNTS = (1, 2000000)
AUTOMATION_ACCOUNT = 1
ACCOUNT_ID_BASE = 2000000
INSTANCE_ID_BASE = 300000
COUNTRY_CODES = ("BGR", "USA", "OTH")
ATTRIBUTE_TYPES = ("integer", "float", "char", "varchar", "text", "date", "datetime")
# ---------------------------------------------------------------------------------------------

STATUS_CODES = [row[1] for row in PRODUCT_STATUSES]


def _edge_rows(graph: dict[str, list[str]]) -> list[tuple]:
    return [
        (origin, target, pos)
        for origin, targets in graph.items()
        for pos, target in enumerate(targets, start=1)
    ]


# name -> (columns with types, rows)
_DIMENSIONS = {
    "currencies": ("currency_code STRING, currency_name STRING", CURRENCIES),
    "user_roles": ("role STRING, description STRING", USER_ROLES),
    "verifications": ("verification_status STRING, description STRING, emoji STRING", VERIFICATIONS),
    "account_groups": ("group_code STRING, group_name STRING, group_description STRING, default_yn STRING", ACCOUNT_GROUPS),
    "product_categories": ("category_id STRING, category_name STRING, description STRING, catalog_yn STRING", PRODUCT_CATEGORIES),
    "product_subcategories": (
        "subcategory_id BIGINT, category_id STRING, subcategory_name STRING, "
        "subcategory_description STRING, catalog_yn STRING",
        PRODUCT_SUBCATEGORIES,
    ),
    "product_statuses": (
        "order_no BIGINT, code STRING, status_name STRING, call_to_action STRING, status_description STRING",
        PRODUCT_STATUSES,
    ),
    "next_status": ("from_status STRING, to_status STRING, pos BIGINT", _edge_rows(NEXT_STATUS)),
    "progression": ("from_status STRING, to_status STRING, pos BIGINT", _edge_rows(PROGRESSION)),
}

DIMENSION_NAMES = tuple(_DIMENSIONS)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def dimension_sql(name: str, string_type: str = "STRING") -> str:
    """The dimension as a SELECT over VALUES."""
    columns, rows = _DIMENSIONS[name]
    fields = [field.split() for field in columns.split(", ")]
    casts = ", ".join(
        f"CAST({col} AS {string_type if typ == 'STRING' else typ}) AS {col}" for col, typ in fields
    )
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT {casts} FROM (VALUES {values}) AS t({', '.join(col for col, _ in fields)})"


def dimension(spark: SparkSession, name: str) -> DataFrame:
    text = dimension_sql(name).replace("''", "\\'")
    return spark.sql(text)
