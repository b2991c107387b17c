"""Product instances: cards, worklists, details, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bankspark.functions import columns as C
from bankspark.operators.ordering import paged
from bankspark.sources import dims
from bankspark.sources.tables import Tables

CARD_COLUMNS = [
    "product_uid", "application_id", "contract_id", "approved_by", "name", "description", "amount",
    "status_code", "status_name", "category_id", "currency", "first_name", "last_name", "account_id",
    "picture_name",
]


def _cards(instances: DataFrame, db: Tables) -> DataFrame:
    """Instance with application, product and status. The account id is the instance's, the product
    the application's."""
    applications = db.applications.select("application_id", "product_id", "approved_by", "amount_requested")
    products = db.products.select("product_id", "name", "description", "category_id", "currency", "picture_name")
    statuses = db.product_statuses.select(F.col("code").alias("status_code"), "status_name")
    kept = ["product_uid", "application_id", "contract_id", "account_id", "amount", "status_code"]
    extra = [c for c in instances.columns if c == "updater_id"]
    return (
        instances.select(*kept, *extra)
        .join(applications, "application_id").join(products, "product_id").join(statuses, "status_code")
        .withColumn("amount", C.nvl(F.col("amount"), F.col("amount_requested")))
        .withColumn("picture_name", C.nvl(F.col("picture_name"), F.col("category_id")))
    )


def _with_names(cards: DataFrame, db: Tables) -> DataFrame:
    return cards.join(db.accounts.select("account_id", "first_name", "last_name"), "account_id")


def product_cards(db: Tables) -> DataFrame:
    return instances(db)


def account_products(db: Tables, account_id: int | None = None) -> DataFrame:
    """Cards of one client's products, or of everyone's, without the name of the client."""
    rows = db.product_instances
    if account_id is not None:
        rows = rows.filter(F.col("account_id") == account_id)
    return _cards(rows, db).select(*[c for c in CARD_COLUMNS if c not in ("first_name", "last_name")])


def instances(
    db: Tables,
    status: list[str] | None = None,
    product_id: int | None = None,
    product_uid: int | None = None,
    contract_id: int | None = None,
) -> DataFrame:
    """Product cards, optionally of some statuses, one product, one instance or one contract."""
    conditions = []
    if status is not None:
        conditions.append(F.col("status_code").isin(status))
    if product_uid is not None:
        conditions.append(F.col("product_uid") == product_uid)
    if contract_id is not None:
        conditions.append(F.col("contract_id") == contract_id)
    cards = _cards(db.product_instances.filter(C.all_of(*conditions)), db)
    if product_id is not None:
        cards = cards.filter(F.col("product_id") == product_id)
    return _with_names(cards, db).select(*CARD_COLUMNS)


def status_filter(shown: dict[str, bool]) -> list[str] | None:
    """Statuses picked in the status list, where picked ones carry ``show=False``; none means no filter."""
    return [code for code, show in shown.items() if not show] or None


def applications_queue(db: Tables) -> DataFrame:
    return instances(db, status=["APL"])


# --- assignment --------------------------------------------------------------------------------


def last_changes(updates: DataFrame) -> DataFrame:
    """Last stamp of each updater on each instance; partial maxima combine before the shuffle."""
    return (
        updates.select("product_uid", "update_user", "update_dt")
        .groupBy("product_uid", "update_user").agg(F.max("update_dt").alias("update_dt"))
    )


def by_staff(db: Tables, last: DataFrame) -> DataFrame:
    """Last changes made by staff, without the two system accounts."""
    staff = db.accounts.filter(
        F.col("user_role").isin(*dims.STAFF_ROLES) & ~F.col("account_id").isin(*dims.SYSTEM_ACCOUNTS)
    )
    return last.join(staff.select(F.col("account_id").alias("update_user")), "update_user")


def assignments(db: Tables) -> DataFrame:
    """(product_uid, updater_id): the staff member who last changed each instance.

    Only staff changes count, and not those of the two system accounts. When the last stamp is
    shared, every staff member with that stamp is an owner. Updates are reduced to one row per
    instance and updater before the join with staff, so neither a hot instance nor a hot updater
    sends all its changes to one task.
    """
    return newest_changers(by_staff(db, last_changes(db.product_status_updates)))


def newest_changers(last_change: DataFrame) -> DataFrame:
    """(product_uid, updater_id) with the newest stamp of ``last_change(product_uid, update_user, update_dt)``.

    Spark keeps only the best rank per key in each task before the shuffle.
    """
    newest = Window.partitionBy("product_uid").orderBy(F.desc("update_dt"))
    return (
        last_change.withColumn("rnk", F.rank().over(newest)).filter(F.col("rnk") == 1)
        .select("product_uid", F.col("update_user").alias("updater_id")).distinct()
    )


def assigned_instances(db: Tables, updater: int | None = None) -> DataFrame:
    """Cards of the instances assigned to one staff member, or to each of them with ``updater_id``."""
    owners = assignments(db)
    if updater is not None:
        mine = owners.filter(F.col("updater_id") == updater)
        rows = db.product_instances.join(mine, "product_uid", "left_semi")
        return _with_names(_cards(rows, db), db).select(*CARD_COLUMNS)
    return cards_of_owners(db, owners)


def cards_of_owners(db: Tables, owners: DataFrame) -> DataFrame:
    """Cards of the instances in ``owners(product_uid, updater_id)``."""
    rows = db.product_instances.join(owners, "product_uid")
    return _with_names(_cards(rows, db), db).select("updater_id", *CARD_COLUMNS)


def active_counts(db: Tables, preview: int = 3) -> DataFrame:
    """Active, preview and total number of assigned products for each staff member."""
    rows = assigned_instances(db).select("updater_id", "status_code")
    return rows.groupBy("updater_id").agg(
        F.count_if(C.is_active(F.col("status_code"))).alias("active"),
        F.least(F.lit(preview), F.count(F.lit(1))).cast("bigint").alias("preview"),
        F.count(F.lit(1)).alias("total"),
    )


def worklist_preview(db: Tables, n: int = 3) -> DataFrame:
    """First ``n`` assigned products of each staff member, by product uid.

    The filter on the row number lets Spark keep only ``n`` rows per key in each task before the
    shuffle, so a staff member with very many products costs no more than others.
    """
    first = Window.partitionBy("updater_id").orderBy("product_uid")
    return (
        assigned_instances(db).select("updater_id", "product_uid", "name", "status_name")
        .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= n)
        .withColumn("rn", F.col("rn").cast("bigint"))
    )


# --- detail ------------------------------------------------------------------------------------


def instance_detail(db: Tables, viewer_role: str = "E") -> DataFrame:
    """Instance facts with its application, if there is one. Revenue is shown to staff only."""
    a = db.applications.select(
        "application_id", "product_id", "approved_by", "amount_requested",
        F.col("special_notes").alias("appl_special_notes"), "collateral", "approved_yn", "approval_dt", "standard_yn",
    )
    s = db.product_statuses.select(F.col("code").alias("status_code"), "status_name", "status_description")
    rows = db.product_instances.join(a, "application_id", "left").join(s, "status_code")
    columns = [
        "product_uid", "account_id", "status_code", "status_name", "status_description", "amount", "contract_id",
        "product_start_date", "product_end_date", "actual_end_date", "special_notes", "application_id", "approved_by",
        "amount_requested", "appl_special_notes", "collateral", "approved_yn", "approval_dt", "yield", "product_id",
        C.standard_label(F.col("standard_yn")).alias("standard"),
        F.col("notifications_yn").alias("notifications"),
    ]
    if viewer_role in dims.STAFF_ROLES:
        columns += ["actual_revenue", "expected_revenue"]
    return rows.select(*columns)


def visible_instances(db: Tables, views: DataFrame) -> DataFrame:
    """Instances opened by ``views(request_id, viewer_id, product_uid)`` that the viewer may see.

    Staff see every instance, clients their own; revenue is NULL for clients.
    """
    viewers = db.accounts.select(F.col("account_id").alias("viewer_id"), "user_role")
    rows = db.product_instances.select(
        "product_uid", "account_id", "status_code", "amount", "actual_revenue", "expected_revenue"
    )
    staff = C.is_staff(F.col("user_role"))
    return (
        views.join(viewers, "viewer_id").join(rows, "product_uid")
        .filter(staff | F.coalesce(F.col("account_id") == F.col("viewer_id"), F.lit(False)))
        .select(
            "request_id", "viewer_id", "product_uid", "status_code", "amount",
            F.when(staff, F.col("actual_revenue")).alias("actual_revenue"),
            F.when(staff, F.col("expected_revenue")).alias("expected_revenue"),
        )
    )


def _status_log(db: Tables) -> DataFrame:
    """All status changes, with the application itself as the first one.

    The log holds changes only, so the first status comes from the application. Its log key is 0,
    before any logged change of the same time.
    """
    statuses = db.product_statuses.select(F.col("code").alias("is_code"), "status_name", "status_description")
    applied = (
        db.product_instances.select("product_uid", "application_id")
        .join(
            db.applications.select("application_id", F.col("account_id").alias("update_user"), F.col("application_dt").alias("update_dt")),
            "application_id",
        )
        .select(
            "product_uid", F.lit(0).cast("bigint").alias("prime_uid"), F.lit("APL").alias("is_code"), "update_dt",
            "update_user", F.lit(None).cast("string").alias("update_note"),
            F.lit(None).cast("string").alias("update_note_public_yn"),
        )
    )
    logged = db.product_status_updates.select(
        "product_uid", "prime_uid", "is_code", "update_dt", "update_user", "update_note", "update_note_public_yn"
    )
    return applied.unionByName(logged).join(statuses, "is_code")


def status_timeline(db: Tables, viewer_role: str = "E") -> DataFrame:
    """Status history of every instance with the names of those who made the changes.

    Clients read only public notes. ``is_current`` marks the last change. It is found by an aggregate
    and joined back on instance, time and log key together, so a hot instance spreads over all tasks.
    """
    log = _status_log(db)
    last = (
        log.groupBy("product_uid").agg(F.max(F.struct("update_dt", "prime_uid")).alias("last"))
        .select("product_uid", "last.update_dt", "last.prime_uid", F.lit("Y").alias("is_current"))
    )
    people = db.accounts.select(F.col("account_id").alias("update_user"), "first_name", "last_name")
    readable = (F.col("update_note_public_yn") == "Y") | F.lit(viewer_role in dims.STAFF_ROLES)
    return (
        log.join(people, "update_user", "left").join(last, ["product_uid", "update_dt", "prime_uid"], "left")
        .select(
            "product_uid", "prime_uid", "is_code", "status_name", "status_description", "update_dt", "update_user",
            "first_name", "last_name",
            F.when(readable & (F.col("update_note") != ""), F.col("update_note")).alias("note"),
            F.when(readable, F.col("update_note_public_yn")).alias("public_yn"),
            F.coalesce("is_current", F.lit("N")).alias("is_current"),
        )
    )


def instance_nested(db: Tables, viewer_role: str = "U", page_size: int | None = None) -> DataFrame:
    """Status history of each instance as one ordered array: one row per instance.

    With ``page_size`` a history goes on in further rows after so many changes, numbered by ``page_no``.
    """
    timeline = status_timeline(db, viewer_role).select(
        "product_uid", "update_dt", "prime_uid", "is_code", "status_name", "update_user", "note", "public_yn"
    )
    rows, keys = paged(timeline, ["product_uid"], ["update_dt", "prime_uid"], page_size)
    item = F.struct("update_dt", "prime_uid", "is_code", "status_name", "update_user", "note", "public_yn")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("statuses"))


def attributes_nested(db: Tables, viewer_role: str = "U", page_size: int | None = None) -> DataFrame:
    """Attribute rows of each instance as one ordered array, paged like the history."""
    from bankspark.operators.attributes import attribute_rows

    rows = attribute_rows(db, visible_only=viewer_role not in dims.STAFF_ROLES)
    rows, keys = paged(rows, ["product_uid"], ["pcc_uid"], page_size)
    item = F.struct("pcc_uid", "pcc_id", "column_name", "column_type", "int_value", "float_value", "varchar_value",
                    "text_value", "date_value", "datetime_value")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("product_custom_columns"))
