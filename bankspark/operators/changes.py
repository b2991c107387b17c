"""Writes of the back office as set operations: sales, drafts, patches, categories.

Each operator gives the rows to write and the refused requests with a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from bankspark.functions import columns as C
from bankspark.operators.attributes import AttributeChanges, update_attributes
from bankspark.operators.ordering import append_with_ids, positions_within
from bankspark.operators.rights import admin, by_right, senior, staff, staff_or_own, with_refused
from bankspark.sources import dims
from bankspark.sources.tables import Tables

DRAFT_COLUMNS = [
    "product_id", "order_no", "column_name", "customer_visible_yn", "customer_populatable_yn", "column_type",
    "default_value", "exercise_date_yn", "available_before",
]
DEF_COLUMNS = [c for c in DRAFT_COLUMNS if c != "order_no"]


# --- existence checks --------------------------------------------------------------------------


@dataclass(frozen=True)
class ForeignKey:
    name: str
    column: str
    target: DataFrame
    target_column: str


def fk_rejects(rows: DataFrame, key: str, constraints: list[ForeignKey]) -> DataFrame:
    """Rows whose reference points nowhere, one per broken constraint; NULL is no reference."""
    broken = [
        rows.filter(F.col(fk.column).isNotNull())
        .join(fk.target.select(F.col(fk.target_column).alias(fk.column)), fk.column, "left_anti")
        .select(F.col(key), F.lit(fk.name).alias("constraint_name"), F.col(fk.column).cast("string").alias("value"))
        for fk in constraints
    ]
    out = broken[0]
    for more in broken[1:]:
        out = out.unionByName(more)
    return out


def fk_accepted(rows: DataFrame, constraints: list[ForeignKey]) -> DataFrame:
    """Rows whose references all exist."""
    for fk in constraints:
        target = fk.target.select(F.col(fk.target_column).alias("_target"))
        present = rows.filter(F.col(fk.column).isNotNull()).join(target, F.col(fk.column) == F.col("_target"), "left_semi")
        rows = present.unionByName(rows.filter(F.col(fk.column).isNull()))
    return rows


# --- sales -------------------------------------------------------------------------------------


@dataclass
class Sales:
    applications: DataFrame  # new applications, with request_id
    instances: DataFrame  # new instances, with request_id
    rejects: DataFrame


def create_sales(db: Tables, requests: DataFrame, as_of: dt.datetime) -> Sales:
    """Applications and instances for ``requests(request_id, account_id, product_id, standard_yn,
    amount_requested, special_notes, collateral)``.

    The account must exist, and the product if there is one. Both tables are numbered in request order, in one pass. A new instance
    is applied for, has an empty note and partial notifications. Requests with ``user_id`` and ``user_role`` are checked:
    staff sell to anyone, clients buy for themselves.
    """
    requests, refused = by_right(requests, staff_or_own("account_id"))
    accounts = db.accounts.select("account_id")
    known = requests.join(accounts, "account_id", "left_semi")
    product = ForeignKey("unknown_product", "product_id", db.products, "product_id")
    valid = fk_accepted(known, [product])
    rejects = requests.join(accounts, "account_id", "left_anti").select(
        "request_id", F.lit("unknown_account").alias("reason")
    ).unionByName(fk_rejects(known, "request_id", [product]).select("request_id", F.col("constraint_name").alias("reason")))
    flag = F.col("standard_yn")
    rows = valid.withColumn("standard_yn", F.when(flag.isin("Y", "N"), flag).otherwise("N"))
    rows = append_with_ids(db.applications, rows, "application_id", ["request_id"])
    first = F.coalesce(db.applications.agg(F.max("application_id").alias("m")).scalar(), F.lit(0).cast("bigint"))
    base = F.lit(dims.INSTANCE_ID_BASE - 1).cast("bigint")
    last_uid = F.greatest(
        F.coalesce(db.product_instances.agg(F.max("product_uid").alias("m")).scalar(), base), base
    )
    rows = rows.withColumn("product_uid", last_uid + F.col("application_id") - first)
    none = lambda typ: F.lit(None).cast(typ)
    applications = rows.select(
        "request_id", "application_id", "account_id", "product_id",
        C.moment(as_of).alias("application_dt"), "standard_yn", "amount_requested",
        "special_notes", "collateral", none("string").alias("approved_yn"), none("bigint").alias("approved_by"),
        none("timestamp_ntz").alias("approval_dt"),
    )
    instances = rows.select(
        "request_id", "product_uid", "application_id", "account_id", none("double").alias("amount"),
        none("double").alias("yield"), F.lit("APL").alias("status_code"), none("bigint").alias("contract_id"),
        none("double").alias("expected_revenue"), none("date").alias("product_start_date"),
        none("date").alias("product_end_date"), none("string").alias("special_notes"),
        none("date").alias("actual_end_date"), none("double").alias("actual_revenue"),
        none("bigint").alias("latest_update_user_id"), F.lit("").alias("latest_note"),
        none("string").alias("latest_note_public_yn"), F.lit("P").alias("notifications_yn"),
    )
    return Sales(applications, instances, with_refused(rejects, refused))


# --- drafts ------------------------------------------------------------------------------------


def _normal_columns(columns: DataFrame) -> DataFrame:
    """Flags as Y or N, an empty default as NULL."""
    return columns.withColumns({
        "customer_visible_yn": C.yes_no(F.col("customer_visible_yn")),
        "customer_populatable_yn": C.yes_no(F.col("customer_populatable_yn")),
        "default_value": F.when(F.col("default_value") != "", F.col("default_value")),
    })


def renumber_columns(columns: DataFrame, key: str = "product_id", input_pos: str = "input_pos") -> DataFrame:
    """Attribute order as 0, 1, 2 … per product.

    A missing order and the order 0 both sort as 100; equal orders keep their input place.
    """
    place = F.when(F.coalesce(F.col("order_no"), F.lit(0)) == 0, 100).otherwise(F.col("order_no"))
    numbered = positions_within(columns.withColumn("_place", place), [key], ["_place", input_pos], "_pos")
    return numbered.withColumn("order_no", F.col("_pos") - 1).drop("_place", "_pos")


def next_order_no(db: Tables) -> DataFrame:
    """Order number the next attribute of each draft gets; 0 if it has none yet."""
    last = db.draft_product_custom_column_def.groupBy("product_id").agg(F.max("order_no").alias("last"))
    return db.products.filter(F.col("draft_yn") == "Y").join(last, "product_id", "left").select(
        "product_id", (F.coalesce("last", F.lit(-1)) + 1).cast("bigint").alias("order_no")
    )


class _OnDemand:
    """Results that are put together when they are asked for, each once."""

    def __init__(self, **results: Callable[[], DataFrame]):
        self._results = results

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._results:
            raise AttributeError(name)
        value = self._results[name]()
        setattr(self, name, value)
        return value


class Drafts(_OnDemand):
    products: DataFrame  # new or changed products
    columns: DataFrame  # attribute definitions written
    rejects: DataFrame


def create_drafts(db: Tables, requests: DataFrame, columns: DataFrame) -> Drafts:
    """New drafts from ``requests(request_id, user_id, user_role, <product columns>)``.

    ``columns(request_id, input_pos, order_no, <definition>)`` are their attributes. Availability is
    kept for senior users only, and only staff may create drafts.
    """
    allowed = C.is_staff(F.col("user_role"))
    senior = C.is_senior(F.col("user_role"))
    rows = requests.filter(allowed).select(
        "request_id", "category_id", "subcategory_id", "name", "description", "terms_and_conditions", "currency",
        "term", "percentage", "monetary_amount", "percentage_label", "mon_amt_label",
        F.when(senior, F.col("available_from")).alias("available_from"),
        F.when(senior, F.col("available_till")).alias("available_till"),
        "picture_name", F.lit("Y").alias("draft_yn"), F.col("user_id").alias("draft_owner"),
    )

    def definitions() -> DataFrame:
        placed = columns.join(drafts.products.select("request_id", "product_id"), "request_id")
        return renumber_columns(_normal_columns(placed)).select(*DRAFT_COLUMNS)

    drafts = Drafts(
        products=lambda: append_with_ids(db.products, rows, "product_id", ["request_id"]), columns=definitions,
        rejects=lambda: requests.filter(~allowed).select("request_id", F.lit("not_allowed").alias("reason")),
    )
    return drafts


def replace_draft_columns(db: Tables, requests: DataFrame, columns: DataFrame) -> Drafts:
    """Replace the attribute list of drafts.

    ``requests(product_id, user_id, user_role)`` has one row per product; ``columns(product_id,
    input_pos, order_no, <definition>)`` is the new list, which may be empty. ``columns`` of the
    result are all draft definitions afterwards.
    """
    owners = db.products.select("product_id", "draft_owner", F.lit(True).alias("_known"))
    checked = requests.join(owners, "product_id", "left")
    own = F.coalesce(F.col("draft_owner") == F.col("user_id"), F.lit(False))
    reason = (
        F.when(~C.is_staff(F.col("user_role")), "not_allowed").when(F.col("_known").isNull(), "unknown_product")
        .when(~(own | C.is_senior(F.col("user_role"))), "not_allowed")
    )
    checked = checked.withColumn("reason", reason)
    valid = checked.filter(F.col("reason").isNull()).select("product_id")

    def definitions() -> DataFrame:
        new = renumber_columns(_normal_columns(columns.join(valid, "product_id", "left_semi"))).select(*DRAFT_COLUMNS)
        kept = db.draft_product_custom_column_def.join(valid, "product_id", "left_anti").select(*DRAFT_COLUMNS)
        return kept.unionByName(new)

    return Drafts(
        products=lambda: db.products, columns=definitions,
        rejects=lambda: checked.filter(F.col("reason").isNotNull()).select("product_id", "reason"),
    )


def clone_products(db: Tables, requests: DataFrame) -> Drafts:
    """Copies of products as drafts of the requester, from ``requests(request_id, product_id, account_id)``.

    Availability is cleared; final definitions become draft definitions numbered from 1 in their order. With a
    ``user_role``, only staff may.
    """
    requests, refused = by_right(requests, staff())
    source = db.products
    known = requests.join(source, "product_id")
    copied = [c for c in source.columns if c not in ("product_id", "available_from", "available_till", "draft_yn", "draft_owner")]
    rows = known.select(
        "request_id", F.col("product_id").alias("source_product_id"), *copied,
        F.lit(None).cast("timestamp_ntz").alias("available_from"), F.lit(None).cast("timestamp_ntz").alias("available_till"),
        F.lit("Y").alias("draft_yn"), F.col("account_id").alias("draft_owner"),
    )

    def definitions() -> DataFrame:
        defs = db.product_custom_column_def.withColumnRenamed("product_id", "source_product_id")
        placed = clones.products.select("product_id", "source_product_id").join(defs, "source_product_id")
        return positions_within(placed, ["product_id"], ["pcc_id"], "order_no").select(*DRAFT_COLUMNS)

    clones = Drafts(
        products=lambda: append_with_ids(source, rows, "product_id", ["request_id"]), columns=definitions,
        rejects=lambda: with_refused(requests.join(source.select("product_id"), "product_id", "left_anti").select(
            "request_id", F.lit("unknown_product").alias("reason")
        ), refused),
    )
    return clones


class Published(_OnDemand):
    products: DataFrame  # all products afterwards
    columns: DataFrame  # new final definitions
    counts: DataFrame  # product_id, number of definitions copied
    rejects: DataFrame


def publish_drafts(db: Tables, requests: DataFrame) -> Published:
    """Publish drafts from ``requests(request_id, product_id, user_role)``.

    The product stops being a draft and loses its owner; its draft definitions are copied to the
    final ones in order. Only senior users may publish.
    """
    drafts = db.products.select("product_id", "draft_yn")
    checked = requests.join(drafts, "product_id", "left").withColumn(
        "reason",
        F.when(F.col("draft_yn").isNull(), "unknown_product").when(F.col("draft_yn") != "Y", "not_a_draft")
        .when(~C.is_senior(F.col("user_role")), "not_allowed"),
    )
    senior = requests.filter(C.is_senior(F.col("user_role"))).select("product_id").distinct()
    valid = drafts.filter(F.col("draft_yn") == "Y").select("product_id").join(senior, "product_id", "left_semi")
    marked = db.products.join(valid.withColumn("_published", F.lit(True)), "product_id", "left")
    published = F.col("_published").isNotNull()
    products = marked.withColumns({
        "draft_yn": F.when(published, "N").otherwise(F.col("draft_yn")),
        "draft_owner": F.when(~published, F.col("draft_owner")),
    }).select(*db.products.columns)
    copied = db.draft_product_custom_column_def.join(valid, "product_id", "left_semi")

    def definitions() -> DataFrame:
        columns = append_with_ids(db.product_custom_column_def, copied, "pcc_id", ["product_id", "order_no"])
        return columns.select("pcc_id", *DEF_COLUMNS)

    counts = valid.join(copied.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")), "product_id", "left").select(
        "product_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("inserted_count")
    )
    rejects = checked.filter(F.col("reason").isNotNull()).select("request_id", "product_id", "reason")
    return Published(products=lambda: products, columns=definitions, counts=lambda: counts, rejects=lambda: rejects)


def delete_drafts(db: Tables, requests: DataFrame) -> Drafts:
    """Remaining products and draft definitions after deleting the drafts in ``requests(request_id, product_id)``.

    With a ``user_role``, only staff may.
    """
    requests, refused = by_right(requests, staff(), "product_id")
    drafts = db.products.filter(F.col("draft_yn") == "Y").select("product_id")
    valid = requests.join(drafts, "product_id", "left_semi").select("product_id")
    rejects = requests.join(drafts, "product_id", "left_anti").select(
        "request_id", "product_id", F.lit("not_a_draft").alias("reason")
    )
    return Drafts(
        products=lambda: db.products.join(valid, "product_id", "left_anti"),
        columns=lambda: db.draft_product_custom_column_def.join(valid, "product_id", "left_anti"),
        rejects=lambda: with_refused(rejects, refused),
    )


def delete_subcategories(db: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining subcategories after deleting unused ones in ``requests(subcategory_id)``, and rejects."""
    known = db.product_subcategories.select("subcategory_id")
    used = db.products.filter(F.col("subcategory_id").isNotNull()).select("subcategory_id").distinct()
    asked = requests.select("subcategory_id").distinct()
    found = asked.join(known, "subcategory_id", "left_semi")
    unused = found.join(used, "subcategory_id", "left_anti")
    rejects = asked.join(known, "subcategory_id", "left_anti").withColumn("reason", F.lit("unknown_subcategory")).unionByName(
        found.join(used, "subcategory_id", "left_semi").withColumn("reason", F.lit("has_products"))
    )
    return db.product_subcategories.join(unused, "subcategory_id", "left_anti"), rejects


# --- patches -----------------------------------------------------------------------------------

NULL_TOKEN = "__null__"


@dataclass
class Patched:
    rows: DataFrame  # all rows of the table afterwards
    changed: DataFrame  # rows that took a patch
    rejects: DataFrame  # request_id, key, reason


def apply_patch(
    target: DataFrame,
    patches: DataFrame,
    key: str,
    columns: list[str],
    null_token: str | None = NULL_TOKEN,
    flags: tuple[str, ...] = (),
) -> Patched:
    """Sparse update of ``target`` by ``patches(request_id, key, <columns>)``.

    A NULL leaves the column, ``null_token`` clears it, anything else sets it; patch columns are
    strings where a token is used and are cast to the type of the target; a patch with an unreadable
    value is refused whole. Columns in ``flags`` become Y or N. Several patches of one row apply in request order: per column the last value
    given wins, which one aggregate with partial sums finds. Patches of unknown rows and patches
    without any value are refused too.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    given = [F.col(c).isNotNull() for c in columns]
    any_given = given[0]
    for g in given[1:]:
        any_given = any_given | g
    given_types = {f.name: f.dataType for f in patches.schema.fields}
    unreadable = F.lit(False)
    for c in columns:
        if given_types[c] != types[c]:
            text = F.col(c) if null_token is None else F.nullif(F.col(c).cast("string"), F.lit(null_token))
            unreadable = unreadable | (text.isNotNull() & text.try_cast(types[c]).isNull())
    problem = F.when(~any_given, "nothing_to_update").when(unreadable, "unreadable_value")
    # Reduced before the join: a row with very many patches is one row there.
    last = patches.filter(problem.isNull()).groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("request_id"))).alias("_p_" + c) for c in columns
    ], F.lit(True).alias("_patched"))
    known = target.select(key, F.lit(True).alias("_known"))
    checked = patches.join(known, key, "left").withColumn(
        "reason", F.coalesce(F.when(F.col("_known").isNull(), f"unknown_{key}"), problem)
    )

    def value(c: str) -> Column:
        patch = F.col("_p_" + c)
        if c in flags:
            new = C.yes_no(patch)
        elif null_token is None:
            new = patch.try_cast(types[c])
        else:
            new = F.nullif(patch.cast("string"), F.lit(null_token)).try_cast(types[c])
        return F.when(patch.isNotNull(), new).otherwise(F.col(c)).alias(c)

    joined = target.join(last, key, "left")
    after = [value(c) if c in columns else F.col(c) for c in target.columns]
    return Patched(
        joined.select(*after),
        joined.filter(F.col("_patched")).select(*after),
        checked.filter(F.col("reason").isNotNull()).select("request_id", key, "reason"),
    )


PRODUCT_PATCH = [
    "category_id", "subcategory_id", "name", "description", "currency", "term", "percentage", "monetary_amount",
    "percentage_label", "mon_amt_label", "available_from", "available_till", "picture_name", "draft_owner",
    "terms_and_conditions",
]
INSTANCE_PATCH = [
    "amount", "yield", "contract_id", "expected_revenue", "product_start_date", "product_end_date", "special_notes",
    "actual_end_date", "actual_revenue",
]


def _with_missing(patches: DataFrame, columns: list[str]) -> DataFrame:
    """Patches given for some columns only."""
    absent = {c: F.lit(None).cast("string") for c in columns if c not in patches.columns}
    return patches.withColumns(absent) if absent else patches


def _refusing(done: Patched, refused: DataFrame | None) -> Patched:
    return Patched(done.rows, done.changed, with_refused(done.rejects, refused))


def patch_products(db: Tables, patches: DataFrame) -> Patched:
    """Patches of products; with a ``user_role``, only administrators may."""
    patches, refused = by_right(patches, admin(), "product_id")
    return _refusing(apply_patch(db.products, _with_missing(patches, PRODUCT_PATCH), "product_id", PRODUCT_PATCH), refused)


def patch_instances(db: Tables, patches: DataFrame) -> Patched:
    """Patches of instances; with a ``user_role``, only staff may."""
    patches, refused = by_right(patches, staff(), "product_uid")
    done = apply_patch(
        db.product_instances, _with_missing(patches, INSTANCE_PATCH), "product_uid", INSTANCE_PATCH, null_token=None
    )
    return _refusing(done, refused)


@dataclass
class InstancePatch:
    instances: Patched
    attributes: AttributeChanges


def patch_instances_with_attributes(db: Tables, patches: DataFrame, values: DataFrame) -> InstancePatch:
    """Patches of instances that may carry attribute values, or nothing else.

    ``values(request_id, pcc_uid, <the six value columns>)`` belong to the patches by ``request_id``. A patch with values
    has something to update even if it sets no column; of patches that are refused for another reason, nothing is
    written. Values are written as staff writes them.
    """
    with_values = values.select("request_id").distinct().withColumn("_values", F.lit(True))
    done = patch_instances(db, patches)
    marked = done.rejects.join(with_values, "request_id", "left")
    only_values = (F.col("reason") == "nothing_to_update") & F.col("_values").isNotNull()
    rejects = marked.filter(~only_values).drop("_values")
    passed = patches.join(rejects, "request_id", "left_anti").select("request_id", "product_uid")
    # A value is written only through a patch of its own instance.
    own = db.product_custom_column_values.select("pcc_uid", "product_uid")
    meant = values.join(passed, "request_id").join(own, ["pcc_uid", "product_uid"], "left_semi").drop("product_uid")
    columns = ["request_id", "product_uid", "reason"]
    return InstancePatch(
        Patched(done.rows, done.changed, rejects.select(*columns)), update_attributes(db, meant.select(values.columns), is_client=False))


def patch_categories(db: Tables, patches: DataFrame) -> Patched:
    """Patches of categories; with a ``user_role``, only senior users may."""
    patches, refused = by_right(patches, senior(), "category_id")
    columns = ["category_name", "description", "catalog_yn"]
    done = apply_patch(
        db.product_categories, _with_missing(patches, columns), "category_id", columns, None, flags=("catalog_yn",)
    )
    return _refusing(done, refused)


def patch_subcategories(db: Tables, patches: DataFrame) -> Patched:
    """Subcategory patches; a new category must exist, or the patch is refused whole.

    With a ``user_role``, only senior users may.
    """
    patches, refused = by_right(patches, senior(), "subcategory_id")
    columns = ["category_id", "subcategory_name", "subcategory_description", "catalog_yn"]
    patches = _with_missing(patches, columns)
    fk = ForeignKey("unknown_category", "category_id", db.product_categories, "category_id")
    done = apply_patch(
        db.product_subcategories, fk_accepted(patches, [fk]), "subcategory_id", columns, None, flags=("catalog_yn",)
    )
    unknown = patches.filter(F.col("category_id").isNotNull()).join(
        db.product_categories.select("category_id"), "category_id", "left_anti"
    ).select("request_id", "subcategory_id", F.lit("unknown_category").alias("reason"))
    return Patched(done.rows, done.changed, with_refused(done.rejects.unionByName(unknown), refused))


def patch_drafts(db: Tables, patches: DataFrame) -> Patched:
    """Patches of drafts; other products are refused. With a ``user_role``, only staff may."""
    patches, not_allowed = by_right(patches, staff(), "product_id")
    drafts = db.products.filter(F.col("draft_yn") == "Y").select("product_id")
    is_draft = F.coalesce(F.col("draft_yn") == "Y", F.lit(False))
    done = apply_patch(
        db.products.filter(is_draft), _with_missing(patches, PRODUCT_PATCH), "product_id", PRODUCT_PATCH, None
    )
    known = db.products.select("product_id", F.lit(True).alias("_known"))
    refused = patches.join(drafts, "product_id", "left_anti").join(known, "product_id", "left").select(
        "request_id", "product_id",
        F.when(F.col("_known").isNull(), "unknown_product").otherwise("not_a_draft").alias("reason"),
    )
    bad_values = done.rejects.filter(F.col("reason") != "unknown_product_id")
    return Patched(
        done.rows.unionByName(db.products.filter(~is_draft)), done.changed,
        with_refused(bad_values.unionByName(refused), not_allowed)
    )


def set_availability(db: Tables, requests: DataFrame) -> Patched:
    """Overwrite both availability dates from ``requests(request_id, product_id, available_from, available_till)``.

    With a ``user_role``, only senior users may.
    """
    requests, refused = by_right(requests, senior(), "product_id")
    known = db.products.select("product_id")
    last = requests.groupBy("product_id").agg(
        F.max_by(F.struct("available_from", "available_till"), "request_id").alias("_dates")
    )
    joined = db.products.join(last, "product_id", "left")
    given = F.col("_dates").isNotNull()
    after = [
        F.when(given, F.col("_dates." + c).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c)
        if c in ("available_from", "available_till") else F.col(c)
        for c in db.products.columns
    ]
    rejects = requests.join(known, "product_id", "left_anti").select(
        "request_id", "product_id", F.lit("unknown_product").alias("reason")
    )
    return Patched(joined.select(*after), joined.filter(given).select(*after), with_refused(rejects, refused))


def set_notification_pref(db: Tables, requests: DataFrame) -> Patched:
    """Notification preference from ``requests(request_id, product_uid, user_id, user_role, preference)``."""
    owners = db.product_instances.select("product_uid", "account_id", F.lit(True).alias("_known"))
    valid = F.coalesce(F.col("preference").isin("Y", "N", "P"), F.lit(False))
    may = C.is_staff(F.col("user_role")) | F.coalesce(F.col("account_id") == F.col("user_id"), F.lit(False))
    checked = requests.join(owners, "product_uid", "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), "unknown_instance").when(~may, "not_allowed")
        .when(~valid, "unknown_preference"),
    )
    # Last request of each user first, so that a hot instance brings at most one row per user to the join.
    by_user = requests.filter(valid).groupBy("product_uid", "user_id", "user_role").agg(
        F.max(F.struct("request_id", "preference")).alias("last")
    )
    accepted = by_user.join(owners, "product_uid").filter(may).select(
        "last.request_id", "product_uid", F.col("last.preference").alias("notifications_yn")
    )
    done = apply_patch(db.product_instances, accepted, "product_uid", ["notifications_yn"], None)
    refused = checked.filter(F.col("reason").isNotNull()).select("request_id", "product_uid", "reason")
    return Patched(done.rows, done.changed, done.rejects.unionByName(refused))


def patch_accounts(db: Tables, patches: DataFrame) -> Patched:
    """Contact data from ``patches(request_id, account_id, phone, email, country_code, address)``.

    Fields are checked in this order and written up to the first bad one: phone of at most 15
    characters, e-mail of at most 255, country one of the three codes. A new e-mail revokes the
    verification.
    """
    phone_bad = F.coalesce(F.length("phone") > 15, F.lit(False))
    email_bad = F.coalesce(F.length("email") > 255, F.lit(False))
    country_bad = F.coalesce(~F.col("country_code").isin(*dims.COUNTRY_CODES), F.lit(False))
    problem = F.when(phone_bad, "phone_too_long").when(email_bad, "email_too_long").when(country_bad, "unknown_country")
    known = db.accounts.select("account_id")
    usable = patches.select(
        "request_id", "account_id",
        F.when(~phone_bad, F.col("phone")).alias("phone"),
        F.when(~(phone_bad | email_bad), F.col("email")).alias("email"),
        F.when(~(phone_bad | email_bad | country_bad), F.col("country_code")).alias("country_code"),
        F.when(~(phone_bad | email_bad | country_bad), F.col("address")).alias("address"),
    ).withColumn("verification", F.when(F.col("email").isNotNull(), "R"))
    columns = ["phone", "email", "country_code", "address", "verification"]
    done = apply_patch(db.accounts, usable, "account_id", columns, None)
    bad = patches.withColumn("reason", problem).filter(F.col("reason").isNotNull()).join(known, "account_id", "left_semi")
    refused = bad.select("request_id", "account_id", "reason").unionByName(
        patches.join(known, "account_id", "left_anti").select("request_id", "account_id", F.lit("unknown_account_id").alias("reason"))
    )
    return Patched(done.rows, done.changed, refused)


# --- category codes ----------------------------------------------------------------------------

_CODE_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def assign_category_codes(db: Tables, requests: DataFrame) -> DataFrame:
    """Codes for new categories from ``requests(request_id, category_id)``.

    The first three characters are taken if free; of several requests for one code the first gets
    it. The others keep their first character and get its free two-character endings in order, by
    request. When a first character has no ending left the code is NULL.
    """
    rows = requests.select(
        "request_id", F.substring("category_id", 1, 3).alias("code"), F.substring("category_id", 1, 1).alias("initial")
    )
    existing = db.product_categories.select(F.col("category_id").alias("code"))
    winners = rows.join(existing, "code", "left_anti").groupBy("code").agg(F.min("request_id").alias("request_id"))
    losers = rows.select("request_id", "initial").join(winners, "request_id", "left_anti")
    ranked = positions_within(losers, ["initial"], ["request_id"], "_n")
    chars = F.array(*[F.lit(c) for c in _CODE_CHARS])
    endings = F.flatten(F.transform(chars, lambda a: F.transform(chars, lambda b: F.concat(a, b))))
    free = (
        losers.select("initial").distinct()
        .select("initial", F.explode(endings).alias("ending"))
        .withColumn("code", F.concat("initial", "ending"))
        .join(existing, "code", "left_anti").join(winners.select("code"), "code", "left_anti")
    )
    # At most 1,296 endings per first character.
    free = positions_within(free, ["initial"], ["ending"], "_n")
    given = ranked.join(free, ["initial", "_n"], "left").select("request_id", F.col("code").alias("category_id"))
    return winners.select("request_id", F.col("code").alias("category_id")).unionByName(given)


@dataclass
class NewCategories:
    categories: DataFrame
    rejects: DataFrame


def create_categories(db: Tables, requests: DataFrame) -> NewCategories:
    """New categories from ``requests(request_id, category_id, category_name, description, catalog_yn)``."""
    coded = assign_category_codes(db, requests)
    rows = requests.drop("category_id").join(coded, "request_id")
    return NewCategories(
        rows.filter(F.col("category_id").isNotNull()).select(
            "request_id", "category_id", "category_name", "description", C.yes_no(F.col("catalog_yn")).alias("catalog_yn")
        ),
        rows.filter(F.col("category_id").isNull()).select("request_id", F.lit("no_code_left").alias("reason")),
    )


def create_subcategories(db: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New subcategories with keys, for categories that exist, and the rejects."""
    fk = ForeignKey("unknown_category", "category_id", db.product_categories, "category_id")
    known = db.product_categories.select("category_id")
    rows = requests.join(known, "category_id", "left_semi").select(
        "request_id", "category_id", "subcategory_name", "subcategory_description",
        C.yes_no(F.col("catalog_yn")).alias("catalog_yn"),
    )
    new = append_with_ids(db.product_subcategories, rows, "subcategory_id", ["request_id"])
    return new, fk_rejects(requests, "request_id", [fk])
