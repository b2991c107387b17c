"""Product catalogue: categories, products, drafts, attribute lists and editing rights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from bankspark.functions import columns as C
from bankspark.sources.tables import Tables

PRODUCT_COLUMNS = [
    "product_id", "category_id", "category_name", "name", "description", "terms_and_conditions",
    "currency", "term", "percentage", "monetary_amount", "percentage_label", "mon_amt_label",
    "available_from", "available_till", "picture_name", "subcategory_id", "draft_yn", "draft_owner",
]


def categories(db: Tables, only_catalog: str = "Y") -> DataFrame:
    """Categories in the catalogue; exactly ``'N'`` shows all."""
    rows = db.product_categories
    return rows if only_catalog == "N" else rows.filter(F.col("catalog_yn") == "Y")


def _with_category(products: DataFrame, db: Tables, how: str) -> DataFrame:
    names = db.product_categories.select("category_id", "category_name")
    return products.join(names, "category_id", how).withColumn(
        "picture_name", C.nvl(F.col("picture_name"), F.col("category_id"))
    )


def catalog(
    db: Tables,
    as_of: dt.datetime,
    category_id: str | None = None,
    subcategory_id: int | None = None,
    only_active: str = "Y",
    include_drafts: str = "N",
) -> DataFrame:
    """Products of the catalogue.

    Active means ``available_from`` is not after ``as_of`` and ``available_till`` is missing or not
    before it; a product without ``available_from`` is never active, and a last day given as
    midnight ends at 00:00. Including drafts needs a senior viewer, which the caller checks.
    """
    p = db.products
    now = C.moment(as_of)
    conditions = []
    if only_active == "Y":
        conditions += [F.col("available_from") <= now, C.nvl(F.col("available_till"), now) >= now]
    if include_drafts != "Y":
        conditions.append(F.col("draft_yn") == "N")
    if category_id is not None:
        conditions.append(F.col("category_id") == category_id)
    if subcategory_id is not None:
        conditions.append(F.col("subcategory_id") == subcategory_id)
    return _with_category(p.filter(C.all_of(*conditions)), db, "inner").select(*PRODUCT_COLUMNS)


def drafts(db: Tables, owner: int | None = None) -> DataFrame:
    """Draft products of one owner, or of all."""
    condition = F.col("draft_yn") == "Y"
    if owner is not None:
        condition &= F.col("draft_owner") == owner
    return _with_category(db.products.filter(condition), db, "inner").select(*PRODUCT_COLUMNS)


def drafts_preview(db: Tables, n: int = 3) -> DataFrame:
    """First ``n`` drafts of each owner, by product id; only ``n`` rows per owner and task are shuffled."""
    first = Window.partitionBy("draft_owner").orderBy("product_id")
    return (
        drafts(db).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= n)
        .select("draft_owner", "product_id", "name", "category_name", F.col("rn").cast("bigint").alias("rn"))
    )


def drop_downs(db: Tables) -> dict[str, DataFrame]:
    """Choices for forms: roles, verifications, groups with the default first, statuses in order."""
    return {
        "user_role": db.user_roles.select("role", "description"),
        "verifications": db.verifications.select("verification_status", "description"),
        "account_groups": db.account_groups.orderBy(F.desc("default_yn")),
        "statuses": db.product_statuses.orderBy("order_no").drop("order_no"),
    }


def terms_display(db: Tables) -> DataFrame:
    """Standard terms as shown on the product page; a missing one is not shown."""
    return db.products.select(
        "product_id",
        F.concat(F.col("term").cast("string"), F.lit(" month(s)")).alias("term"),
        "percentage_label",
        F.when(F.col("percentage").isNotNull(), F.format_string("%.2f%%", 100 * F.col("percentage"))).alias("percentage"),
        "mon_amt_label",
        F.when(
            F.col("monetary_amount").isNotNull(), F.concat("currency", F.format_string("%.2f", F.col("monetary_amount")))
        ).alias("monetary_amount"),
    )


def catalog_display(products: DataFrame) -> DataFrame:
    """Availability dates as shown in the catalogue manager."""
    return products.select(
        "product_id",
        C.shown_date(F.col("available_from")).alias("available_from"),
        C.shown_date(F.col("available_till")).alias("available_till"),
    )


def product_detail(db: Tables, viewer_role: str = "U", viewer_id: int | None = None) -> DataFrame:
    """Every product page the viewer may open, one row per attribute (or one with none).

    Drafts list their draft definitions and are open to their owner and to senior roles. Final
    products list their final definitions; only staff see the hidden ones.
    """
    p = _with_category(db.products, db, "left")
    if viewer_role not in ("A", "C"):
        own = F.lit(False) if viewer_id is None else F.col("draft_owner") == viewer_id
        p = p.filter((F.col("draft_yn") != "Y") | F.coalesce(own, F.lit(False)))
    listed = ["product_id", "column_name", "customer_visible_yn", "customer_populatable_yn", "column_type",
              "default_value", "exercise_date_yn", "available_before"]
    final = db.product_custom_column_def
    if viewer_role not in ("A", "C", "E"):
        final = final.filter(F.col("customer_visible_yn") == "Y")
    attributes = final.select(F.lit("N").alias("draft_yn"), F.col("pcc_id").alias("attr_id"), *listed).unionByName(
        db.draft_product_custom_column_def.select(
            F.lit("Y").alias("draft_yn"), F.col("order_no").alias("attr_id"), *listed
        )
    )
    return p.join(attributes, ["product_id", "draft_yn"], "left").select(
        "product_id", "category_id", "category_name", "name", "description", "terms_and_conditions", "currency", "term",
        "percentage", "percentage_label", "monetary_amount", "mon_amt_label", "available_from", "available_till", "picture_name", "draft_yn", "draft_owner",
        "attr_id", "column_name", "customer_visible_yn", "customer_populatable_yn", "column_type",
        "default_value", "exercise_date_yn", "available_before",
    )


def publishable_attributes(db: Tables) -> DataFrame:
    """Attributes shown on the public product page: visible, with a default that is not empty."""
    return db.product_custom_column_def.filter(
        (F.col("default_value") != "") & (F.col("customer_visible_yn") == "Y")
    ).select("product_id", "pcc_id", "column_name", "default_value")


def subcategory_counts(db: Tables, category_id: str | None = None, only_catalog: str = "Y") -> DataFrame:
    """Subcategories with their number of products, drafts and expired ones included; none gives 0."""
    sub = db.product_subcategories
    if category_id is not None:
        sub = sub.filter(F.col("category_id") == category_id)
    if only_catalog != "N":
        sub = sub.filter(F.col("catalog_yn") == "Y")
    counts = (
        db.products.filter(F.col("subcategory_id").isNotNull())
        .groupBy("subcategory_id").agg(F.count("product_id").alias("product_count"))
    )
    return sub.join(counts, "subcategory_id", "left").select(
        "subcategory_id", "category_id", "subcategory_name", "subcategory_description", "catalog_yn",
        F.coalesce("product_count", F.lit(0)).cast("bigint").alias("product_count"),
    )


def subcategory_labels(db: Tables) -> DataFrame:
    """Subcategories with the name shown in the product form."""
    label = F.when(
        F.col("catalog_yn") == "N", F.concat("subcategory_name", F.lit(" (Not in Catalog)"))
    ).otherwise(F.col("subcategory_name"))
    return db.product_subcategories.select(
        "subcategory_id", "category_id", "subcategory_name", "catalog_yn", label.alias("display_name")
    )


def product_subcategory_options(db: Tables) -> DataFrame:
    """For each product, the labelled subcategories of its category, with the chosen one marked."""
    chosen = F.col("p.subcategory_id").eqNullSafe(F.col("s.subcategory_id"))
    return (
        db.products.alias("p").join(subcategory_labels(db).alias("s"), F.col("p.category_id") == F.col("s.category_id"))
        .select("p.product_id", "s.subcategory_id", "s.display_name", F.when(chosen, "Y").otherwise("N").alias("chosen_yn"))
    )


def edit_privilege(db: Tables, views: DataFrame) -> DataFrame:
    """What each viewer may edit on the product page opened.

    ``views(request_id, product_id, viewer_id)`` are page views. Drafts are fully editable for their
    owner and senior roles; of a published product an administrator edits the properties and a
    C-level executive the availability. Everyone else gets a preview.
    """
    role = F.col("user_role")
    may_edit_draft = F.coalesce(F.col("draft_owner") == F.col("viewer_id"), F.lit(False)) | C.is_senior(role)
    privilege = (
        F.when((F.col("draft_yn") == "Y") & may_edit_draft, "all")
        .when(F.col("draft_yn") == "Y", "preview")
        .when(role == "A", "properties")
        .when(role == "C", "availability")
        .otherwise("preview")
    )
    viewers = db.accounts.select(F.col("account_id").alias("viewer_id"), "user_role")
    return (
        views.join(db.products.select("product_id", "draft_yn", "draft_owner"), "product_id")
        .join(viewers, "viewer_id")
        .select("request_id", "product_id", "viewer_id", privilege.alias("privilege"))
    )


def categories_reversed(db: Tables) -> DataFrame:
    """Categories from the last to the first, as the start page lists them, with their numbers of products."""
    counts = db.products.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_products"))
    # A code list: a handful of rows.
    place = F.row_number().over(Window.orderBy(F.desc("category_id")))
    return db.product_categories.join(counts, "category_id", "left").select(
        "category_id", "category_name", "description", F.coalesce("n_products", F.lit(0).cast("bigint")).alias("n_products"),
        place.cast("bigint").alias("position"))
