"""Registered queries: every operator over the whole mapped tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from bankspark.functions import columns as C
from bankspark.operators import accounts, attributes, capture, catalog, changes, contracts, instances, lifecycle, notices
from bankspark.operators.key_blocks import KeyBlocks, append_with_reserved_ids
from bankspark.operators.ordering import append_with_ids
from bankspark.operators.search_index import SearchIndex
from bankspark.session import scratch_dir, tune
from bankspark.sources import dated, schemas
from bankspark.sources.tables import MappedTables, append_rows
from bankspark.streaming import feeds, stateful

AS_OF = dt.date(2024, 1, 15)
AS_OF_TIME = dt.datetime(2024, 1, 15, 10, 0, 0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[MappedTables], DataFrame]) -> Query:
    """Register a query under the name of its function."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return build(MappedTables(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


# --- catalogue ---------------------------------------------------------------------------------


@query
def catalog_active(db):
    return catalog.catalog(db, AS_OF_TIME)


@query
def catalog_all(db):
    return catalog.catalog(db, AS_OF_TIME, only_active="N", include_drafts="Y")


@query
def catalog_display(db):
    return catalog.catalog_display(catalog.catalog(db, AS_OF_TIME, only_active="N"))


@query
def drafts_by_owner(db):
    return catalog.drafts(db)


@query
def drafts_preview(db):
    return catalog.drafts_preview(db)


@query
def product_terms(db):
    return catalog.terms_display(db)


@query
def product_detail(db):
    return catalog.product_detail(db, viewer_role="C")


@query
def product_detail_public(db):
    return catalog.product_detail(db, viewer_role="U")


@query
def publishable_attributes(db):
    return catalog.publishable_attributes(db)


@query
def subcategory_counts(db):
    return catalog.subcategory_counts(db, only_catalog="N")


@query
def subcategory_labels(db):
    return catalog.product_subcategory_options(db)


@query
def edit_privilege(db):
    return catalog.edit_privilege(db, db.view("product_views"))


# --- accounts ----------------------------------------------------------------------------------


@query
def account_profile(db):
    return accounts.account_profile(db)


@query
def accounts_filtered(db):
    return accounts.accounts(db, country=["BGR", "USA"], role=["U", "E"], verification=["Y", "N"])


@query
def unverified_accounts(db):
    return accounts.unverified_accounts(db)


@query
def staff_accounts(db):
    return accounts.staff_accounts(db)


@query
def country_label(db):
    return accounts.account_profile(db).select("account_id", "country_code", "country")


@query
def verification_badge(db):
    return accounts.account_profile(db).select("account_id", "verification_code", "verification_emoji")


@query
def account_search(db):
    return accounts.search_accounts(db, db.view("search_requests"))


@query
def account_search_index(db):
    """Searches with a criterion, by the stored index."""
    index = SearchIndex(db.spark, scratch_dir(db.spark, "search"))
    index.build(db.accounts)
    return accounts.search_in_parts(db, db.view("loose_search_requests"), index.search).found


@query
def account_search_changed(db):
    """The same after changes of groups, which the index has taken in."""
    index = SearchIndex(db.spark, scratch_dir(db.spark, "search"))
    index.build(db.accounts)
    done = accounts.change_groups(db, db.view("group_requests"))
    changed = done.changed
    index.update(0, db.accounts.join(changed.select("account_id"), "account_id", "left_semi"), changed)
    return accounts.search_in_parts(db.replace(accounts=done.accounts), db.view("search_requests"), index.search).found


@query
def account_search_unrestricted(db):
    return accounts.search_in_parts(db, db.view("loose_search_requests")).unrestricted


@query
def account_search_everyone(db):
    return accounts.search_in_parts(db, db.view("loose_search_requests")).everyone


@query
def new_accounts(db):
    return accounts.create_accounts(db, db.view("signups"), AS_OF_TIME)


@query
def latest_account_by_name(db):
    new = accounts.create_accounts(db, db.view("signups"), AS_OF_TIME)
    names = ["account_id", "first_name", "last_name"]
    return accounts.latest_account_by_name(db.accounts.select(*names).unionByName(new.select(*names)))


@query
def role_groups(db):
    return accounts.change_roles(db, db.view("role_requests")).changed.select("account_id", "user_role", "account_group")


@query
def role_rejects(db):
    return accounts.change_roles(db, db.view("role_requests")).rejects


@query
def group_changes(db):
    return accounts.change_groups(db, db.view("group_requests")).changed.select("account_id", "account_group")


@query
def verification_changes(db):
    done = accounts.change_verification(db, db.view("verification_requests"))
    return done.changed.select("account_id", "verification")


@query
def verification_rejects(db):
    return accounts.change_verification(db, db.view("verification_requests")).rejects


# --- instances ---------------------------------------------------------------------------------


@query
def product_cards(db):
    return instances.product_cards(db)


@query
def account_products(db):
    return instances.account_products(db)


@query
def instances_filtered(db):
    return instances.instances(db, status=["NOR", "DUE", "EXC", "ORD"])


@query
def applications_queue(db):
    return instances.applications_queue(db)


@query
def assigned_instances(db):
    return instances.assigned_instances(db)


@query
def assigned_instances_ties(db):
    """Stamps cut to the day, so that several staff members share the last one."""
    by_day = db.product_status_updates.withColumn("update_dt", F.date_trunc("day", "update_dt"))
    return instances.assigned_instances(db.replace(product_status_updates=by_day))


@query
def active_counts(db):
    return instances.active_counts(db)


@query
def worklist_preview(db):
    return instances.worklist_preview(db)


@query
def visible_instances(db):
    return instances.visible_instances(db, db.view("instance_views"))


@query
def instance_detail(db):
    return instances.instance_detail(db)


@query
def status_timeline(db):
    return instances.status_timeline(db)


@query
def status_timeline_public(db):
    return instances.status_timeline(db, viewer_role="U")


@query
def instance_nested(db):
    """Nested histories, each array written out as text so that it can be compared."""
    nested = instances.instance_nested(db, viewer_role="U")
    shown = F.transform(
        "statuses", lambda s: F.concat_ws("|", s["is_code"], F.coalesce(s["note"], F.lit("-")), s["prime_uid"].cast("string"))
    )
    return nested.select(
        "product_uid", "page_no", F.size("statuses").cast("bigint").alias("n_statuses"), F.array_join(shown, ";").alias("statuses")
    )


@query
def attributes_nested(db):
    nested = instances.attributes_nested(db, viewer_role="U")
    shown = F.transform("product_custom_columns", lambda c: F.concat_ws("|", c["pcc_uid"].cast("string"), c["column_name"]))
    return nested.select(
        "product_uid", "page_no", F.size("product_custom_columns").cast("bigint").alias("n_columns"),
        F.array_join(shown, ";").alias("columns"),
    )


@query
def attribute_values(db):
    """Values as text, and the number itself where text would differ between engines."""
    rows = attributes.attribute_rows(db, visible_only=True)
    text = F.when(F.col("column_type") != "float", C.attribute_text(F.col("column_type")))
    return rows.select("product_uid", "pcc_uid", "column_name", text.alias("value"), F.col("float_value").alias("number"))


@query
def attributes_wide(db):
    return attributes.attributes_wide(db, ["Return Rule", "Opening Day", "Share Class"]).toDF(
        "product_uid", "pay_off_formula", "first_observation_date", "share_class"
    )


# --- lifecycle ---------------------------------------------------------------------------------


@query
def next_actions(db):
    return lifecycle.next_actions(db)


@query
def progression(db):
    return lifecycle.progression(db)


@query
def client_actions(db):
    return lifecycle.client_actions(db)


@query
def apply_status(db):
    after = lifecycle.apply_status_changes(db, db.view("status_requests")).instances
    return after.select("product_uid", "status_code", "latest_update_user_id", "latest_note", "latest_note_public_yn")


@query
def apply_status_fold(db):
    return lifecycle.apply_status_changes(db, db.view("status_requests")).audit


@query
def apply_status_rejects(db):
    return lifecycle.apply_status_changes(db, db.view("status_requests")).rejects


@query
def apply_status_approvals(db):
    after = lifecycle.apply_status_changes(db, db.view("status_requests")).applications
    return after.select("application_id", "approved_yn", "approved_by", "approval_dt")


@query
def apply_client_status(db):
    done = lifecycle.apply_client_changes(db, db.view("status_requests"))
    return done.decisions.select("product_uid", "request_id", "was", "new_status", "ok", "reason")


@query
def audit_rows(db):
    return lifecycle.audit_rows(db.product_instances, db.view("instances_after"), AS_OF_TIME)


@query
def sweep_due(db):
    return lifecycle.sweep_due(db, AS_OF)


@query
def sweep_overdue(db):
    return lifecycle.sweep_overdue(db, AS_OF)


@query
def sweep_exercise(db):
    return lifecycle.sweep_exercise(db, AS_OF)


@query
def sweep_back(db):
    return lifecycle.sweep_back_to_normal(db, AS_OF)


def _two_exercise_dates(db):
    """A second attribute row, so that some instances have exercise dates on two days running."""
    values = db.product_custom_column_values
    next_day = values.filter(F.col("date_value").isNotNull()).withColumns({
        "pcc_uid": -F.col("pcc_uid"), "date_value": F.date_add("date_value", 1)
    })
    return db.replace(product_custom_column_values=values.unionByName(next_day))


@query
def nightly_status(db):
    after = lifecycle.nightly(_two_exercise_dates(db), AS_OF).instances
    return after.select("product_uid", "status_code", "latest_update_user_id", "latest_note")


@query
def nightly_audit(db):
    audit = lifecycle.nightly(_two_exercise_dates(db), AS_OF).audit
    return audit.select("product_uid", "step", "was_status", "is_code")


@query
def sweep_summary(db):
    return lifecycle.sweep_summary(lifecycle.nightly(_two_exercise_dates(db), AS_OF))


@query
def sweep_summary_observed(db):
    """Counted while the night's instances are written."""
    counts = Observation()
    night = lifecycle.nightly(_two_exercise_dates(db), AS_OF, counts=counts)
    night.instances.write.parquet(scratch_dir(db.spark, "night"))
    return lifecycle.observed_summary(db.spark, counts)


@query
def nightly_audit_dated(db):
    """The night on instances stored by end date."""
    db, path = _two_exercise_dates(db), scratch_dir(db.spark, "dated")
    dated.store_dated(db, path)
    return dated.nightly_dated(db, path, AS_OF).audit.select("product_uid", "step", "was_status", "is_code")


@query
def audit_rows_hashed(db):
    """Audit rows of two stored snapshots, compared by the digests of their buckets."""
    path = scratch_dir(db.spark, "hashed")
    capture.write_hashed(db.product_instances.select(capture.AUDITED), path, 0, buckets=32)
    capture.write_hashed(db.view("instances_after").select(capture.AUDITED), path, 1, buckets=32)
    return capture.audit_rows_between(db.spark, path, 0, 1, AS_OF_TIME)


@query
def reserved_ids(db):
    """Two appends to one table, each with keys of its own."""
    blocks = KeyBlocks(db.spark, scratch_dir(db.spark, "keys"), base=5000)
    rows = db.product_status_updates.select("product_uid", "is_code", F.col("prime_uid").alias("source_uid"))
    parts = [rows.filter(F.col("is_code") == "APR"), rows.filter(F.col("is_code") != "APR")]
    first, second = (append_with_reserved_ids(blocks, f"part-{k}", part, "prime_uid", ["source_uid"]) for k, part in enumerate(parts))
    return first.unionByName(second)


# --- notices -----------------------------------------------------------------------------------


@query
def status_notifications(db):
    log = db.product_status_updates.withColumnRenamed("prime_uid", "change_id")
    return notices.status_notifications(db, log)


@query
def status_notifications_client(db):
    log = db.product_status_updates.withColumnRenamed("prime_uid", "change_id")
    return notices.status_notifications(db, log, by_client=True)


@query
def notify_due(db):
    return notices.due_notices(db, AS_OF)


@query
def contract_notices(db):
    signed = contracts.sign_contracts(db, db.view("sign_requests"), AS_OF_TIME).audit
    return notices.contract_notices(db, signed)


@query
def notify_overdue(db):
    return notices.overdue_notices(db)


# --- changes -----------------------------------------------------------------------------------


def _sale_keys(db):
    return [
        changes.ForeignKey("unknown_account", "account_id", db.accounts, "account_id"),
        changes.ForeignKey("unknown_product", "product_id", db.products, "product_id"),
    ]


@query
def fk_rejects(db):
    return changes.fk_rejects(db.view("sale_requests"), "request_id", _sale_keys(db))


@query
def append_ids(db):
    rows = db.product_status_updates.select("product_uid", "is_code", "update_dt", F.col("prime_uid").alias("source_uid"))
    return append_with_ids(db.product_status_updates, rows, "prime_uid", ["update_dt", "source_uid"], base=5000)


@query
def new_sales(db):
    sales = changes.create_sales(db, db.view("sale_requests"), AS_OF_TIME)
    applied = sales.applications.select("request_id", "application_id", "product_id", "standard_yn", "amount_requested", "collateral")
    held = sales.instances.select(
        "application_id", "product_uid", "account_id", "status_code", "latest_note", "notifications_yn"
    )
    return applied.join(held, "application_id")


@query
def sale_rejects(db):
    return changes.create_sales(db, db.view("sale_requests"), AS_OF_TIME).rejects


@query
def init_attributes(db):
    return attributes.init_attributes(db, db.product_instances)


@query
def update_attributes(db):
    return attributes.update_attributes(db, db.view("attribute_requests")).changed


@query
def update_attributes_rejects(db):
    return attributes.update_attributes(db, db.view("attribute_requests")).rejects


@query
def clone_products(db):
    return changes.clone_products(db, db.view("clone_requests")).products


@query
def clone_product_columns(db):
    return changes.clone_products(db, db.view("clone_requests")).columns


@query
def publish_drafts(db):
    return changes.publish_drafts(db, db.view("publish_requests")).columns


@query
def publish_draft_products(db):
    return changes.publish_drafts(db, db.view("publish_requests")).products.select("product_id", "draft_yn", "draft_owner")


@query
def replace_draft_columns(db):
    return changes.replace_draft_columns(db, db.view("draft_column_requests"), db.view("draft_column_inputs")).columns


@query
def renumber_columns(db):
    return changes.renumber_columns(db.view("draft_column_inputs")).select("product_id", "order_no", "column_name")


@query
def next_order_no(db):
    return changes.next_order_no(db)


@query
def delete_unused_subcategories(db):
    return changes.delete_subcategories(db, db.view("subcategory_requests"))[0]


@query
def delete_drafts(db):
    asked = db.view("publish_requests").filter(F.col("user_role") != "U").select("request_id", "product_id")
    return changes.delete_drafts(db, asked).columns


@query
def delete_draft_products(db):
    asked = db.view("publish_requests").filter(F.col("user_role") != "U").select("request_id", "product_id")
    return changes.delete_drafts(db, asked).products.select("product_id", "name", "draft_yn")


@query
def new_drafts(db):
    inputs = db.view("draft_column_inputs").withColumnRenamed("product_id", "request_id")
    return changes.create_drafts(db, db.view("new_draft_requests"), inputs).products


@query
def new_draft_columns(db):
    inputs = db.view("draft_column_inputs").withColumnRenamed("product_id", "request_id")
    return changes.create_drafts(db, db.view("new_draft_requests"), inputs).columns


@query
def set_availability(db):
    return changes.set_availability(db, db.view("availability_requests")).changed.select(
        "product_id", "available_from", "available_till"
    )


@query
def patch_drafts(db):
    patches = db.view("product_patches").select("request_id", "product_id", "name")
    return changes.patch_drafts(db, patches).changed.select("product_id", "name")


@query
def notification_preferences(db):
    done = changes.set_notification_pref(db, db.view("preference_requests"))
    return done.changed.select("product_uid", "notifications_yn")


@query
def notification_preference_rejects(db):
    return changes.set_notification_pref(db, db.view("preference_requests")).rejects


@query
def patch_products(db):
    return changes.patch_products(db, db.view("product_patches")).changed.select(
        "product_id", "name", "percentage", "term", "available_till"
    )


@query
def patch_products_rejects(db):
    return changes.patch_products(db, db.view("product_patches")).rejects


@query
def patch_accounts(db):
    return changes.patch_accounts(db, db.view("account_patches")).changed.select(
        "account_id", "phone", "email", "country_code", "address", "verification"
    )


@query
def patch_instances(db):
    return changes.patch_instances(db, db.view("instance_patches")).changed.select(
        "product_uid", "amount", "yield", "product_end_date", "special_notes"
    )


@query
def category_codes(db):
    return changes.assign_category_codes(db, db.view("category_requests"))


@query
def create_categories(db):
    return changes.create_categories(db, db.view("category_requests")).categories


@query
def create_subcategories(db):
    new, _ = changes.create_subcategories(db, db.view("new_subcategory_requests"))
    return new.select("request_id", "category_id", "subcategory_name", "catalog_yn", "subcategory_id")


# --- contracts ---------------------------------------------------------------------------------


@query
def contract_facts(db):
    return contracts.contract_facts(db)


@query
def contract_address(db):
    return contracts.contract_facts(db).select("product_uid", "address")


@query
def contract_text(db):
    return contracts.contract_lines(db, AS_OF).lines


@query
def contract_rejects(db):
    return contracts.contract_lines(db, AS_OF).rejects


@query
def contract_json_roundtrip(db):
    """Documents written to JSON and read back, as number of elements and of table rows."""
    rendered = contracts.render_contracts(db, AS_OF)
    # Read back in a column of its own, so that each document is parsed once for all figures.
    back = F.col("back")
    rows = F.aggregate(
        back, F.lit(0), lambda acc, e: acc + F.when(e["kind"] == "table", F.size(e["data"])).otherwise(0)
    )
    return rendered.withColumn("back", contracts.contract_from_json(F.col("unsigned_contract"))).select(
        "product_uid", "part_no", F.size(back).cast("bigint").alias("n_elements"), rows.cast("bigint").alias("n_table_rows"),
        F.element_at(back, -2)["text"].alias("signature_line"),
    )


@query
def sign_contracts(db):
    return contracts.sign_contracts(db, db.view("sign_requests"), AS_OF_TIME).audit.select(
        "product_uid", "was_status", "is_code", "update_user"
    )


@query
def effective_contracts(db):
    """Contracts stored, signed and read back: the text that counts of each, by its length and last lines."""
    none = db.spark.createDataFrame([], schemas.TABLES["contracts"])
    # No contract is stored before, so the instances hold none.
    open_ones = db.product_instances.withColumn("contract_id", F.lit(None).cast("bigint"))
    before = db.replace(contracts=none, product_instances=open_ones)
    new, held = contracts.store_contracts(before, contracts.render_contracts(db, AS_OF))
    stored = db.replace(contracts=new, product_instances=held)
    signed = contracts.sign_contracts(stored, db.view("sign_requests"), AS_OF_TIME).contracts
    text = contracts.effective_contract(signed)
    back = contracts.contract_from_json(F.col("contract"))
    return held.select("product_uid", "contract_id").join(text, "contract_id").select(
        "product_uid", F.size(back).cast("bigint").alias("n_elements"),
        F.element_at(back, -2)["text"].alias("signature_line"), F.element_at(back, -1)["text"].alias("date_line"),
    )


@query
def sign_rejects(db):
    return contracts.sign_contracts(db, db.view("sign_requests"), AS_OF_TIME).rejects


# --- requests that name who asks ---------------------------------------------------------------


def _asked(db, requests, requesters):
    return db.view(requests).join(db.view(requesters), "request_id")


@query
def sales_checked(db):
    sales = changes.create_sales(db, _asked(db, "sale_requests", "sale_requesters"), AS_OF_TIME)
    return sales.applications.select("request_id", "application_id", "account_id", "product_id")


@query
def sale_checked_rejects(db):
    return changes.create_sales(db, _asked(db, "sale_requests", "sale_requesters"), AS_OF_TIME).rejects


@query
def clone_products_checked(db):
    return changes.clone_products(db, _asked(db, "clone_requests", "part_requesters")).products.select(
        "request_id", "product_id", "draft_owner")


@query
def clone_checked_rejects(db):
    return changes.clone_products(db, _asked(db, "clone_requests", "part_requesters")).rejects


@query
def set_availability_checked(db):
    done = changes.set_availability(db, _asked(db, "availability_requests", "part_requesters"))
    return done.changed.select("product_id", "available_from", "available_till")


@query
def availability_checked_rejects(db):
    return changes.set_availability(db, _asked(db, "availability_requests", "part_requesters")).rejects


@query
def delete_drafts_checked_rejects(db):
    return changes.delete_drafts(db, db.view("publish_requests")).rejects


@query
def patch_products_checked_rejects(db):
    return changes.patch_products(db, _asked(db, "product_patches", "part_requesters")).rejects


@query
def patch_drafts_checked_rejects(db):
    patches = _asked(db, "product_patches", "part_requesters").select("request_id", "product_id", "name", "user_id", "user_role")
    return changes.patch_drafts(db, patches).rejects


def _patched_with_values(db):
    return changes.patch_instances_with_attributes(
        db, _asked(db, "instance_patches", "order_requesters"), db.view("patch_values"))


@query
def patch_instance_rejects(db):
    return _patched_with_values(db).instances.rejects


@query
def patch_instance_values(db):
    return _patched_with_values(db).attributes.changed


@query
def patch_categories(db):
    return changes.patch_categories(db, db.view("category_patches")).changed


@query
def patch_category_rejects(db):
    return changes.patch_categories(db, _asked(db, "category_patches", "part_requesters")).rejects


@query
def patch_subcategories(db):
    return changes.patch_subcategories(db, db.view("subcategory_patches")).changed.select(
        "subcategory_id", "category_id", "subcategory_name", "catalog_yn")


@query
def patch_subcategory_rejects(db):
    return changes.patch_subcategories(db, _asked(db, "subcategory_patches", "part_requesters")).rejects


@query
def categories_reversed(db):
    return catalog.categories_reversed(db)


@query
def audit_log_appended(db):
    """The stored log after the rows of a comparison of two snapshots were appended to it."""
    log = db.product_status_updates.select("prime_uid", "product_uid", "was_status", "is_code", "update_dt", "update_user")
    new = lifecycle.audit_rows(db.product_instances, db.view("instances_after"), AS_OF_TIME)
    new = append_with_ids(log, new, "prime_uid", ["product_uid"]).select(log.columns)
    path = scratch_dir(db.spark, "log")
    append_rows(log, path)
    append_rows(new, path)
    return db.spark.read.parquet(path)


# --- streams, run until the input is used up ---------------------------------------------------


def _streamed(db, view):
    """A view over the event files read as a stream, and a new output folder, which goes with the driver."""
    # A pattern, because a stream reads folders or patterns and the table may be one file.
    events = feeds.read_events(db.spark, f"{db.directory}/event[s].parquet")
    return db.over(events=events).view(view), scratch_dir(db.spark, "streams")


def _decided(db):
    """Output folder of the status requests, decided as a stream."""
    requests, out = _streamed(db, "status_requests")
    feeds.start_status_stream(db, requests, out, buckets=8).awaitTermination()
    return out


@query
def stream_status(db):
    return feeds.status_stream_audit(db.spark, _decided(db))


@query
def stream_rejects(db):
    return feeds.status_stream_rejects(db.spark, _decided(db))


@query
def stream_approvals(db):
    return feeds.status_stream_approvals(db, _decided(db))


@query
def stream_to_contract(db):
    return feeds.status_stream_to_contract(db.spark, _decided(db))


@query
def stream_messages(db):
    return feeds.status_stream_messages(db.spark, _decided(db))


@query
def stream_instances(db):
    after = feeds.status_stream_instances(db, _decided(db))
    return after.select("product_uid", "status_code", "latest_update_user_id", "latest_note", "latest_note_public_yn")


@query
def stream_status_state(db):
    requests, out = _streamed(db, "status_requests")
    stateful.start_status_state(db, requests, out).awaitTermination()
    return stateful.state_audit(db.spark, out)


@query
def stream_assigned(db):
    updates, out = _streamed(db, "product_status_updates")
    feeds.start_owner_stream(updates, out).awaitTermination()
    owners = feeds.owners_from_stream(db, out)
    return instances.cards_of_owners(db, owners)


@query
def stream_current_status(db):
    updates, out = _streamed(db, "product_status_updates")
    feeds.start_current_status(updates, out).awaitTermination()
    return feeds.current_status(db.spark, out)


@query
def stream_log(db):
    updates, out = _streamed(db, "product_status_updates")
    feeds.start_update_log(updates, out).awaitTermination()
    return feeds.update_log(db.spark, out)


@query
def stream_notices(db):
    updates, out = _streamed(db, "product_status_updates")
    feeds.start_notice_stream(db, updates.withColumnRenamed("prime_uid", "change_id"), out).awaitTermination()
    return feeds.notice_stream_messages(db.spark, out)
