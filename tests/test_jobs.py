import datetime as dt

from bankspark.operators import lifecycle
from bankspark.plans import jobs
from tests.conftest import table

DAY = dt.date(2024, 1, 15)


def test_night_and_morning(spark, mapped, tmp_path):
    for _ in range(2):  # a rerun replaces the version
        paths = jobs.run_night(mapped, DAY, str(tmp_path), 1)
    night = lifecycle.nightly(mapped, DAY)
    assert spark.read.parquet(paths["product_status_updates"]).count() == night.audit.count()
    after = spark.read.parquet(paths["product_instances"])
    assert after.count() == mapped.product_instances.count()
    assert sum(r.n_rows for r in spark.read.parquet(paths["sweep_summary"]).collect()) == night.audit.count()
    db = mapped.replace(product_instances=after)
    paths = jobs.run_morning(db, DAY, str(tmp_path), 1)
    due = spark.read.parquet(paths["due_notices"])
    moved = night.audit.filter("is_code = 'DUE'").select("product_uid")
    assert moved.join(due, "product_uid", "left_anti").isEmpty() and not moved.isEmpty()


def test_requests_are_written_from_one_decision(spark, frame, mapped, tmp_path):
    from bankspark.sources.tables import Tables

    names = ("accounts", "products", "applications", "product_instances", "product_custom_column_def", "product_custom_column_values")
    db = Tables(spark, contracts=table(frame, "contracts", [{"contract_id": 900000}]), **{n: mapped.view(n) for n in names})
    requests = mapped.view("status_requests")
    paths = jobs.run_requests(db, requests, DAY, str(tmp_path), 3)
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    assert read["product_status_updates"].count() + read["rejects"].count() == requests.count()
    approved = read["product_status_updates"].filter("is_code = 'APR'").select("product_uid").distinct()
    new = read["product_instances"].filter("contract_id > 900000").select("product_uid")
    assert not new.isEmpty() and new.join(approved, "product_uid", "left_anti").isEmpty()
    assert read["contracts"].count() == new.count()
    assert read["applications"].filter("approval_dt >= TIMESTAMP_NTZ '2024-01-01'").count() >= approved.count()
