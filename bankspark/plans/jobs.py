"""Daily runs: operators put together and their results written as one version.

A run reads the tables it is given and writes ``<out>/<table>/version=<n>``; nothing that it reads is
changed, and a rerun of the same version replaces what the first run wrote.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation

from bankspark.operators import contracts, lifecycle, notices
from bankspark.session import checkpointed
from bankspark.sources.tables import Tables, write_snapshot


def run_night(db: Tables, as_of: dt.date, out: str, version: int, catch_up: bool = False) -> dict[str, str]:
    """Status sweeps just after midnight: the instances afterwards, audit rows and row counts."""
    counts = Observation()
    night = lifecycle.nightly(db, as_of, catch_up, counts)
    written = {"product_instances": write_snapshot(night.instances, f"{out}/product_instances", version)}
    summary = lifecycle.observed_summary(db.spark, counts)
    return written | {
        "product_status_updates": write_snapshot(night.audit, f"{out}/product_status_updates", version),
        "sweep_summary": write_snapshot(summary, f"{out}/sweep_summary", version),
    }


def run_morning(db: Tables, as_of: dt.date, out: str, version: int) -> dict[str, str]:
    """Messages about due, exercise-day and overdue products, on the instances the night has left."""
    return {
        "due_notices": write_snapshot(notices.due_notices(db, as_of), f"{out}/due_notices", version),
        "overdue_notices": write_snapshot(notices.overdue_notices(db), f"{out}/overdue_notices", version),
    }


def run_requests(db: Tables, requests: DataFrame, as_of: dt.date, out: str, version: int) -> dict[str, str]:
    """A batch of status requests: changes, audit, rejects, contracts of approved products, messages.

    The requests are decided once and checkpointed; every result is written from the same decisions.
    """
    changes = lifecycle.apply_status_changes(db, requests, materialize=True)
    instances, results = changes.instances, {}
    if getattr(db, "contracts", None) is not None:
        rendered = checkpointed(contracts.render_contracts(db, as_of, changes.to_contract))
        new, instances = contracts.store_contracts(db.replace(product_instances=instances), rendered)
        results["contracts"] = write_snapshot(new, f"{out}/contracts", version)
    accepted = changes.audit.withColumnRenamed("request_id", "change_id")
    results |= {
        "product_instances": write_snapshot(instances, f"{out}/product_instances", version),
        "applications": write_snapshot(changes.applications, f"{out}/applications", version),
        "product_status_updates": write_snapshot(changes.audit, f"{out}/product_status_updates", version),
        "rejects": write_snapshot(changes.rejects, f"{out}/rejects", version),
        "messages": write_snapshot(notices.status_notifications(db, accepted), f"{out}/messages", version),
    }
    return results
