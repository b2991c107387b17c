import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bankspark.operators import lifecycle
from bankspark.sources import dims
from bankspark.sources.tables import Tables
from tests.conftest import table

REQUEST = (
    "request_id BIGINT, product_uid BIGINT, new_status STRING, update_user BIGINT, note STRING, public_yn STRING, "
    "request_dt TIMESTAMP_NTZ"
)
START = dt.datetime(2024, 1, 1)


def bank(spark, frame, instances, **more):
    applications = [{"application_id": i["product_uid"], "account_id": 5} for i in instances]
    rows = [{"application_id": i["product_uid"], **i} for i in instances]
    return Tables(
        spark, product_instances=table(frame, "product_instances", rows),
        applications=table(frame, "applications", applications), **more,
    )


def by_hand(instances, requests, accepted=None):
    """One request after another."""
    state = {i["product_uid"]: [i["status_code"], i.get("latest_note")] for i in instances}
    out = {}
    for r in sorted(requests, key=lambda r: (r[6], r[0])):
        rid, uid, new, user, note, public, _ = r
        if uid not in state:
            out[rid] = (None, False, "unknown_instance", None)
            continue
        was, old_note = state[uid]
        if new not in dims.NEXT_STATUS.get(was, []):
            out[rid] = (was, False, "transition_not_allowed", None)
        elif accepted and new not in accepted:
            out[rid] = (was, False, "not_a_client_action", None)
        else:
            copied = note if old_note is not None and note is not None and old_note != note else None
            out[rid] = (was, True, None, copied)
            state[uid] = [new, note if note is not None else old_note]
    return out, state


def random_requests(n, hot_share=3, uids=20, seed=1):
    random.seed(seed)
    rows = []
    for i in range(n):
        uid = 1 if i % hot_share == 0 else random.randrange(1, uids + 1)
        rows.append((
            i, uid, random.choice(dims.STATUS_CODES), random.randrange(50), random.choice([None, "a", "b", ""]),
            random.choice(["Y", "N", None]), START + dt.timedelta(minutes=random.randrange(n)),
        ))
    return rows


@pytest.mark.parametrize("limit", [1000, 50, 5])
def test_fold_matches_one_by_one_also_in_pieces(spark, frame, limit):
    """A hot instance holds a third of all requests; small limits fold it over several levels."""
    instances = [
        {"product_uid": u, "status_code": random.choice(["APL", "NOR", "EXC", "AMD"]), "latest_note": random.choice([None, "a", ""])}
        for u in range(1, 16)
    ]
    requests = random_requests(600)
    want, state = by_hand(instances, requests)
    db = bank(spark, frame, instances)
    changes = lifecycle.apply_status_changes(db, frame(REQUEST, requests), limit=limit, materialize=True)
    got = {r.request_id: (r.was, r.ok, r.reason, r.audit_note) for r in changes.decisions.collect()}
    assert got == want
    after = {r.product_uid: [r.status_code, r.latest_note] for r in changes.instances.collect()}
    assert after == state
    assert changes.audit.count() == sum(ok for _, ok, _, _ in want.values())
    assert changes.rejects.count() == sum(not ok for _, ok, _, _ in want.values())


def test_client_changes(spark, frame):
    instances = [{"product_uid": u, "status_code": s} for u, s in enumerate(["AMD", "APL", "REV", "DIS"], start=1)]
    requests = random_requests(200, uids=5, seed=3)
    want, _ = by_hand(instances, requests, dims.CLIENT_ACCEPTED)
    db = bank(spark, frame, instances)
    for limit in (1000, 20):
        changes = lifecycle.apply_client_changes(db, frame(REQUEST, requests), limit=limit)
        got = {r.request_id: (r.was, r.ok, r.reason, r.audit_note) for r in changes.decisions.collect()}
        assert got == want
        assert changes.applications.filter("approved_yn IS NOT NULL").isEmpty()


def test_approval_stamp(spark, frame):
    db = bank(spark, frame, [{"product_uid": 1, "status_code": "REV"}, {"product_uid": 2, "status_code": "APL"}])
    requests = frame(REQUEST, [
        (1, 1, "APR", 7, None, None, START), (2, 2, "DEN", 8, "no", "Y", START + dt.timedelta(days=1)),
    ])
    changes = lifecycle.apply_status_changes(db, requests)
    got = {r.application_id: (r.approved_yn, r.approved_by, r.approval_dt) for r in changes.applications.collect()}
    assert got == {1: ("Y", 7, START), 2: ("N", 8, START + dt.timedelta(days=1))}
    assert [r.product_uid for r in changes.to_contract.collect()] == [1]


def test_graph_is_complete(spark):
    assert len(dims.STATUS_CODES) == 17
    ends = set(dims.STATUS_CODES) - set(dims.NEXT_STATUS)
    assert ends == {"CNL", "CMP", "WOF", "DEN"}
    for graph in (dims.NEXT_STATUS, dims.PROGRESSION):
        assert all(t in dims.STATUS_CODES for targets in graph.values() for t in targets)
    assert all(path[-1] == "CMP" for path in dims.PROGRESSION.values())


def night_bank(spark, frame, rows):
    """Instances (uid, status, end date, exercise dates)."""
    defs = table(frame, "product_custom_column_def", [{"pcc_id": 1, "exercise_date_yn": "Y"}, {"pcc_id": 2}])
    values = [
        {"pcc_uid": 10 * r[0] + i, "pcc_id": 1, "product_uid": r[0], "date_value": d}
        for r in rows for i, d in enumerate(r[3])
    ] + [{"pcc_uid": 0, "pcc_id": 2, "product_uid": rows[0][0], "date_value": dt.date(2024, 1, 15)}]
    return bank(
        spark, frame,
        [{"product_uid": r[0], "status_code": r[1], "product_end_date": r[2], "latest_note": "old"} for r in rows],
        product_custom_column_def=defs, product_custom_column_values=table(frame, "product_custom_column_values", values),
    )


def test_night(spark, frame):
    today, yesterday, week = dt.date(2024, 1, 15), dt.date(2024, 1, 14), dt.date(2024, 1, 8)
    far = dt.date(2025, 1, 1)
    db = night_bank(spark, frame, [
        (1, "NOR", today, []),  # falls due
        (2, "DUE", week, []),  # overdue
        (3, "NOR", far, [today]),  # exercise day
        (4, "EXC", far, [yesterday]),  # runs on
        (5, "EXC", far, [yesterday, today]),  # runs on as well: the exercise step comes first
        (6, "NOR", far, [yesterday, today]),  # moves twice and ends where it was
        (7, "NOR", today, [today]),  # due wins
        (8, "NOR", yesterday, []),  # missed night
        (9, "CMP", today, [today]),
    ])
    night = lifecycle.nightly(db, today)
    after = {r.product_uid: r.status_code for r in night.instances.collect()}
    assert after == {1: "DUE", 2: "ORD", 3: "EXC", 4: "NOR", 5: "NOR", 6: "NOR", 7: "DUE", 8: "NOR", 9: "CMP"}
    steps = sorted((r.product_uid, r.step) for r in night.audit.collect())
    assert steps == [
        (1, "due"), (2, "overdue"), (3, "exercise"), (4, "back_to_normal"), (5, "back_to_normal"),
        (6, "back_to_normal"), (6, "exercise"), (7, "due"),
    ]
    summary = {r.step: r.n_rows for r in lifecycle.sweep_summary(night).collect()}
    assert summary == {"due": 2, "overdue": 1, "exercise": 2, "back_to_normal": 3}
    quiet = lifecycle.sweep_summary(lifecycle.nightly(db, dt.date(2030, 1, 1)))
    assert {r.step: r.n_rows for r in quiet.collect()} == dict.fromkeys(lifecycle.STEPS, 0)
    notes = {r.product_uid: (r.latest_note, r.latest_update_user_id) for r in night.instances.collect()}
    assert notes[1] == (None, 1) and notes[6] == (None, 1) and notes[8] == ("old", None)
    assert {r.product_uid for r in lifecycle.sweep_due(db, today, catch_up=True).collect()} == {1, 7, 8}
    again = lifecycle.nightly(db.replace(product_instances=night.instances), today)
    assert {r.product_uid for r in again.audit.filter("step IN ('due', 'overdue')").collect()} == set()


def test_first_note_after_a_sweep_is_lost(spark, frame):
    old = table(frame, "product_instances", [{"product_uid": 1, "status_code": "DUE"}, {"product_uid": 2, "status_code": "DUE", "latest_note": "x"}])
    new = table(frame, "product_instances", [
        {"product_uid": 1, "status_code": "CMP", "latest_note": "paid", "latest_note_public_yn": "Y"},
        {"product_uid": 2, "status_code": "CMP", "latest_note": "paid", "latest_note_public_yn": "Y"},
    ])
    notes = {r.product_uid: r.update_note for r in lifecycle.audit_rows(old, new, START).collect()}
    assert notes == {1: None, 2: "paid"}
    notes = {r.product_uid: r.update_note for r in lifecycle.audit_rows(old, new, START, null_safe_notes=True).collect()}
    assert notes == {1: "paid", 2: "paid"}


def test_audit_chains(spark, mapped):
    """Each accepted change starts from the status the one before it left."""
    changes = lifecycle.apply_status_changes(mapped, mapped.view("status_requests"), materialize=True)
    from pyspark.sql import Window

    w = Window.partitionBy("product_uid").orderBy("update_dt", "request_id")
    broken = changes.audit.withColumn("before", F.lag("is_code").over(w)).filter("before <> was_status")
    assert broken.isEmpty()
