"""One instance, account and updater hold a third of all rows; results against plain Python."""

import datetime as dt
import random

import pytest

from bankspark.operators import changes, instances
from bankspark.sources.tables import Tables
from tests.conftest import table

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed_log():
    random.seed(11)
    rows = []
    for i in range(1, 1501):
        hot = i % 3 == 0
        rows.append({
            "prime_uid": i, "product_uid": 1 if hot else random.randrange(1, 80), "is_code": random.choice(["REV", "APR", "CNL"]),
            "update_dt": START + dt.timedelta(minutes=random.randrange(300)), "update_user": 2 if i % 3 == 1 else random.randrange(1, 40),
            "update_note": random.choice([None, "", "n"]), "update_note_public_yn": random.choice(["Y", "N", None]),
        })
    return rows


@pytest.fixture
def db(spark, frame, skewed_log):
    people = [{"account_id": i, "first_name": f"f{i}", "last_name": "l", "user_role": "ACEU"[i % 4]} for i in range(1, 30)]
    return Tables(
        spark, product_status_updates=table(frame, "product_status_updates", skewed_log).repartition(5),
        accounts=table(frame, "accounts", people),
        product_instances=table(frame, "product_instances", [{"product_uid": u, "application_id": u, "account_id": 5} for u in range(1, 80)]),
        applications=table(frame, "applications", [{"application_id": u, "account_id": 5, "application_dt": START} for u in range(1, 80)]),
    )


def test_owners(db, skewed_log):
    want = set()
    for uid in {r["product_uid"] for r in skewed_log}:
        mine = [r for r in skewed_log if r["product_uid"] == uid and 1 < r["update_user"] < 30 and "ACEU"[r["update_user"] % 4] != "U"]
        if mine:
            last = max(r["update_dt"] for r in mine)
            want |= {(uid, r["update_user"]) for r in mine if r["update_dt"] == last}
    assert sorted(map(tuple, instances.assignments(db).collect())) == sorted(want)


def test_timeline_and_pages(db, skewed_log):
    rows = instances.status_timeline(db, "U").collect()
    assert len(rows) == len(skewed_log) + 79
    current = {r.product_uid: r.prime_uid for r in rows if r.is_current == "Y"}
    want = {u: 0 for u in range(1, 80)}
    for r in sorted(skewed_log, key=lambda r: (r["update_dt"], r["prime_uid"])):
        want[r["product_uid"]] = r["prime_uid"]
    assert current == want
    notes = {r.prime_uid: r.note for r in rows}
    for r in skewed_log:
        assert notes[r["prime_uid"]] == (r["update_note"] if r["update_note"] and r["update_note_public_yn"] == "Y" else None)
    nested = instances.instance_nested(db, "E", page_size=50).collect()
    assert max(len(r.statuses) for r in nested) == 50
    hot = [s.prime_uid for r in sorted((r for r in nested if r.product_uid == 1), key=lambda r: r.page_no) for s in r.statuses]
    mine = [r for r in skewed_log if r["product_uid"] == 1]
    assert hot == [0] + [r["prime_uid"] for r in sorted(mine, key=lambda r: (r["update_dt"], r["prime_uid"]))]


def test_patches_of_a_hot_row(db, frame):
    random.seed(5)
    rows = [(i, 1 if i % 3 == 0 else random.randrange(1, 90), random.choice([None, float(i)]), random.choice([None, f"s{i}"])) for i in range(900)]
    done = changes.patch_instances(db, frame("request_id BIGINT, product_uid BIGINT, amount DOUBLE, special_notes STRING", rows))
    want = {}
    for _, uid, amount, note in rows:
        if uid < 80 and (amount is not None or note is not None):
            old = want.get(uid, (None, None))
            want[uid] = (amount if amount is not None else old[0], note if note is not None else old[1])
    assert {r.product_uid: (r.amount, r.special_notes) for r in done.changed.collect()} == want
    assert done.rejects.count() == sum(uid >= 80 or (a is None and n is None) for _, uid, a, n in rows)


def test_timeline_join_spreads_a_hot_instance(db):
    plan = instances.status_timeline(db)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert any("product_uid" in j and "update_dt" in j and "prime_uid" in j for j in joins)
