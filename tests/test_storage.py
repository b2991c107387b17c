"""Snapshots compared by digests, keys reserved by several writers, the dated layout, counts taken while writing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bankspark.operators import capture, lifecycle
from bankspark.operators.key_blocks import KeyBlocks, append_with_reserved_ids
from bankspark.sources import dated

NIGHT = dt.date(2024, 1, 15)


def rows(df):
    return sorted(map(str, df.collect()))


def spoil(folder, keep):
    """Make the files unreadable whose folder ``keep`` does not name."""
    n = 0
    for path in folder.glob("**/*.parquet"):
        if not keep(path.parent.name):
            path.write_bytes(b"broken")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
            n += 1
    return n


# --- digests -----------------------------------------------------------------------------------


def snapshot(frame, changes=()):
    new = dict(changes)
    schema = "product_uid BIGINT, status_code STRING, latest_update_user_id BIGINT, latest_note STRING, latest_note_public_yn STRING"
    return frame(schema, [(k, *new.get(k, ("APL", 1, "n" if k % 2 else None, "N"))) for k in range(3000)])


def test_only_differing_buckets_are_read(spark, frame, tmp_path):
    # Two of 200 buckets at most.
    changes = {7: ("APR", 2, "x", "Y"), 8: ("APL", 2, "x", "Y")}
    old, new = snapshot(frame), snapshot(frame, changes.items())
    path = f"{tmp_path}/s"
    capture.write_hashed(old, path, 0, buckets=200)
    capture.write_hashed(new.orderBy(F.desc("product_uid")), path, 1, buckets=200)
    found = capture.differing_buckets(spark, path, 0, 1)
    assert 1 <= len(found) <= 2 and capture.differing_buckets(spark, path, 1, 1) == []
    names = {f"bucket={b}" for b in found}
    assert spoil(tmp_path / "s" / "rows", lambda name: name in names) > 300
    moment = dt.datetime(2024, 1, 15, 1)
    assert rows(capture.audit_rows_between(spark, path, 0, 1, moment)) == rows(lifecycle.audit_rows(old, new, moment))


def test_digests_see_nulls_new_rows_and_repeats(spark, frame, tmp_path):
    schema = "product_uid BIGINT, status_code STRING, latest_note STRING"
    versions = [
        [(1, "a", None), (2, "x", "y")], [(1, None, "a"), (2, "x", "y")], [(1, None, "a")], [(1, None, "a"), (1, None, "a")], [],
    ]
    for k, v in enumerate(versions):
        capture.write_hashed(frame(schema, v), f"{tmp_path}/s", k, buckets=8)
    for k in range(len(versions) - 1):
        assert len(capture.differing_buckets(spark, f"{tmp_path}/s", k, k + 1)) == 1
    capture.write_hashed(frame(schema, versions[0]), f"{tmp_path}/s", 9, buckets=4)
    with pytest.raises(ValueError):
        capture.differing_buckets(spark, f"{tmp_path}/s", 0, 9)


# --- keys --------------------------------------------------------------------------------------


def test_two_writers_never_share_keys(spark, tmp_path):
    one, other = (KeyBlocks(spark, f"{tmp_path}/k", base=100) for _ in range(2))
    starts = [one.reserve("a", 10), other.reserve("b", 5), one.reserve("c", 1), other.reserve("d", 0), other.reserve("e", 3)]
    assert starts == [100, 110, 115, 116, 116]
    # Again under its name, whoever reserved meanwhile; more than before is refused.
    assert one.reserve("a", 10) == 100 and other.reserve("b", 4) == 110
    with pytest.raises(ValueError):
        one.reserve("a", 11)


def test_a_lost_race_takes_the_next_keys(spark, tmp_path):
    one, other = (KeyBlocks(spark, f"{tmp_path}/k") for _ in range(2))
    looked = one._read

    def late(name):
        found = looked(name)
        if name == "reservation-0" and found is None and not other._read("reservation-0"):
            assert other.reserve("theirs", 7) == 1  # between looking and creating
        return found

    one._read = late
    assert one.reserve("mine", 2) == 8
    # Only the reservation was written before a writer failed: its keys are a gap.
    assert one._create("reservation-2", 10, 4) and not other._create("reservation-2", 10, 1)
    assert other.reserve("next", 1) == 14


def test_appends_with_reserved_keys(spark, frame, tmp_path):
    blocks = KeyBlocks(spark, f"{tmp_path}/k", base=50)
    frame_of = lambda names: frame("name STRING", [(n,) for n in names])
    get = lambda write, names: {r["name"]: r["id"] for r in append_with_reserved_ids(blocks, write, frame_of(names), "id", ["name"]).collect()}
    assert get("a", "xyz") == {"x": 50, "y": 51, "z": 52}
    assert get("b", "pq") == {"p": 53, "q": 54}
    assert get("a", "xyz") == {"x": 50, "y": 51, "z": 52}
    assert get("c", "") == {}


# --- nights ------------------------------------------------------------------------------------


@pytest.mark.parametrize("catch_up", [False, True])
def test_dated_layout_gives_the_same_night(spark, mapped, tmp_path, catch_up):
    path = f"{tmp_path}/d"
    dated.store_dated(mapped, path)
    want = lifecycle.nightly(mapped, NIGHT, catch_up)
    got = dated.nightly_dated(mapped, path, NIGHT, catch_up)
    assert rows(got.audit) == rows(want.audit) and got.audit.count() > 0
    moved = want.instances.join(want.audit.select("product_uid").distinct(), "product_uid", "left_semi")
    assert rows(got.instances.select(moved.columns)) == rows(moved)


def test_a_night_reads_only_its_days(spark, mapped, tmp_path):
    path = tmp_path / "d"
    dated.store_dated(mapped, str(path))
    want = rows(lifecycle.nightly(mapped, NIGHT).audit)
    days = {f"day={NIGHT}", f"day={NIGHT - dt.timedelta(days=1)}"}
    assert spoil(path / "exercise", lambda name: name in days) > 0
    plan = dated.nightly_dated(mapped, str(path), NIGHT).audit._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruning" in plan
    exercised = spark.read.parquet(*[str(path / "exercise" / d) for d in days])
    ends = {f"end_day={r[0]}" for r in exercised.select("end_day").distinct().collect()}
    ends |= {f"end_day={NIGHT}", f"end_day={NIGHT - dt.timedelta(days=7)}"}
    spoil(path / "instances", lambda name: name in ends)
    assert rows(dated.nightly_dated(mapped, str(path), NIGHT).audit) == want


def test_counts_come_with_the_write(spark, mapped, tmp_path):
    from pyspark.sql import Observation

    counts = Observation()
    night = lifecycle.nightly(mapped, NIGHT, counts=counts)
    night.instances.write.parquet(f"{tmp_path}/n")
    assert rows(lifecycle.observed_summary(spark, counts)) == rows(lifecycle.sweep_summary(lifecycle.nightly(mapped, NIGHT)))
