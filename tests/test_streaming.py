"""Streams against their batch twins, in several micro-batches, with repeated and late rows."""

import datetime as dt
import functools

import pytest

from bankspark.operators import instances, lifecycle
from bankspark.sources.tables import MappedTables
from bankspark.streaming import feeds
from bankspark.streaming.keyed import KeyedStore, completed, segments
from tests.conftest import DATA


def write_files(spark, frames, folder):
    """One file per frame, in this order of modification."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    return f"{folder}/part=*"


def in_time_order(mapped, pieces):
    events = mapped.raw("events")
    bounds = events.approxQuantile("event_id", [i / pieces for i in range(1, pieces)], 0.0)
    edges = [-1] + [int(b) for b in bounds] + [10**12]
    return [events.filter(f"event_id > {lo} AND event_id <= {hi}") for lo, hi in zip(edges, edges[1:])]


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("fan", [2, 10])
def test_status_stream_equals_batch(spark, mapped, tmp_path, monkeypatch, fan):
    """Batches with requests of earlier ones again; those change nothing."""
    monkeypatch.setattr(feeds, "KeyedStore", functools.partial(KeyedStore, fan=fan))
    pieces = in_time_order(mapped, 4)
    again = pieces[0].limit(50)
    frames = [pieces[0], pieces[1].unionByName(again), pieces[2].unionByName(pieces[2].limit(9)), pieces[3], pieces[1].limit(20)]
    path = write_files(spark, frames, f"{tmp_path}/in")
    db = MappedTables(spark, DATA)
    requests = db.over(events=feeds.read_events(spark, path, files_per_batch=1)).view("status_requests")
    out = f"{tmp_path}/out"
    feeds.start_status_stream(db, requests, out, buckets=4).awaitTermination()
    batch = lifecycle.apply_status_changes(db, db.view("status_requests"))
    columns = ["product_uid", "request_id", "was_status", "is_code", "update_note"]
    assert rows(feeds.status_stream_audit(spark, out), *columns) == rows(batch.audit, *columns)
    assert rows(feeds.status_stream_rejects(spark, out), "request_id", "reason") == rows(batch.rejects, "request_id", "reason")
    state = ["product_uid", "status_code", "latest_note", "latest_update_user_id"]
    assert rows(feeds.status_stream_instances(db, out), *state) == rows(batch.instances, *state)


def test_keyed_state_equals_batch_and_goes_on_after_a_restart(spark, mapped, tmp_path):
    from bankspark.streaming import stateful

    pieces = in_time_order(mapped, 3)
    path = write_files(spark, [pieces[0], pieces[1].unionByName(pieces[0].limit(50))], f"{tmp_path}/in")
    db, out = MappedTables(spark, DATA), f"{tmp_path}/out"
    for last in (None, pieces[2].unionByName(pieces[1].limit(30))):
        if last is not None:
            last.coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
        requests = db.over(events=feeds.read_events(spark, path, 1)).view("status_requests")
        stateful.start_status_state(db, requests, out).awaitTermination()
    batch = lifecycle.apply_status_changes(db, db.view("status_requests"))
    columns = ["product_uid", "request_id", "was_status", "is_code", "update_note", "update_note_public_yn"]
    assert rows(stateful.state_audit(spark, out), *columns) == rows(batch.audit, *columns)
    assert rows(stateful.state_rejects(spark, out), "request_id", "reason") == rows(batch.rejects, "request_id", "reason")


def test_keyed_state_holds_named_instances_only(spark, mapped, tmp_path, monkeypatch):
    """Instances without requests stay out of the state; repeats are known from beside the status and from the map."""
    from bankspark.streaming import stateful

    monkeypatch.setattr(stateful, "IDS_BESIDE", 3)
    pieces = in_time_order(mapped, 3)
    path = write_files(spark, [pieces[0], pieces[1].unionByName(pieces[0]), pieces[2].unionByName(pieces[1])], f"{tmp_path}/in")
    db, out = MappedTables(spark, DATA), f"{tmp_path}/out"
    stateful.start_status_state(db, db.over(events=feeds.read_events(spark, path, 1)).view("status_requests"), out).awaitTermination()
    asked = db.view("status_requests")
    batch = lifecycle.apply_status_changes(db, asked)
    columns = ["product_uid", "request_id", "was_status", "is_code", "update_note", "update_note_public_yn"]
    assert rows(stateful.state_audit(spark, out), *columns) == rows(batch.audit, *columns)
    assert rows(stateful.state_rejects(spark, out), "request_id", "reason") == rows(batch.rejects, "request_id", "reason")
    state = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "instance").load()
    named = asked.select("product_uid").distinct().count()
    assert state.count() == named < db.product_instances.count()



def test_owner_stream_in_any_order(spark, mapped, tmp_path):
    pieces = in_time_order(mapped, 3)
    path = write_files(spark, [pieces[2], pieces[0], pieces[1].unionByName(pieces[2])], f"{tmp_path}/in")
    updates = MappedTables(spark, DATA).over(events=feeds.read_events(spark, path, 1)).view("product_status_updates")
    feeds.start_owner_stream(updates, f"{tmp_path}/out").awaitTermination()
    got = feeds.owners_from_stream(mapped, f"{tmp_path}/out")
    assert rows(got, "product_uid", "updater_id") == rows(instances.assignments(mapped), "product_uid", "updater_id")


def test_late_update_is_logged_but_not_current(spark, mapped, frame, tmp_path):
    schema = "prime_uid BIGINT, product_uid BIGINT, is_code STRING, update_dt TIMESTAMP_NTZ, update_user BIGINT"
    day = lambda n: dt.datetime(2024, 1, n)
    frames = [
        frame(schema, [(1, 7, "REV", day(2), 3), (2, 7, "APR", day(10), 3)]),
        frame(schema, [(3, 7, "AMD", day(3), 3), (2, 7, "APR", day(10), 3)]),
        frame(schema, [(4, 7, "REV", day(9), 3), (5, 8, "REV", day(20), 3)]),
        frame(schema, [(6, 7, "DEN", day(1), 3), (3, 7, "AMD", day(3), 3), (7, 8, "AMD", day(4), 3)]),
    ]
    path = write_files(spark, frames, f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    feeds.start_current_status(stream(), f"{tmp_path}/now").awaitTermination()
    assert rows(feeds.current_status(spark, f"{tmp_path}/now"), "product_uid", "status_code") == [
        ("7", "APR"), ("8", "REV")
    ]
    feeds.start_update_log(stream(), f"{tmp_path}/log").awaitTermination()
    assert rows(feeds.update_log(spark, f"{tmp_path}/log"), "prime_uid") == [(str(i),) for i in range(1, 8)]
    # Another run later, from the same checkpoint: keys of the first run are still known.
    late = frame(schema, [(1, 7, "REV", day(2), 3), (7, 8, "AMD", day(4), 3), (8, 8, "APR", day(21), 3), (8, 8, "DEN", day(22), 3)])
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part=9")
    feeds.start_update_log(stream(), f"{tmp_path}/log").awaitTermination()
    log = feeds.update_log(spark, f"{tmp_path}/log")
    assert rows(log, "prime_uid") == [(str(i),) for i in range(1, 9)]
    assert log.filter("prime_uid = 8").select("is_code").collect() == [("APR",)]


def test_notice_stream_equals_batch(spark, mapped, tmp_path):
    from bankspark.operators import notices

    path = write_files(spark, in_time_order(mapped, 2), f"{tmp_path}/in")
    updates = MappedTables(spark, DATA).over(events=feeds.read_events(spark, path, 1)).view("product_status_updates")
    feeds.start_notice_stream(mapped, updates.withColumnRenamed("prime_uid", "change_id"), f"{tmp_path}/out").awaitTermination()
    log = mapped.product_status_updates.withColumnRenamed("prime_uid", "change_id")
    want = notices.status_notifications(mapped, log)
    assert rows(spark.read.parquet(f"{tmp_path}/out/messages"), "change_id", "template") == rows(want, "change_id", "template")


# --- keyed stores ------------------------------------------------------------------------------


def test_segments_are_the_digits_of_the_number_of_batches():
    assert segments(0) == [] and segments(7) == [(k, 1) for k in range(7)]
    assert segments(237) == [(0, 100), (100, 100), *((200 + 10 * k, 10) for k in range(3)), *((230 + k, 1) for k in range(7))]
    for n in range(1, 1200):
        assert len(segments(n, 3)) <= 2 * 7
        # What a reader of n batches reads, a batch before has written.
        assert all(size == 1 or (first, size) in completed(first + size, 3) for first, size in segments(n, 3))
    assert completed(100) == [(90, 10), (0, 100)] and completed(7) == []


def folders(path):
    return {str(p.parent.relative_to(path)) for p in path.glob("first=*/size=*/_SUCCESS")}


def test_store_keeps_the_newest_row_and_few_segments(spark, tmp_path):
    from pyspark.sql import types as T

    store = KeyedStore(spark, f"{tmp_path}/s", T.StructType.fromDDL("k BIGINT, v STRING"), ["k"], buckets=3, fan=2)
    frame = lambda rows: spark.createDataFrame(rows, "k BIGINT, v STRING").coalesce(1)
    store.start(frame([(k, "start") for k in range(20)]))
    store.start(frame([(1, "again")]))
    state, most = {k: "start" for k in range(20)}, 0
    for batch in range(13):
        rows = [(k, f"{batch}") for k in (batch % 5, 20 + batch)] if batch != 6 else []
        for _ in range(2):  # a batch that runs again changes nothing
            assert dict(map(tuple, store.before(batch).collect())) == state
            store.put(batch, frame(rows))
        state |= dict(rows)
        most = max(most, len(folders(tmp_path / "s")))
    assert dict(map(tuple, store.latest().collect())) == state
    # The start, the digits of the number of batches, and at most what one batch has merged and the next will drop.
    assert most <= 1 + 4 + 2 * 4
    assert {f"first={a}/size={b}" for a, b in [(-1, 1), *segments(13, 2)]} <= folders(tmp_path / "s")


def test_store_reads_only_the_buckets_of_the_keys(spark, tmp_path):
    from pyspark.sql import types as T

    store = KeyedStore(spark, f"{tmp_path}/s", T.StructType.fromDDL("k BIGINT, v STRING"), ["k"], buckets=16)
    rows = spark.createDataFrame([(k, "x") for k in range(400)], "k BIGINT, v STRING")
    store.start(rows)
    store.put(0, rows.filter("k < 200"))
    read = store.before(1, rows.filter("k = 3"))
    wanted = rows.filter("k = 3").select(store.bucket()).first()[0]
    assert read.collect() == [(3, "x")]
    # Files of the other buckets may be broken: they are not opened.
    for path in (tmp_path / "s").glob("first=*/size=*/bucket=*/*.parquet"):
        if path.parent.name != f"bucket={wanted}":
            path.write_bytes(b"broken")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert store.before(1, rows.filter("k = 3")).collect() == [(3, "x")]


def test_unseen_takes_one_row_of_each_new_key(spark, tmp_path):
    from pyspark.sql import types as T

    store = KeyedStore(spark, f"{tmp_path}/s", T.StructType.fromDDL("k BIGINT"), ["k"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "v STRING, k BIGINT")
    store.put(0, store.unseen(0, frame([("a", 1), ("b", 2)])))
    assert sorted(store.unseen(1, frame([("z", 1), ("d", 3), ("c", 3), ("e", 4)])).collect()) == [("c", 3), ("e", 4)]
    store.put(1, frame([("d", 3)]))
    assert store.unseen(2, frame([("a", 1), ("d", 3)])).count() == 0
