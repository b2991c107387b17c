"""The change feed as Structured Streaming.

Every sink writes one folder per micro-batch, named by the batch id and replaced when a batch is
run again, so a restart after a lost executor or driver leaves each batch in the output once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from bankspark.operators import instances, lifecycle, notices
from bankspark.sources import schemas
from bankspark.sources.tables import Tables, write_snapshot
from bankspark.streaming.keyed import BUCKETS, KeyedStore


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream."""
    reader = spark.readStream.schema(schemas.RAW["events"])
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _read_versions(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(directory).drop("version")


# --- status requests ---------------------------------------------------------------------------


def start_status_stream(
    db: Tables, requests: DataFrame, out: str, available_now: bool = True, buckets: int = BUCKETS
) -> StreamingQuery:
    """Decide a stream of status requests against the current state of the instances.

    Each batch is decided by the batch operator, in time order inside the batch, on the state the
    batches before left. A request that arrives late is decided when it arrives, as a clerk would; one
    that arrives again, however much later, is not decided again. Writes ``requests``, ``audit``, ``rejects``, the
    ``stamps`` of decided applications, the instances ``to_contract`` and the ``messages`` of every batch under
    ``out``. The ``instances`` and the ``seen`` requests are keyed stores, so a batch reads the buckets of its own
    keys and writes no more than it changes. A stream goes on with the number of ``buckets`` it was started with.
    """
    spark = db.spark
    state, seen = _instance_store(db, out, buckets), _seen(spark, out, requests, "request_id", buckets)

    def decide(batch: DataFrame, batch_id: int) -> None:
        state.start(db.product_instances)
        # Staged first: the operator then runs in the main session, with adaptive execution.
        staged = spark.read.parquet(write_snapshot(_unseen(seen, batch, batch_id), f"{out}/requests", batch_id))
        # Only the instances that the batch names go into the decisions.
        named = db.replace(product_instances=state.before(batch_id, staged))
        changes = lifecycle.apply_status_changes(named, staged, materialize=True)
        write_snapshot(changes.audit, f"{out}/audit", batch_id)
        write_snapshot(changes.rejects, f"{out}/rejects", batch_id)
        write_snapshot(changes.stamps, f"{out}/stamps", batch_id)
        write_snapshot(changes.to_contract, f"{out}/to_contract", batch_id)
        accepted = changes.audit.withColumnRenamed("request_id", "change_id")
        write_snapshot(notices.status_notifications(named, accepted), f"{out}/messages", batch_id)
        seen.put(batch_id, staged)
        state.put(batch_id, changes.changed)

    return _start(requests.writeStream.foreachBatch(decide), f"{out}/checkpoint", available_now)


def _instance_store(db: Tables, out: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(db.spark, f"{out}/instances", db.product_instances.schema, ["product_uid"], buckets=buckets)


def _seen(spark: SparkSession, out: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> KeyedStore:
    """The keys that have arrived; none is ever forgotten."""
    return KeyedStore(spark, f"{out}/seen", rows.select(key).schema, [key], buckets=buckets)


def _unseen(seen: KeyedStore, batch: DataFrame, batch_id: int) -> DataFrame:
    spark = seen.spark
    # Read twice, for the buckets and for the rows.
    arrived = spark.read.parquet(write_snapshot(batch, f"{seen.directory}-arrived", 0))
    return seen.unseen(batch_id, arrived)


def status_stream_audit(spark: SparkSession, out: str) -> DataFrame:
    return _read_versions(spark, f"{out}/audit")


def status_stream_rejects(spark: SparkSession, out: str) -> DataFrame:
    return _read_versions(spark, f"{out}/rejects")


def status_stream_approvals(db: Tables, out: str) -> DataFrame:
    """The last decision on each application that the stream has decided on."""
    stamps = _read_versions(db.spark, f"{out}/stamps")
    last = F.max_by(F.struct("approved_yn", "approved_by", "approval_dt"), "approval_dt").alias("_last")
    return stamps.groupBy("application_id").agg(last).select("application_id", "_last.*")


def status_stream_instances(db: Tables, out: str) -> DataFrame:
    """All instances as the stream has left them."""
    return _instance_store(db, out).latest()


def status_stream_to_contract(spark: SparkSession, out: str) -> DataFrame:
    """Instances that the stream has approved, whose contracts are to be made."""
    return _read_versions(spark, f"{out}/to_contract").distinct()


def status_stream_messages(spark: SparkSession, out: str) -> DataFrame:
    return _read_versions(spark, f"{out}/messages")


# --- owners ------------------------------------------------------------------------------------


def start_owner_stream(updates: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
    """Keep the last change of each updater to each instance.

    The state is one row per instance and updater, and an older stamp never replaces a newer one. A
    hot instance is spread over its updaters and a hot updater over the instances. What a batch changes goes to a
    keyed store, whose segments are merged as the stream runs on.
    """
    changes = instances.last_changes(updates)
    store = _last_changes(updates.sparkSession, out, changes)

    def keep(batch: DataFrame, batch_id: int) -> None:
        store.put(batch_id, batch)

    writer = changes.writeStream.outputMode("update").foreachBatch(keep)
    return _start(writer, f"{out}/checkpoint", available_now)


def owners_from_stream(db: Tables, out: str) -> DataFrame:
    """Staff members who changed each instance last; who is staff counts at the time of reading."""
    kept = _last_changes(db.spark, out, instances.last_changes(db.product_status_updates)).latest()
    return instances.newest_changers(instances.by_staff(db, kept))


def _last_changes(spark: SparkSession, out: str, changes: DataFrame) -> KeyedStore:
    return KeyedStore(spark, f"{out}/last_change", changes.schema, ["product_uid", "update_user"])


# --- current status ----------------------------------------------------------------------------


def start_current_status(updates: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
    """Current status of each instance from a feed of logged changes.

    A change older than the newest one seen does not alter the current status; it is still in the
    log. A repeated log key changes nothing, since the newest change is a maximum.
    """
    newest = F.max(F.struct("update_dt", "prime_uid", "is_code", "update_user")).alias("newest")
    current = updates.groupBy("product_uid").agg(newest)
    store = _current(updates.sparkSession, out)

    def keep(batch: DataFrame, batch_id: int) -> None:
        store.put(batch_id, batch)

    return _start(current.writeStream.outputMode("update").foreachBatch(keep), f"{out}/checkpoint", available_now)


def current_status(spark: SparkSession, out: str) -> DataFrame:
    newest = _current(spark, out).latest()
    return newest.select(
        "product_uid", F.col("newest.is_code").alias("status_code"), F.col("newest.update_dt").alias("update_dt"))


def _current(spark: SparkSession, out: str) -> KeyedStore:
    newest = "newest STRUCT<update_dt: TIMESTAMP_NTZ, prime_uid: BIGINT, is_code: STRING, update_user: BIGINT>"
    return KeyedStore(spark, f"{out}/current", T.StructType.fromDDL(f"product_uid BIGINT, {newest}"), ["product_uid"])


def start_update_log(updates: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
    """The log itself: every change once, late ones too, and a key that arrives again never.

    A batch looks its keys up in the buckets of the keys that have arrived; of rows with one key in a batch, the
    least is logged.
    """
    seen = _seen(updates.sparkSession, out, updates, "prime_uid")

    def log(batch: DataFrame, batch_id: int) -> None:
        new = seen.spark.read.parquet(write_snapshot(_unseen(seen, batch, batch_id), f"{out}/log", batch_id))
        seen.put(batch_id, new)

    return _start(updates.writeStream.foreachBatch(log), f"{out}/checkpoint", available_now)


def update_log(spark: SparkSession, out: str) -> DataFrame:
    return _read_versions(spark, f"{out}/log")


# --- notices -----------------------------------------------------------------------------------


def start_notice_stream(
    db: Tables, changes: DataFrame, out: str, by_client: bool = False, available_now: bool = True
) -> StreamingQuery:
    """Messages about a stream of changes; joins with tables only, so no state is kept.

    A batch is staged first, so its size is known: the tables are read past it and reduced to its instances, and
    nothing of them is shuffled for a small batch.
    """
    spark = db.spark

    def send(batch: DataFrame, batch_id: int) -> None:
        named = batch.select("product_uid", "change_id", "is_code")
        staged = spark.read.parquet(write_snapshot(named, f"{out}/changes", batch_id))
        held = db.product_instances.join(staged.select("product_uid").distinct(), "product_uid", "left_semi")
        messages = notices.status_notifications(db.replace(product_instances=held), staged, by_client)
        write_snapshot(messages, f"{out}/messages", batch_id)

    return _start(changes.writeStream.foreachBatch(send), f"{out}/checkpoint", available_now)


def notice_stream_messages(spark: SparkSession, out: str) -> DataFrame:
    return _read_versions(spark, f"{out}/messages")
