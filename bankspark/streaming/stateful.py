"""Status requests decided inside Spark's keyed state.

The state of an instance that requests have named, its status, its last note and the requests decided last, is a value
of the state store; older requests are in a map beside it. Where an instance starts from is joined to the requests, so
instances that no request names never go through Python. It is the only part of the bank's operators that runs Python
workers; ``feeds.start_status_stream`` decides the same requests by the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from bankspark.functions import columns as C
from bankspark.sources import dims
from bankspark.sources.tables import Tables, write_snapshot

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DECISIONS = (
    "product_uid BIGINT, request_id BIGINT, was STRING, new_status STRING, update_user BIGINT, note STRING, public_yn STRING, "
    "request_dt TIMESTAMP_NTZ, known BOOLEAN, ok BOOLEAN, audit_note STRING"
)
_REQUEST = ["request_id", "new_status", "update_user", "note", "public_yn", "request_dt"]

# Ids of decided requests beside the status, read and written with it in one call; any more move to the map.
IDS_BESIDE = 256


class StatusProcessor(StatefulProcessor):
    """Decides the requests of one instance, in time order inside a batch, on the status the ones before have left."""

    def __init__(self, next_status: dict[str, list[str]]):
        self.next_status = next_status

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.instance = handle.getValueState(
            "instance", "known boolean, status_code string, latest_note string, in_map boolean, ids array<bigint>")
        self.seen = handle.getMapState("seen", "request_id bigint", "new_status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        # No requests before: it starts as its table says.
        held = self.instance.get() or (rows[0].start_known, rows[0].start_status, rows[0].start_note, False, [])
        known, status, last_note, in_map, ids = held
        known, new, decided = bool(known), {}, set(ids)
        order = lambda r: tuple((v is not None, v) for v in (r.request_dt, r.request_id))
        for r in sorted(rows, key=order):
            if r.request_id in new or r.request_id in decided or in_map and self.seen.containsKey((r.request_id,)):
                continue
            new[r.request_id] = r.new_status
            ok = r.new_status in self.next_status.get(status, ())
            # As in SQL, a missing old or new note counts as no change.
            copied = ok and last_note is not None and r.note is not None and last_note != r.note
            yield Row(
                product_uid=key[0], request_id=r.request_id, was=status, new_status=r.new_status, update_user=r.update_user,
                note=r.note, public_yn=r.public_yn, request_dt=r.request_dt, known=known, ok=ok,
                audit_note=r.note if copied else None)
            if ok:
                status, last_note = r.new_status, last_note if r.note is None else r.note
        if not new:
            return
        ids = [*ids, *new]
        if len(ids) > IDS_BESIDE:
            for request_id in ids:
                self.seen.updateValue((request_id,), (new.get(request_id),))
            in_map, ids = True, []
        self.instance.update((known, status, last_note, in_map, ids))

    def close(self) -> None:
        pass


def decisions(db: Tables, requests: DataFrame) -> DataFrame:
    """A stream of decisions on a stream of status requests; the instances' table says where they start from.

    The table is read in every batch, for instances without requests before, so it must stay as it was when the stream
    began. Late requests are decided when they arrive; a request that arrives again is known by its id and left out.
    """
    start = db.product_instances.select(
        "product_uid", F.lit(True).alias("start_known"), F.col("status_code").alias("start_status"),
        F.col("latest_note").alias("start_note"))
    placed = requests.select("product_uid", *_REQUEST).join(start, "product_uid", "left")
    return placed.groupBy("product_uid").transformWithState(
        StatusProcessor(dims.NEXT_STATUS), DECISIONS, "append", "none")


def start_status_state(db: Tables, requests: DataFrame, out: str, available_now: bool = True) -> StreamingQuery:
    """Write the decisions of every batch under ``out``; state and progress are in its checkpoint."""
    spark = db.spark
    spark.conf.set(_PROVIDER, _ROCKS)

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(batch, f"{out}/decisions", batch_id)

    writer = decisions(db, requests).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _decided(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/decisions").drop("version")


def state_audit(spark: SparkSession, out: str) -> DataFrame:
    """One row per accepted change."""
    ok = _decided(spark, out).filter("ok")
    return ok.select(
        "product_uid", "request_id", F.col("was").alias("was_status"), F.col("new_status").alias("is_code"),
        F.col("request_dt").alias("update_dt"), "update_user", F.col("audit_note").alias("update_note"),
        F.when(F.col("audit_note").isNotNull(), C.yes_no(F.col("public_yn"))).alias("update_note_public_yn"))


def state_rejects(spark: SparkSession, out: str) -> DataFrame:
    reason = F.when(F.col("known"), "transition_not_allowed").otherwise("unknown_instance")
    return _decided(spark, out).filter("NOT ok").select("request_id", "product_uid", reason.alias("reason"))
