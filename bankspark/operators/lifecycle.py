"""Status changes: requests checked against the lifecycle, audit rows, and the nightly sweeps.

Nothing is updated in place. Every operator maps the present tables to the rows after the change,
the audit rows and the refused requests; writing the next snapshot is up to the caller.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from bankspark.functions import columns as C
from bankspark.operators.ordering import positions_within
from bankspark.session import checkpointed
from bankspark.sources import dims
from bankspark.sources.tables import Tables

# Requests of one instance that are folded in one array. Longer histories are folded in pieces, with the same
# result. The fold copies its output at each request, so pieces are small: the work then grows with the requests.
FOLD_LIMIT = 100

_OUT = (
    "array<struct<request_dt: timestamp_ntz, request_id: bigint, was: string, new_status: string, "
    "update_user: bigint, note: string, public_yn: string, known: boolean, edge: boolean, ok: boolean, "
    "audit_note: string>>"
)


# --- lifecycle graph ---------------------------------------------------------------------------


def _steps(db: Tables, graph: DataFrame, instances: DataFrame) -> DataFrame:
    names = db.product_statuses.select(
        F.col("code").alias("to_status"), "status_name", "call_to_action", "status_description"
    )
    return (
        instances.select("product_uid", F.col("status_code").alias("from_status"))
        .join(graph, "from_status").join(names, "to_status")
    )


def next_actions(db: Tables) -> DataFrame:
    """Statuses each instance may move to next, named by their call to action; none when closed."""
    return _steps(db, db.next_status, db.product_instances).select(
        "product_uid", "pos", F.col("to_status").alias("status_code"), F.col("call_to_action").alias("status_name"),
        "status_description",
    )


def progression(db: Tables) -> DataFrame:
    """Statuses still ahead of each instance when all goes well."""
    return _steps(db, db.progression, db.product_instances).select(
        "product_uid", "pos", F.col("to_status").alias("status_code"), "status_name", "status_description"
    )


def client_actions(db: Tables) -> DataFrame:
    """Next statuses offered to the client; signing goes its own way, so AWT is offered, not accepted here."""
    offered = next_actions(db).filter(F.col("status_code").isin(*dims.CLIENT_OFFERED))
    accepted = F.when(F.col("status_code").isin(*dims.CLIENT_ACCEPTED), "Y").otherwise("N")
    return offered.select("product_uid", "pos", "status_code", "status_name", accepted.alias("accepted_yn"))


def _next_map() -> Column:
    pairs = []
    for origin, targets in dims.NEXT_STATUS.items():
        pairs += [F.lit(origin), F.array(*[F.lit(t) for t in targets])]
    return F.create_map(*pairs)


# --- requests ----------------------------------------------------------------------------------


@dataclass
class StatusChanges:
    decisions: DataFrame  # every request with its outcome
    instances: DataFrame  # all instances after the changes
    changed: DataFrame  # the instances that took a change
    applications: DataFrame  # all applications after the changes
    audit: DataFrame  # one row per accepted change
    rejects: DataFrame  # request_id, product_uid, reason
    to_contract: DataFrame  # product_uid of newly approved instances
    stamps: DataFrame  # application_id, approved_yn, approved_by, approval_dt of decided applications


def _edge(status: Column, target: Column) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(_next_map(), status), target), F.lit(False))


def _accepts(status: Column, target: Column, accepted: tuple[str, ...] | None) -> Column:
    edge = _edge(status, target)
    return edge if accepted is None else edge & target.isin(*accepted)


def _fold(groups: DataFrame, accepted: tuple[str, ...] | None) -> DataFrame:
    """Decide the ordered requests of each group, starting from ``start_status`` and ``start_note``.

    The note of an audit row follows SQL comparison: it is copied only when old and new note are
    both present and differ.
    """
    start = F.struct(
        F.col("start_status").alias("status"), F.col("start_note").alias("note"),
        F.array().cast(_OUT).alias("out"),
    )

    def step(acc, r):
        edge = _edge(acc["status"], r["new_status"])
        ok = _accepts(acc["status"], r["new_status"], accepted)
        decision = F.struct(
            r["request_dt"].alias("request_dt"), r["request_id"].alias("request_id"), acc["status"].alias("was"),
            r["new_status"].alias("new_status"), r["update_user"].alias("update_user"), r["note"].alias("note"),
            r["public_yn"].alias("public_yn"), acc["status"].isNotNull().alias("known"), edge.alias("edge"),
            ok.alias("ok"), F.when(ok & (acc["note"] != r["note"]), r["note"]).alias("audit_note"),
        )
        return F.struct(
            F.when(ok, r["new_status"]).otherwise(acc["status"]).alias("status"),
            F.when(ok & r["note"].isNotNull(), r["note"]).otherwise(acc["note"]).alias("note"),
            F.concat(acc["out"], F.array(decision)).alias("out"),
        )

    return groups.select("product_uid", F.inline(F.aggregate("requests", start, step)["out"]))


def _request_array() -> Column:
    item = F.struct("request_dt", "request_id", "new_status", "update_user", "note", "public_yn")
    return F.sort_array(F.collect_list(item)).alias("requests")


def _by_piece(left: Column, right: Column) -> Column:
    return F.when(left["piece"] < right["piece"], -1).when(left["piece"] > right["piece"], 1).otherwise(0)


def _fold_in_pieces(requests: DataFrame, start: DataFrame, accepted, limit: int, largest: int) -> DataFrame:
    """The same fold for instances with very many requests.

    What a run of requests does to an instance is a function of the status it starts from, and such
    functions compose. Requests are cut into pieces of ``limit``; each piece is summed up as a map
    from start to end status (with the last note written), pieces are summed up in turn until one is
    left per instance, and the true start statuses are then handed down to the pieces.
    """
    numbered = positions_within(requests, ["product_uid"], ["request_dt", "request_id"], "_pos", limit)
    piece = F.floor((F.col("_pos") - 1) / limit).cast("bigint")
    leaves = checkpointed(
        numbered.withColumn("piece", piece).groupBy("product_uid", "piece").agg(_request_array())
    )
    codes = F.array(*[F.lit(c) for c in dims.STATUS_CODES])

    def no_change(code):
        return F.struct(code.alias("status"), F.lit(None).cast("string").alias("note"))

    def by_start_status(run):
        return F.map_from_arrays(codes, F.transform(codes, run))

    def run_requests(code):
        def step(acc, r):
            ok = _accepts(acc["status"], r["new_status"], accepted)
            return F.struct(
                F.when(ok, r["new_status"]).otherwise(acc["status"]).alias("status"),
                F.when(ok & r["note"].isNotNull(), r["note"]).otherwise(acc["note"]).alias("note"),
            )
        return F.aggregate("requests", no_change(code), step)

    def then(acc, effect):
        after = F.try_element_at(effect, acc["status"])
        return F.struct(after["status"].alias("status"), F.coalesce(after["note"], acc["note"]).alias("note"))

    def run_parts(code):
        return F.aggregate("parts", no_change(code), lambda acc, p: then(acc, p["effect"]))

    levels = []
    nodes = leaves.select("product_uid", "piece", by_start_status(run_requests).alias("effect"))
    pieces = -(-largest // limit)
    while True:
        parent = F.floor(F.col("piece") / limit).cast("bigint").alias("parent")
        part = F.struct("piece", "effect")
        nodes = nodes.groupBy("product_uid", parent).agg(
            F.array_sort(F.collect_list(part), _by_piece).alias("parts")
        )
        levels.append(nodes)
        pieces = -(-pieces // limit)
        if pieces <= 1:
            break
        nodes = nodes.select(
            "product_uid", F.col("parent").alias("piece"), by_start_status(run_parts).alias("effect")
        )

    starts = levels[-1].select("product_uid", "parent").join(start, "product_uid", "left")
    for level in reversed(levels):
        first = F.struct(
            F.col("start_status").alias("status"), F.col("start_note").alias("note"),
            F.array().cast("array<struct<piece: bigint, start_status: string, start_note: string>>").alias("out"),
        )

        def hand_down(acc, p):
            after = then(acc, p["effect"])
            mine = F.struct(p["piece"].alias("piece"), acc["status"].alias("start_status"), acc["note"].alias("start_note"))
            return F.struct(
                after["status"].alias("status"), after["note"].alias("note"),
                F.concat(acc["out"], F.array(mine)).alias("out"),
            )

        starts = (
            level.join(starts, ["product_uid", "parent"])
            .select("product_uid", F.inline(F.aggregate("parts", first, hand_down)["out"]))
            .withColumnRenamed("piece", "parent")
        )
    return _fold(leaves.join(starts.withColumnRenamed("parent", "piece"), ["product_uid", "piece"]), accepted)


def decide_requests(
    db: Tables, requests: DataFrame, accepted: tuple[str, ...] | None = None, limit: int = FOLD_LIMIT
) -> DataFrame:
    """Outcome of ``requests(request_id, product_uid, new_status, update_user, note, public_yn, request_dt)``.

    The requests of one instance are decided one after another by time, then id: each is accepted
    if the lifecycle allows it from the status the ones before have left. ``accepted`` narrows the
    target statuses, for clients.
    """
    start = db.product_instances.select(
        "product_uid", F.col("status_code").alias("start_status"), F.col("latest_note").alias("start_note")
    )
    columns = ["product_uid", "request_id", "new_status", "update_user", "note", "public_yn", "request_dt"]
    requests = requests.select(*columns)
    counts = requests.groupBy("product_uid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    largest = counts.agg(F.max("n")).first()[0]
    if largest is None:
        groups = requests.groupBy("product_uid").agg(_request_array())
        decided = _fold(groups.join(start, "product_uid", "left"), accepted)
    else:
        long = checkpointed(counts.select("product_uid"))  # few, and read three times
        groups = requests.join(long, "product_uid", "left_anti").groupBy("product_uid").agg(_request_array())
        decided = _fold(groups.join(start, "product_uid", "left"), accepted).unionByName(
            _fold_in_pieces(requests.join(long, "product_uid", "left_semi"), start, accepted, limit, largest)
        )
    reason = (
        F.when(~F.col("known"), "unknown_instance").when(~F.col("edge"), "transition_not_allowed")
        .when(~F.col("ok"), "not_a_client_action")
    )
    return decided.withColumn("reason", reason).drop("known", "edge")


def apply_status_changes(
    db: Tables,
    requests: DataFrame,
    accepted: tuple[str, ...] | None = None,
    limit: int = FOLD_LIMIT,
    materialize: bool = False,
) -> StatusChanges:
    """Apply status-change requests of employees; see ``decide_requests``.

    An accepted change sets status and updater, and the note with its public flag if a note is
    given. APR and DEN stamp the application, with ``approved_yn`` 'Y' exactly for APR. With
    ``materialize`` the decisions are checkpointed, for callers that write several of the results.
    """
    decisions = decide_requests(db, requests, accepted, limit)
    if materialize:
        decisions = checkpointed(decisions)
    ok = decisions.filter("ok")
    order = F.struct("request_dt", "request_id")
    noted = F.when(F.col("note").isNotNull(), order)
    last = ok.groupBy("product_uid").agg(
        F.max_by("new_status", order).alias("_status"),
        F.max_by("update_user", order).alias("_user"),
        F.max_by(F.struct("note", C.yes_no(F.col("public_yn")).alias("public_yn")), noted).alias("_note"),
    )
    changed = F.col("_status").isNotNull()
    new_values = {
        "status_code": F.coalesce("_status", "status_code"),
        "latest_update_user_id": F.when(changed, F.col("_user")).otherwise(F.col("latest_update_user_id")),
        "latest_note": F.coalesce(F.col("_note.note"), F.col("latest_note")),
        "latest_note_public_yn": F.coalesce(F.col("_note.public_yn"), F.col("latest_note_public_yn")),
    }
    columns = [new_values[c].alias(c) if c in new_values else F.col(c) for c in db.product_instances.columns]
    return StatusChanges(
        decisions=decisions,
        instances=db.product_instances.join(last, "product_uid", "left").select(*columns),
        changed=db.product_instances.join(last, "product_uid").select(*columns),
        applications=_stamp_applications(db, ok) if accepted is None else db.applications,
        audit=ok.select(
            "product_uid", "request_id", F.col("was").alias("was_status"), F.col("new_status").alias("is_code"),
            F.col("request_dt").alias("update_dt"), "update_user", F.col("audit_note").alias("update_note"),
            F.when(F.col("audit_note").isNotNull(), C.yes_no(F.col("public_yn"))).alias("update_note_public_yn"),
        ),
        rejects=decisions.filter(~F.col("ok")).select("request_id", "product_uid", "reason"),
        to_contract=ok.filter(F.col("new_status") == "APR").select("product_uid").distinct(),
        stamps=_stamps(db, ok),
    )


def _stamps(db: Tables, ok: DataFrame) -> DataFrame:
    """The last decision on each application."""
    decided = (
        ok.filter(F.col("new_status").isin("APR", "DEN"))
        .join(db.product_instances.select("product_uid", "application_id"), "product_uid")
        .groupBy("application_id")
        .agg(F.max_by(
            F.struct("new_status", "update_user", "request_dt"), F.struct("request_dt", "request_id")
        ).alias("_stamp"))
    )
    return decided.select(
        "application_id", F.when(F.col("_stamp.new_status") == "APR", "Y").otherwise("N").alias("approved_yn"),
        F.col("_stamp.update_user").alias("approved_by"), F.col("_stamp.request_dt").alias("approval_dt"),
    )


def _stamp_applications(db: Tables, ok: DataFrame) -> DataFrame:
    columns = ["approved_yn", "approved_by", "approval_dt"]
    decided = _stamps(db, ok).select("application_id", F.struct(*columns).alias("_stamp"))
    stamped = F.col("_stamp").isNotNull()
    return db.applications.join(decided, "application_id", "left").select(*[
        F.when(stamped, F.col("_stamp." + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in db.applications.columns
    ])


def apply_client_changes(db: Tables, requests: DataFrame, **options) -> StatusChanges:
    """The same for clients: only CNL, AGR and DIS, and no stamp on the application."""
    return apply_status_changes(db, requests, accepted=dims.CLIENT_ACCEPTED, **options)


# --- change capture ----------------------------------------------------------------------------


def audit_rows(old: DataFrame, new: DataFrame, as_of: dt.datetime, null_safe_notes: bool = False) -> DataFrame:
    """Audit rows for the instances whose status differs between two snapshots.

    The note is copied if it changed. As in SQL, a missing old or new note counts as no change;
    ``null_safe_notes`` copies a new note after a missing one as well.
    """
    was = old.select("product_uid", F.col("status_code").alias("was_status"), F.col("latest_note").alias("old_note"))
    now = new.select(
        "product_uid", F.col("status_code").alias("is_code"), F.col("latest_update_user_id").alias("update_user"),
        F.col("latest_note").alias("new_note"), F.col("latest_note_public_yn").alias("new_public_yn"),
    )
    differs = ~F.col("old_note").eqNullSafe(F.col("new_note")) if null_safe_notes else F.col("old_note") != F.col("new_note")
    return was.join(now, "product_uid").filter(F.col("was_status") != F.col("is_code")).select(
        "product_uid", "was_status", "is_code", C.moment(as_of).alias("update_dt"), "update_user",
        F.when(differs, F.col("new_note")).alias("update_note"),
        F.when(differs, F.col("new_public_yn")).alias("update_note_public_yn"),
    )


# --- sweeps ------------------------------------------------------------------------------------

OVERDUE_DAYS = 7
STEPS = ("due", "overdue", "exercise", "back_to_normal")


def _move(rows: DataFrame, target: str) -> DataFrame:
    return rows.select("product_uid", F.col("status_code").alias("was_status"), F.lit(target).alias("is_code"))


def _day(as_of: dt.date) -> Column:
    return C.day(as_of)


def _on_day(column: Column, day: Column, catch_up: bool) -> Column:
    return column <= day if catch_up else column == day


def sweep_due(db: Tables, as_of: dt.date, catch_up: bool = False) -> DataFrame:
    """Running products whose end date is ``as_of`` fall due; ``catch_up`` takes missed days too."""
    hit = (F.col("status_code") == "NOR") & _on_day(F.col("product_end_date"), _day(as_of), catch_up)
    return _move(db.product_instances.filter(hit), "DUE")


def sweep_overdue(db: Tables, as_of: dt.date, catch_up: bool = False) -> DataFrame:
    """Due products whose end date is seven days back become overdue."""
    day = F.date_sub(_day(as_of), OVERDUE_DAYS)
    hit = (F.col("status_code") == "DUE") & _on_day(F.col("product_end_date"), day, catch_up)
    return _move(db.product_instances.filter(hit), "ORD")


def _exercise_dates(db: Tables, days: list[Column]) -> DataFrame:
    """(product_uid, date_value) of exercise dates on the given days."""
    defs = db.product_custom_column_def.filter(F.col("exercise_date_yn") == "Y").select("pcc_id")
    values = db.product_custom_column_values.select("product_uid", "pcc_id", "date_value")
    return values.filter(F.col("date_value").isin(*days)).join(defs, "pcc_id", "left_semi")


def sweep_exercise(db: Tables, as_of: dt.date) -> DataFrame:
    """Running products with an exercise date on ``as_of``."""
    dated = _exercise_dates(db, [_day(as_of)]).select("product_uid")
    rows = db.product_instances.filter(F.col("status_code") == "NOR").join(dated, "product_uid", "left_semi")
    return _move(rows, "EXC")


def sweep_back_to_normal(db: Tables, as_of: dt.date) -> DataFrame:
    """Products whose exercise date was the day before run on."""
    dated = _exercise_dates(db, [F.date_sub(_day(as_of), 1)]).select("product_uid")
    rows = db.product_instances.filter(F.col("status_code") == "EXC").join(dated, "product_uid", "left_semi")
    return _move(rows, "NOR")


@dataclass
class Nightly:
    instances: DataFrame  # all instances after the night
    audit: DataFrame  # one row per step taken


def nightly(db: Tables, as_of: dt.date, catch_up: bool = False, counts: Observation | None = None) -> Nightly:
    """Due, overdue, exercise and back-to-normal sweeps, each on what the one before left.

    One pass: the two exercise days are looked up once per instance, and the four steps are
    expressions on one row. An instance may move twice in a night, also straight back to running
    when it has exercise dates on both days. Sweeps write the automation account and no note.
    ``counts`` takes the number of rows of each step along with the first result that is written.
    """
    today, yesterday = _day(as_of), F.date_sub(_day(as_of), 1)
    exercise = (
        _exercise_dates(db, [today, yesterday]).groupBy("product_uid").agg(
            F.max(F.col("date_value") == today).alias("_ex_today"),
            F.max(F.col("date_value") == yesterday).alias("_ex_yesterday"),
        )
    )
    end = F.col("product_end_date")
    rules = [
        ("due", "NOR", "DUE", _on_day(end, today, catch_up)),
        ("overdue", "DUE", "ORD", _on_day(end, F.date_sub(today, OVERDUE_DAYS), catch_up)),
        ("exercise", "NOR", "EXC", F.col("_ex_today")),
        ("back_to_normal", "EXC", "NOR", F.col("_ex_yesterday")),
    ]
    rows = db.product_instances.join(exercise, "product_uid", "left").withColumn("_s0", F.col("status_code"))
    for i, (_, source, target, hit) in enumerate(rules):
        before = F.col(f"_s{i}")
        rows = rows.withColumn(f"_s{i + 1}", F.when((before == source) & hit, target).otherwise(before))
    if counts is not None:
        rows = rows.observe(counts, *[
            F.count_if(F.col(f"_s{i}") != F.col(f"_s{i + 1}")).alias(name) for i, (name, *_) in enumerate(rules)
        ])
    steps = F.array(*[
        F.struct(F.lit(name).alias("step"), F.col(f"_s{i}").alias("was_status"), F.col(f"_s{i + 1}").alias("is_code"))
        for i, (name, *_) in enumerate(rules)
    ])
    taken = F.filter(steps, lambda s: s["was_status"] != s["is_code"])
    moved = F.size(taken) > 0
    new_values = {
        "status_code": F.col(f"_s{len(rules)}"),
        "latest_update_user_id": F.when(moved, F.lit(dims.AUTOMATION_ACCOUNT).cast("bigint")).otherwise(
            F.col("latest_update_user_id")
        ),
        "latest_note": F.when(~moved, F.col("latest_note")),
    }
    instances = rows.select(
        *[new_values[c].alias(c) if c in new_values else F.col(c) for c in db.product_instances.columns]
    )
    audit = rows.select("product_uid", F.inline(taken)).select(
        "product_uid", "step", "was_status", "is_code",
        C.moment(as_of).alias("update_dt"),
        F.lit(dims.AUTOMATION_ACCOUNT).cast("bigint").alias("update_user"),
        F.lit(None).cast("string").alias("update_note"), F.lit(None).cast("string").alias("update_note_public_yn"),
    )
    return Nightly(instances, audit)


def sweep_summary(night: Nightly) -> DataFrame:
    """Number of rows each step moved, with 0 for a step that moved none."""
    moved = night.audit.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    steps = night.audit.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{s}')" for s in STEPS) + " AS t(step)")
    return steps.join(moved, "step", "left").select("step", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))


def observed_summary(spark: SparkSession, counts: Observation) -> DataFrame:
    """``sweep_summary`` from what was counted while the night's rows were written; no second pass."""
    seen = counts.get
    return spark.createDataFrame([(step, int(seen[step])) for step in STEPS], "step STRING, n_rows BIGINT")
