"""Stateful processing by key, as batch folds and on streams: durable jobs under leases, schedules, checkouts, reviews, audit logs,
notifications and outboxes. A fold deals rows by key, sorts them and reads them one by one; all that is held is a state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quireframe.session import ship_code

#: Attempts of a job, and runs of a schedule, at most; how late a schedule may be before it skips what it missed.
ATTEMPTS = 3
RUNS = 256
GRACE_MS = 3_600_000
TERMINAL = ("completed", "failed", "cancelled")

Step = Callable[[tuple, dict], tuple[tuple, tuple]]


def folded(rows: DataFrame, of: str, order: list[str], start: tuple, step: Step, made: str) -> DataFrame:
    """``rows`` with the columns ``made`` (a schema) that ``step`` gives for each in order, from a state that begins as
    ``start`` for every key: (state, row) to (state, values). Keys are dealt out, so that a hot one takes a task's time
    and no memory."""
    ship_code(rows.sparkSession)
    names, out = rows.columns, T._parse_datatype_string(made)
    kinds = [to_arrow_type(f.dataType) for f in out]
    at = names.index(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), start
        for b in batches:
            values = []
            for row in b.to_pylist():
                if row[names[at]] != key:
                    key, state = row[names[at]], start
                state, value = step(state, row)
                values.append(value)
            columns = [pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*names, *out.names])

    return rows.repartition(of).sortWithinPartitions(of, *order).mapInArrow(run, T.StructType([*rows.schema.fields, *out.fields]))


NO_JOB = ("none", 0, None, None)
JOB = "status string, attempts int, expires long, not_before long, accepted boolean"


def job_step(state: tuple, event: dict) -> tuple[tuple, tuple]:
    """One event of a job (at in ms, action, lease_ms, transient, delay_ms) on its state: status, attempts, the lease's end and
    the moment before which it must not be claimed. A lease that has ended gives the job back first, or fails it for good if
    its attempts are used up. What the state does not allow is not accepted and changes nothing."""
    status, attempts, expires, not_before = state
    at, action = event["at"], event["action"]
    if status == "running" and expires <= at:
        status, expires, not_before = ("failed" if attempts >= ATTEMPTS else "pending"), None, None
    ok = True
    if action == "enqueue":
        if status == "none":
            status = "pending"
    elif action == "claim" and status == "pending" and (not_before is None or not_before <= at):
        status, attempts, expires, not_before = "running", attempts + 1, at + event["lease_ms"], None
    elif action == "renew" and status == "running":
        expires = at + event["lease_ms"]
    elif action == "complete" and status == "running":
        status, expires = "completed", None
    elif action == "fail" and status == "running":
        again = bool(event["transient"]) and attempts < ATTEMPTS
        status, expires, not_before = ("pending", None, at + event["delay_ms"]) if again else ("failed", None, None)
    elif action == "cancel" and status != "none":
        if status not in TERMINAL:
            status, expires, not_before = "cancelled", None, None
    else:
        ok = False
    state = (status, attempts, expires, not_before)
    return state, (*state, ok)


def job_states(events: DataFrame) -> DataFrame:
    """``events`` (job, at, seq, action, lease_ms, transient, delay_ms) with the state of their job after each, and whether the
    event was accepted."""
    return folded(events, "job", ["at", "seq"], NO_JOB, job_step, JOB)


def job_states_stream(events: DataFrame) -> DataFrame:
    """The same on a stream, as far as events of a job come in order: a row for each event. The state of a job that came to an
    end is dropped a day of processing time later."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(None if v == "" or v == -1 else v for v in state.get) if state.exists else NO_JOB
        out = []
        for rows in batches:
            for r in rows.sort_values(["at", "seq"]).to_dict("records"):
                now, made = job_step(now, r)
                out.append((key[0], int(r["at"]), int(r["seq"]), r["action"], *made))
        state.update(tuple(-1 if v is None else v for v in now))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame(out, columns=["job", "at", "seq", "action", "status", "attempts", "expires", "not_before", "accepted"]).astype({"expires": "Int64", "not_before": "Int64"})

    kind = events.schema["job"].dataType.simpleString()
    return events.groupBy("job").applyInPandasWithState(step, f"job {kind}, at long, seq long, action string, {JOB}", "status string, attempts int, expires long, not_before long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def job_states_timed(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """``job_states_stream`` with leases that end by themselves: once the events of any jobs have come so far (``late`` is how much
    later one may come) that a lease is over, its job goes back to pending, or fails where its attempts are used up, and a row
    of action expire, at the lease's end and with seq null, tells so. No further event of the job is needed. The state of a
    job that came to an end is dropped a day of event time later."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(None if v == "" or v == -1 else v for v in state.get) if state.exists else NO_JOB
        out = []
        if state.hasTimedOut:
            if now[0] in TERMINAL:
                state.remove()
                return
            at = now[2]
            now, (*made, _) = job_step(now, {"at": at, "action": "expire"})
            out.append((key[0], int(at), None, "expire", *made, True))
        else:
            for rows in batches:
                for r in rows.sort_values(["at", "seq"]).to_dict("records"):
                    now, made = job_step(now, r)
                    out.append((key[0], int(r["at"]), int(r["seq"]), r["action"], *made))
        state.update(tuple(-1 if v is None else v for v in now))
        mark = state.getCurrentWatermarkMs()
        if now[0] == "running":
            state.setTimeoutTimestamp(max(int(now[2]), mark + 1))
        elif now[0] in TERMINAL:
            state.setTimeoutTimestamp(mark + 86_400_000)
        yield pd.DataFrame(out, columns=["job", "at", "seq", "action", "status", "attempts", "expires", "not_before", "accepted"]).astype({"seq": "Int64", "expires": "Int64", "not_before": "Int64"})

    kind = events.schema["job"].dataType.simpleString()
    timed = events.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return timed.groupBy("job").applyInPandasWithState(step, f"job {kind}, at long, seq long, action string, {JOB}", "status string, attempts int, expires long, not_before long", "append", GroupStateTimeout.EventTimeTimeout)


def schedule_ticks(ticks: DataFrame, grace: int = GRACE_MS, most: int = RUNS) -> DataFrame:
    """Ticks (schedule, now, first_at, interval_ms; a null interval runs once) with what each schedule does at them: due,
    scheduled_at (late by more than ``grace``, it jumps to the last moment that was missed), occurrence (its key), and next_at
    and runs afterwards."""

    def step(state: tuple, r: dict) -> tuple[tuple, tuple]:
        next_at, runs, begun = state
        if not begun:
            next_at = r["first_at"]
        if next_at is None or next_at > r["now"] or runs >= most:
            return (next_at if runs < most else None, runs, True), (False, None, None, next_at if runs < most else None, runs)
        at, every = next_at, r["interval_ms"]
        if every is not None and r["now"] - at > grace:
            at += (r["now"] - at) // every * every
        next_at = None if every is None else at + every
        return (next_at, runs + 1, True), (True, at, f"automation-schedule:{r['schedule']}:{at}", next_at, runs + 1)

    return folded(ticks, "schedule", ["now"], (None, 0, False), step, "due boolean, scheduled_at long, occurrence string, next_at long, runs int")


def checkouts(events: DataFrame) -> DataFrame:
    """Events (document, seq, action: checkout or checkin, owner) with the document's owner after each (null: free) and whether
    the event was accepted: a document that another has out can be neither taken nor given back."""

    def step(state: tuple, r: dict) -> tuple[tuple, tuple]:
        owner, who = state[0], r["owner"]
        if r["action"] == "checkout":
            ok = owner is None or owner == who
            owner = who if ok else owner
        else:
            ok = owner is not None and owner == who
            owner = None if ok else owner
        return (owner,), (owner, ok)

    kind = events.schema["owner"].dataType.simpleString()
    return folded(events, "document", ["seq"], (None,), step, f"holder {kind}, accepted boolean")


def review_rooms(events: DataFrame) -> DataFrame:
    """Events of rooms (room, seq, action: join or post, participant) with accepted and the room's revision after each: a first
    join and every post of one who has joined raise it."""
    w = Window.partitionBy("room", "participant").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    joined = F.coalesce(F.max((F.col("action") == "join").cast("int")).over(w), F.lit(0)) == 1
    ok = (F.col("action") == "join") | joined
    raises = F.when(F.col("action") == "join", ~joined).otherwise(joined)
    room = Window.partitionBy("room").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"accepted": ok, "_up": raises.cast("long")}).withColumn("revision", F.sum("_up").over(room)).drop("_up")


MENTION = r"(?<![A-Za-z0-9_@])@([a-z0-9][a-z0-9._-]{0,63})"


def mentions(comments: DataFrame) -> DataFrame:
    """Notifications of those whom comments (source, annotation, comment, actor, at: texts; text) mention as @name: event_id, the
    SHA-256 of the canonical JSON of what they are about, so that the same mention is one however often it is seen;
    reviewer, actor, annotation and comment. On a stream, give it a watermark first."""
    q = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(.*)\}$", "$1"), F.lit("null"))
    q2 = lambda c: F.when(c.isNull(), "null").otherwise(q(c))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)))
    each = comments.select("source", "annotation", "comment", "actor", "at", F.explode(names).alias("name"))
    each = each.withColumn("reviewer", F.concat(F.lit("reviewer-"), "name"))
    body = F.concat(F.lit('{"annotationId":'), q2(F.col("annotation")), F.lit(',"commentId":'), q2(F.col("comment")), F.lit(',"mentionedReviewer":'), q2(F.col("reviewer")), F.lit(',"schemaVersion":1,"sourceSha256":'), q2(F.col("source")), F.lit(',"timestamp":'), q2(F.col("at")), F.lit("}"))
    return each.select(F.sha2(body, 256).alias("event_id"), "reviewer", "actor", "annotation", "comment").dropDuplicates(["event_id"])


def appended(log: DataFrame, events: DataFrame, key: str, order: str, content: list[str]) -> DataFrame:
    """What becomes of events that are to be appended to a log once each: key, order and status appended, same (it is there with
    this content, or came before in this batch) or conflict (with another)."""
    same = lambda c: F.to_json(F.struct(*content), {"ignoreNullFields": "false"}).alias(c)
    known = log.select(F.col(key).alias("_k"), same("_is"))
    each = events.select(key, order, same("_new"))
    w = Window.partitionBy(key).orderBy(order)
    each = each.withColumns({"_first": F.first("_new").over(w), "_n": F.row_number().over(w)}).join(known, F.col(key) == F.col("_k"), "left")
    there = F.coalesce("_is", F.when(F.col("_n") > 1, F.col("_first")))
    return each.select(key, order, F.when(there.isNull(), "appended").when(there == F.col("_new"), "same").otherwise("conflict").alias("status"))


def batch_results(files: DataFrame, of: str, order: str, error: str, terminal: Column) -> DataFrame:
    """Files of batches that are done one after the other: status ok, failed, stopped for the first terminal error, and
    not-attempted for what comes after it."""
    t = F.coalesce(terminal, F.lit(False))
    stops = F.min(F.when(t, F.col(order))).over(Window.partitionBy(of))
    status = F.when(F.col(order) > stops, "not-attempted").when(F.col(order) == stops, "stopped").when(F.col(error).isNotNull(), "failed").otherwise("ok")
    return files.withColumn("status", status)


def version_history(versions: DataFrame, of: str, order: str) -> DataFrame:
    """Versions (digest, parent) with their number (from 1) and whether each names the one before as its parent (the first:
    none)."""
    w = Window.partitionBy(of).orderBy(order)
    return versions.withColumns({"number": F.row_number().over(w), "linked": F.col("parent").eqNullSafe(F.lag("digest").over(w))})


def outbox(events: DataFrame, key: str, kind: str, body: list[str]) -> DataFrame:
    """Records that wait to be sent, none of which goes out: id (of kind and body, so that a record made twice is one), kind,
    body (JSON) and n_bytes."""
    json = F.to_json(F.struct(*body))
    each = events.select(key, F.col(kind).alias("kind"), json.alias("body"))
    return each.select(F.sha2(F.concat_ws("|", "kind", "body"), 256).alias("id"), key, "kind", "body", F.octet_length("body").cast("long").alias("n_bytes")).dropDuplicates(["id"])


def append_once(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Write a stream's rows to a table at ``path``, each key once, however often a batch is repeated: a batch that was written
    is told by its number, and keys that are there are left out."""

    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates([key])
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            old = spark.read.schema(batch.schema.add("batch", "long")).parquet(path)
            rows = rows.join(old.filter(F.col("batch") != number).select(key), key, "left_anti")
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_within(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """``rows`` with each key once. On a stream the first row of a key is taken, and its repeats are told as long as they come
    no later than ``late`` after it in the time of ``at``, so that what is held is bounded by that; a repeat that is later still
    is a row of its own. On a batch all repeats are told. Which of rows of one moment is taken is open."""
    if rows.isStreaming:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def append_within(stream: DataFrame, path: str, key: str, at: str, late: str, checkpoint: str):
    """Write a stream's rows to a table at ``path``, each key once by ``once_within``; nothing of the table is read again."""
    return once_within(stream, key, at, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_manifest(events: DataFrame, of: str) -> DataFrame:
    """One line of JSON for each watch or batch: its events by status and whether all were done well."""
    each = events.groupBy(of).agg(F.count("*").alias("events"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
    return each.select(of, F.to_json(F.struct((F.col("failed") == 0).alias("complete"), "events", "failed", "ok")).alias("line"))
