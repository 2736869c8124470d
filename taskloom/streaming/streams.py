"""Live variants of the operators on Structured Streaming.

What the built-in streaming operators express (deduplication, tumbling and session windows, sums) is left to them. Notifications
on a change of status need the status before: each micro-batch is joined to the newest known status of its keys, read from the buckets of
a store that hold them, and changes inside the batch are found by a running aggregate. Neither gathers the rows of one key in one task, so a key
that sends a third of all rows is no special case. Every micro-batch is one commit under the stream's own name and batch id, may be
repeated safely, and leaves the rows written before it where they are. Where other writers have changed the same rows in the meantime, the
micro-batch is computed again on top of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.running import running
from ..model import STALE_SECONDS, Tables
from ..operators.delta import Append, Delete, Upsert
from ..operators.embed import EmbedFunction, reembed
from ..operators.ingest import ANSWER_CHARS, submit_results
from ..session import scratch_path, stage, staging
from ..sources.store import (
    Changes,
    VersionTaken,
    changed_rows,
    committed_batch,
    manifest,
    newest_version,
    read_snapshot,
    rows_near,
    seen_version,
    write_snapshot,
)

# 2**20 microseconds, about a second: the piece of a key's history that is scanned in one window.
_TIME_BITS = 20


def status_changes(batch: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """Rows (key, …, status, ts) whose status differs from the one before, with that `previous` status.

    `known` (key, status, ts) holds the newest status per key of earlier batches. Rows of a key are ordered by time, of equal times by
    status; rows that are not newer than what is known come too late, or again, and are left out.
    """
    if known is not None:
        before = known.select(key, F.col("status").alias("_known"), F.col("ts").alias("_known_ts"))
        joined = batch.join(before, key, "left")
        newer = F.struct("ts", "status") > F.struct(F.col("_known_ts").alias("ts"), F.col("_known").alias("status"))
        fresh = joined.where(F.col("_known_ts").isNull() | newer).drop("_known_ts")
    else:
        fresh = batch.withColumn("_known", F.lit(None).cast("string"))
    ranked = running(
        fresh.withColumn("_us", F.unix_micros("ts")), [key], ["_us", "status"], {"_prev": ("max", F.struct("_us", "status"))},
        bucket=[F.shiftright("_us", _TIME_BITS)],
    )
    previous = F.coalesce("_prev.status", "_known")
    return (
        ranked.withColumn("previous", previous)
        .where(~F.col("status").eqNullSafe(F.col("previous")))
        .select(*batch.columns, "previous")
    )


def last_status(batch: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """(key, status, ts) of the keys whose newest status a batch moves on."""
    newest = batch.groupBy(key).agg(F.max(F.struct("ts", "status")).alias("_new")).select(key, "_new.status", "_new.ts")
    if known is None:
        return newest
    before = known.select(key, F.struct("ts", "status").alias("_old"))
    return newest.join(before, key, "left").where(F.col("_old").isNull() | (F.struct("ts", "status") > F.col("_old"))).drop("_old")


def stream_name(spark: SparkSession, given: str) -> str:
    """Who writes: the given name and the id that Spark keeps in the stream's checkpoint. A new checkpoint is a new writer."""
    return f"{given}:{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}"


def _available(trigger: dict[str, Any]) -> dict[str, Any]:
    return trigger or {"availableNow": True}


def commit_batch(
    spark: SparkSession, store: str, writer: str, batch_id: int, made: Callable[[int], Mapping[str, Changes]], before: Callable[[], None] | None = None
) -> None:
    """Commit what `made` computes from a version of the store, anew for as long as others change the same rows; once for a batch."""
    while committed_batch(spark, store, writer) < batch_id:
        version = newest_version(spark, store)
        with staging():
            changes = made(version)
            try:
                write_snapshot(spark, store, changes, writer, batch_id, base=version)
            except VersionTaken:
                continue


def _change_stream(
    changes: DataFrame, key: str, made: Callable[[SparkSession, DataFrame, int], Mapping[str, Changes]], store: str, **trigger: Any
) -> StreamingQuery:
    """Commit `made(status changes, version)` of every micro-batch, and with it the newest status per key."""
    state = f"{store}/state"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def compute(version: int) -> dict[str, Changes]:
            rows = stage(batch)
            known = rows_near(spark, state, "last", rows, version)
            changed = status_changes(rows, known, key)
            return {"last": Upsert(last_status(rows, known, key), (key,)), **made(spark, changed, version)}

        commit_batch(spark, state, stream_name(spark, "changes"), batch_id, compute)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/checkpoint")
    return writer.trigger(**_available(trigger)).start()


def change_stream(
    changes: DataFrame, key: str, emit: Callable[[DataFrame], DataFrame], store: str, **trigger: Any
) -> StreamingQuery:
    """Add `emit(status changes)` of every micro-batch to the table `out` of a store, and keep the newest status per key beside it.

    Both are committed together. Of the statuses only the buckets of the batch's keys are read, and those of keys that moved on are
    written anew.
    """
    return _change_stream(changes, key, lambda spark, changed, version: {"out": Append(emit(changed))}, store, **trigger)


def ready_notice(changed: DataFrame) -> DataFrame:
    """A task became pending: its first row, or a change from another status."""
    return changed.where("status = 'pending'").select("task_id", "session_id", "agent_id", "ts")


def done_notice(changed: DataFrame) -> DataFrame:
    """An active session completed or failed; the answer is cut to 500 characters."""
    done = F.col("status").isin("completed", "failed") & (F.col("previous") == "active")
    answer = F.left(F.coalesce("final_answer", F.lit("")), F.lit(ANSWER_CHARS))
    return changed.where(done).select("session_id", "status", "agent_id", answer.alias("final_answer"), "ts")


def task_ready(changes: DataFrame, store: str, **trigger: Any) -> StreamingQuery:
    """Notifications for tasks (task_id, session_id, agent_id, status, ts) that become ready."""
    return change_stream(changes, "task_id", ready_notice, store, **trigger)


def session_done(changes: DataFrame, store: str, **trigger: Any) -> StreamingQuery:
    """Notifications for sessions (session_id, agent_id, status, final_answer, ts) that end."""
    return change_stream(changes, "session_id", done_notice, store, **trigger)


def approval_needed(inserts: DataFrame) -> DataFrame:
    """A notification for every inserted pending approval."""
    return inserts.where("status = 'pending'").select("approval_id", "task_id", "session_id")


def event_log_stream(events: DataFrame, delay: str = "10 minutes", ts: str = "created_at") -> DataFrame:
    """Events without repeated deliveries: an id is remembered for the length of the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def throughput_stream(rows: DataFrame, ts: str, bucket: str, key: Column, delay: str = "10 minutes") -> DataFrame:
    """Counts per tumbling bucket and key, emitted when the watermark has passed the bucket; later rows are dropped."""
    counted = (
        rows.withWatermark(ts, delay)
        .groupBy(F.window(ts, bucket).alias("w"), key.alias("metric"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return counted.select(F.col("w.start").alias("time"), "metric", "value")


def heartbeat_monitor(beats: DataFrame, seconds: int = STALE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Running tasks (task_id, status, ts) that fell silent for `seconds` of event time.

    Heartbeats that follow each other closely form one session window; a window that closes is a silence, and a newer heartbeat
    before that keeps it open. A task whose last word was that it has ended is not reported.
    """
    quiet = (
        beats.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{seconds} seconds").alias("w"), "task_id")
        .agg(F.max("ts").alias("last_seen"), F.max(F.struct("ts", "status")).alias("_last"))
    )
    return quiet.where("_last.status = 'running'").select("task_id", "last_seen")


def silences(batch: DataFrame, known: DataFrame | None, seconds: int) -> DataFrame:
    """Rows (task_id, state, ts) that new heartbeats (task_id, status, ts) tell: `silent` since the last word of a running task when the next
    one comes `seconds` later or more, and `back` with that next one. What is known as silent already is not said again."""
    rows = batch.select("task_id", "status", "ts", F.lit(False).alias("silent"))
    if known is not None:
        rows = rows.unionByName(known.join(batch.select("task_id"), "task_id", "left_semi").select(*rows.columns))
    ranked = running(
        rows.withColumn("_us", F.unix_micros("ts")), ["task_id"], ["_us", "status"], {"_prev": ("max", F.struct("_us", "status", "silent"))},
        bucket=[F.shiftright("_us", _TIME_BITS)],
    )
    long = (F.col("_us") - F.col("_prev._us")) >= seconds * 1_000_000
    gaps = ranked.where((F.col("_prev.status") == "running") & (long | F.col("_prev.silent")))
    said = F.struct(F.lit("silent").alias("state"), F.timestamp_micros("_prev._us").alias("ts"))
    back = F.struct(F.lit("back").alias("state"), F.col("ts"))
    return gaps.select("task_id", F.explode(F.when(F.col("_prev.silent"), F.array(back)).otherwise(F.array(said, back))).alias("r")).select("task_id", "r.*")


def heartbeat_changes(beats: DataFrame, store: str, seconds: int = STALE_SECONDS, delay: int = 60, **trigger: Any) -> StreamingQuery:
    """Silences of running tasks while they last, and the heartbeats that end them: rows (task_id, state, ts) of the table `out` of a store.

    A task is silent once its last heartbeat lies `seconds` and `delay` before the newest one of any task. The store keeps the last
    word of running tasks only, so that a micro-batch looks through the tasks under watch and not through all there ever were. Heartbeats that
    are not newer than a task's last one change nothing.
    """
    state = f"{store}/state"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def compute(version: int) -> dict[str, Changes]:
            tables = read_snapshot(spark, state, version)
            watched, clock = tables.get("watch"), tables.get("clock")
            news = batch.select("task_id", "status", "ts").distinct()
            if watched is not None:
                last = watched.select("task_id", F.col("ts").alias("_ts"))
                news = news.join(last, "task_id", "left").where(F.col("_ts").isNull() | (F.col("ts") > F.col("_ts"))).drop("_ts")
            news = stage(news)
            newest = news.select("ts") if clock is None else news.select("ts").unionByName(clock.select("ts"))
            now = newest.agg(F.max("ts")).first()[0]
            late = F.col("ts") <= F.lit(now) - F.make_dt_interval(secs=F.lit(seconds + delay))
            ends = news.groupBy("task_id").agg(F.max(F.struct("ts", "status")).alias("_new")).select("task_id", "_new.status", "_new.ts")
            watch = ends.where("status = 'running'").select("task_id", "status", "ts", F.coalesce(late, F.lit(False)).alias("silent"))
            due = watch.where("silent")
            if watched is not None:
                overdue = watched.join(ends.select("task_id"), "task_id", "left_anti").where(~F.col("silent") & late)
                due = due.unionByName(overdue)
                watch = watch.unionByName(overdue.withColumn("silent", F.lit(True)))
            said = silences(news, watched, seconds).unionByName(due.select("task_id", F.lit("silent").alias("state"), "ts"))
            changes: dict[str, Changes] = {"out": Append(said), "clock": spark.createDataFrame([(now,)], "ts timestamp")}
            changes["watch"] = Upsert(watch, ("task_id",))
            if watched is not None:
                changes["watch"] = [changes["watch"], Delete(ends.where("status <> 'running'").select("task_id"), ("task_id",))]
            return changes

        commit_batch(spark, state, stream_name(spark, "heartbeats"), batch_id, compute)

    writer = beats.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/checkpoint")
    return writer.trigger(**_available(trigger)).start()


def progress_deltas(changed: DataFrame) -> DataFrame:
    """What the status changes of a batch add to the task counts of each session."""

    def is_in(column: str, *statuses: str) -> Column:
        return F.coalesce(F.col(column).isin(*statuses), F.lit(False)).cast("int")

    counts = {"completed_tasks": ("completed",), "running_tasks": ("running",), "failed_tasks": ("failed", "cancelled")}
    return changed.groupBy("session_id").agg(
        F.count_if(F.col("previous").isNull()).alias("total_tasks"),
        *[F.sum(is_in("status", *s) - is_in("previous", *s)).alias(c) for c, s in counts.items()],
    )


def progress_delta_stream(changes: DataFrame, store: str, **trigger: Any) -> StreamingQuery:
    """Deltas of the session counts from task changes (task_id, session_id, status, ts)."""
    return change_stream(changes, "task_id", progress_deltas, store, **trigger)


def session_progress_stream(deltas: DataFrame) -> DataFrame:
    """Current task counts per session: the sum of the deltas. As a stream use output mode update or complete."""
    return deltas.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in PROGRESS])


#: Counts of a session's tasks.
PROGRESS = ("total_tasks", "completed_tasks", "running_tasks", "failed_tasks")


def live_progress(changes: DataFrame, store: str, **trigger: Any) -> StreamingQuery:
    """Keep the task counts of every session, as the table `progress` of a store, from task changes (task_id, session_id, status, ts).

    A micro-batch adds its deltas to the counts of the sessions it names, and commits them together with the statuses they came from.
    """

    def made(spark: SparkSession, changed: DataFrame, version: int) -> dict[str, Changes]:
        deltas = stage(progress_deltas(changed))
        before = rows_near(spark, f"{store}/state", "progress", deltas, version)
        if before is not None:
            deltas = before.join(deltas, "session_id", "left_semi").unionByName(deltas)
        return {"progress": Upsert(session_progress_stream(deltas), ("session_id",))}

    return _change_stream(changes, "task_id", made, store, **trigger)


def progress(spark: SparkSession, store: str) -> DataFrame:
    """The counts that `live_progress` has written so far."""
    return read_snapshot(spark, f"{store}/state")["progress"]


def ingest_stream(
    responses: DataFrame, store: str, as_of: Callable[[int], str], checkpoint: str, name: str = "ingest", **trigger: Any
) -> StreamingQuery:
    """Ingest every micro-batch into the store: one commit of new rows and touched buckets, with the batch's `actions` and `rejects`.

    A batch this stream has committed does nothing when it is repeated. Several streams may write to one store: a batch whose ids or rows
    another writer has taken in the meantime is ingested again, on top of what that one committed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def compute(version: int) -> dict[str, Changes]:
            result = submit_results(read_snapshot(spark, store, version), batch, as_of(batch_id))
            return {**result.changes, "actions": Append(result.actions), "rejects": Append(result.rejects)}

        commit_batch(spark, store, stream_name(spark, name), batch_id, compute)

    writer = responses.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**_available(trigger)).start()


#: Tables with vectors, and their keys.
_VECTORS = {"memory": "memory_id", "tool_registry": "tool_id"}


def due_rows(spark: SparkSession, store: str, version: int, since: int | None) -> Tables:
    """The tables of a version with only those rows of `memory` and `tool_registry` that may lack a vector.

    These are the rows changed after version `since`, and those that could not be embedded then (the table `unembedded`). All rows where the
    embedding model changed since, there was no tick before, or the store can't tell what changed.
    """
    tables = read_snapshot(spark, store, version)
    if since is None:
        return tables
    before, now = manifest(spark, store, since)["tables"], manifest(spark, store, version)["tables"]
    if before.get("embedding_config") != now.get("embedding_config"):
        return tables
    failed = tables.get("unembedded")
    for table, key in _VECTORS.items():
        changed = changed_rows(spark, store, table, since, (key,), version) if table in tables else None
        if changed is None:
            continue
        if failed is not None:
            keys = failed.where(F.col("source") == table).select(F.col("row_id").cast("long").alias(key))
            again = rows_near(spark, store, table, keys, version)
            if again is not None:
                changed = changed.unionByName(again.join(keys, key, "left_semi").join(changed.select(key), key, "left_anti"))
        tables = tables.replace(**{table: stage(changed)})
    return tables


def reembed_stream(
    ticks: DataFrame, store: str, embed: EmbedFunction, as_of: Callable[[int], str], checkpoint: str, name: str = "reembed", **trigger: Any
) -> StreamingQuery:
    """Re-embed whatever is due whenever new rows arrive, and commit the rows that got a vector.

    A tick reads what changed since the tick before, and what failed then, unless the embedding model has changed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = stream_name(spark, name)

        def compute(version: int) -> dict[str, Changes]:
            due = due_rows(spark, store, version, seen_version(spark, store, writer))
            result = reembed(due, embed, as_of(batch_id))
            return {**result.changes, "unembedded": result.errors.select("source", "row_id")}

        commit_batch(spark, store, writer, batch_id, compute)

    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**_available(trigger)).start()


def drain(stream: DataFrame) -> DataFrame:
    """Run an append stream over everything there is and return what it emitted, by way of files in the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "drain"), scratch_path(spark, "drain-state")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def emitted(spark: SparkSession, store: str) -> DataFrame:
    """Everything a change stream has written so far."""
    return read_snapshot(spark, f"{store}/state")["out"]


def tables_to_store(t: Tables, spark: SparkSession, store: str) -> None:
    """The first version of a store."""
    write_snapshot(spark, store, dict(t.items()))
