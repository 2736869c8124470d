"""Snapshots, deltas and streams over several files and micro-batches."""

from datetime import datetime, timedelta

import pytest
from helpers import NOW, T0, agents, bundle, frame, rows, session, task
from pyspark.sql import functions as F

from taskloom.operators.delta import Append, Delete, DeleteBefore, Upsert, apply_delta, assign_ids, patch
from taskloom.session import scratch_path
from taskloom.sources.store import bucket_number, grown
from taskloom.sources.tables import (
    VersionTaken,
    changed_rows,
    committed_batch,
    compact,
    load_tables,
    manifest,
    read_snapshot,
    vacuum,
    write_snapshot,
)
from taskloom.streaming import streams

LOG = {"log_id": 7, "task_id": 1, "step_number": 1, "role": "user", "content": "c", "created_at": T0}
CHANGES = "task_id long, session_id long, agent_id long, status string, ts timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def files(spark, batches, schema):
    """One Parquet file per batch, read as a stream one file at a time, in order."""
    path = scratch_path(spark, "input")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_delta_modes(spark):
    base = frame(spark, "tasks", [task(1), task(2)])
    delta = frame(spark, "tasks", [task(2, status="failed"), task(3)])
    assert rows(apply_delta(base, delta, ["task_id"]), "task_id", "status") == [(1, "pending"), (2, "failed"), (3, "pending")]
    assert rows(apply_delta(base, delta, ["task_id"], "ignore"), "task_id", "status") == [(1, "pending"), (2, "pending"), (3, "pending")]
    assert rows(apply_delta(base, delta, ["task_id"], "delete"), "task_id") == [(1,)]
    with pytest.raises(ValueError):
        apply_delta(base, delta, ["task_id"], "merge")
    patched = patch(base, spark.createDataFrame([(2, None)], "task_id long, input string"), "task_id", touch=NOW)
    assert rows(patched, "task_id", "input", "updated_at") == [(1, "in 1", T0), (2, None, datetime(2024, 5, 1, 12))]
    empty = frame(spark, "tasks", [])
    assert rows(assign_ids(delta.drop("task_id").withColumn("seq", F.unix_micros("created_at") + F.col("retry_count")).limit(1),
                           empty, "task_id", "seq"), "task_id") == [(1,)]


def test_store_appends_upserts_and_replaces(spark):
    store = scratch_path(spark, "store")
    assert manifest(spark, store)["version"] == -1 and read_snapshot(spark, store).get("tasks") is None
    t = bundle(spark, **agents(1), tasks=[task(i) for i in range(1, 60)], execution_logs=[LOG])
    assert write_snapshot(spark, store, {"tasks": t.tasks, "agent_meta": t.agent_meta, "execution_logs": t.execution_logs}) == 0
    before = manifest(spark, store)
    changed = frame(spark, "tasks", [task(2, status="failed"), task(99)])
    more = frame(spark, "execution_logs", [{**LOG, "log_id": 8}])
    assert write_snapshot(spark, store, {"tasks": Upsert(changed, ("task_id",)), "execution_logs": Append(more)}) == 1
    after, state = read_snapshot(spark, store), manifest(spark, store)
    assert after.tasks.count() == 60 and rows(after.tasks.where("status = 'failed'"), "task_id") == [(2,)]
    assert rows(after.execution_logs, "log_id") == [(7,), (8,)] and after.agent_meta.count() == 1
    assert after.last_ids["tasks"] == 99 and after.last_ids["execution_logs"] == 8
    assert after.replace(tasks=t.tasks).last_ids.get("tasks") is None
    # Logs are only added to.
    assert state["tables"]["execution_logs"]["parts"][:1] == before["tables"]["execution_logs"]["parts"]
    assert write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(5)])}) == 2
    assert rows(read_snapshot(spark, store).tasks, "task_id") == [(5,)] and read_snapshot(spark, store).last_ids["tasks"] == 5
    t.tasks.write.parquet(f"{store}/plain/tasks")
    assert load_tables(spark, f"{store}/plain").tasks.schema == t.tasks.schema


def test_compaction_and_vacuum(spark):
    store = scratch_path(spark, "store")
    write_snapshot(spark, store, {"execution_logs": frame(spark, "execution_logs", [LOG])})
    for i in range(3):
        write_snapshot(spark, store, {"execution_logs": Append(frame(spark, "execution_logs", [{**LOG, "log_id": 20 + i}]))})
    assert len(manifest(spark, store)["tables"]["execution_logs"]["parts"]) == 4
    compact(spark, store, "execution_logs")
    assert len(manifest(spark, store)["tables"]["execution_logs"]["parts"]) == 1
    assert vacuum(spark, store) == 0 and vacuum(spark, store, keep=1) == 0  # kept versions, then young folders, stay
    assert rows(read_snapshot(spark, store).execution_logs, "log_id") == [(7,), (20,), (21,), (22,)]


def test_streams_know_their_own_batches_only(spark):
    store = scratch_path(spark, "store")
    one = frame(spark, "tasks", [task(1)])
    for _ in range(4):
        write_snapshot(spark, store, {"tasks": one})
    assert write_snapshot(spark, store, {"tasks": one}, "a", 0) == 4
    assert write_snapshot(spark, store, {"tasks": one}, "a", 0) is None
    assert write_snapshot(spark, store, {"tasks": one}, "b", 0) == 5
    assert committed_batch(spark, store, "a") == 0 and committed_batch(spark, store, "c") == -1


def log(i):
    return {**LOG, "log_id": i}


def logs(spark, *ids):
    return Append(frame(spark, "execution_logs", [log(i) for i in ids]))


def test_refused_commit_leaves_the_others_rows(spark):
    """Two writers of one version: what the first has committed stays, and nothing of the refused one comes in."""
    store = scratch_path(spark, "store")
    write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(1)])})
    base = manifest(spark, store)["version"]
    write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(2)])}, base=base)
    with pytest.raises(VersionTaken):
        write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(3)])}, base=base)
    assert rows(read_snapshot(spark, store).tasks, "task_id") == [(2,)]


def test_appends_of_two_writers_both_stay(spark):
    store = scratch_path(spark, "store")
    write_snapshot(spark, store, {"notes": spark.createDataFrame([(1,)], "x long"), "execution_logs": frame(spark, "execution_logs", [LOG])})
    base = manifest(spark, store)["version"]
    write_snapshot(spark, store, {"notes": Append(spark.createDataFrame([(100,)], "x long"))}, base=base)
    write_snapshot(spark, store, {"notes": Append(spark.createDataFrame([(200,)], "x long"))}, base=base)
    assert rows(read_snapshot(spark, store)["notes"]) == [(1,), (100,), (200,)]
    # Ids that both gave out are not: the second has to number its rows again.
    write_snapshot(spark, store, {"execution_logs": logs(spark, 8, 9)}, base=base)
    with pytest.raises(VersionTaken):
        write_snapshot(spark, store, {"execution_logs": logs(spark, 8)}, base=base)
    with pytest.raises(VersionTaken):
        write_snapshot(spark, store, {"execution_logs": logs(spark, 9, 10)}, base=base)
    assert rows(read_snapshot(spark, store).execution_logs, "log_id") == [(7,), (8,), (9,)]


def test_upserts_of_other_buckets_both_stay(spark):
    store = scratch_path(spark, "store")
    write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(i) for i in range(1, 400)])}, bucket_rows=10)
    state = manifest(spark, store)
    entry = state["tables"]["tasks"]
    grid = tuple(entry["grid"])
    of = {r["task_id"]: bucket_number(r["h"] % (1 << 40), grid) for r in spark.range(1, 400).selectExpr("id AS task_id", "xxhash64(id) AS h").collect()}
    one, same, other = 1, next(i for i in of if i > 1 and of[i] == of[1]), next(i for i in of if of[i] != of[1])

    def failing(*ids):
        return {"tasks": Upsert(frame(spark, "tasks", [task(i, status="failed") for i in ids]), ("task_id",))}

    write_snapshot(spark, store, failing(one), base=0, bucket_rows=1000)
    write_snapshot(spark, store, failing(other), base=0, bucket_rows=1000)
    with pytest.raises(VersionTaken):
        write_snapshot(spark, store, failing(same), base=0, bucket_rows=1000)
    after = read_snapshot(spark, store).tasks
    assert after.count() == 399 and rows(after.where("status = 'failed'"), "task_id") == sorted([(one,), (other,)])


def test_few_keys_touch_few_buckets(spark):
    store = scratch_path(spark, "store")
    schema = "task_id long, status string, ts timestamp"
    many = spark.range(100_000).selectExpr("id AS task_id", "'running' AS status", "timestamp_seconds(id) AS ts")
    write_snapshot(spark, store, {"last": Upsert(many, ("task_id",))}, bucket_rows=100)
    before = manifest(spark, store)["tables"]["last"]
    assert len(before["cells"]) == 1000 and sum(c["rows"] for c in before["cells"].values()) == 100_000
    some = spark.createDataFrame([(i * 797, "failed", T0) for i in range(125)], schema)
    write_snapshot(spark, store, {"last": Upsert(some, ("task_id",))}, bucket_rows=100)
    after = manifest(spark, store)["tables"]["last"]
    anew = [b for b, c in after["cells"].items() if before["cells"].get(b) != c]
    assert len(anew) <= 125 + 2 * 2  # two buckets are split, each in two
    assert sum(c["rows"] for c in after["cells"].values()) == 100_000
    assert read_snapshot(spark, store)["last"].where("status = 'failed'").count() == 125


def test_buckets_split_as_the_table_grows(spark):
    store = scratch_path(spark, "store")
    total = 0
    for step in range(6):
        n = 40 * (step + 1)
        rows_ = spark.range(total, total + n).selectExpr("id AS k", f"{step} AS step")
        write_snapshot(spark, store, {"counts": Upsert(rows_, ("k",))}, bucket_rows=16)
        total += n
        entry = manifest(spark, store)["tables"]["counts"]
        assert (1 << entry["grid"][0]) + entry["grid"][1] == -(-total // 16)
        assert sum(c["rows"] for c in entry["cells"].values()) == total and max(c["rows"] for c in entry["cells"].values()) < 4 * 16
    got = read_snapshot(spark, store)["counts"]
    assert got.count() == got.select("k").distinct().count() == total


@pytest.mark.parametrize("old, new", [(1, 2), (3, 4), (5, 9), (7, 64), (16, 17)])
def test_a_new_bucket_takes_its_rows_from_one_old_one(old, new):
    before, after = grown((0, 0), old, 1), grown(grown((0, 0), old, 1), new, 1)
    assert (1 << after[0]) + after[1] == new and grown(after, 1, 1) == after
    for hashed in range(3000):
        was, now = bucket_number(hashed, before), bucket_number(hashed, after)
        assert now == was or (now >= old and bucket_number(now, before) == was)


def test_deletes_reach_the_files_concerned(spark):
    store = scratch_path(spark, "store")

    def events(*minutes):
        return frame(spark, "agent_events", [{"event_id": m, "event_type": "task_end", "created_at": at(m)} for m in minutes])

    write_snapshot(spark, store, {"agent_events": events(1, 2, 3)})
    write_snapshot(spark, store, {"agent_events": Append(events(4, 5, 6))})
    write_snapshot(spark, store, {"agent_events": Append(events(7, 8))})
    old, cut, new = [p["path"] for p in manifest(spark, store)["tables"]["agent_events"]["parts"]]
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{old}"), True)
    write_snapshot(spark, store, {"agent_events": DeleteBefore("created_at", at(5))})  # the old part can't be read any more, and isn't
    left = [p["path"] for p in manifest(spark, store)["tables"]["agent_events"]["parts"]]
    assert new in left and old not in left and cut not in left and len(left) == 2
    assert rows(read_snapshot(spark, store).agent_events, "event_id") == [(5,), (6,), (7,), (8,)]
    write_snapshot(spark, store, {"agent_events": Delete(spark.createDataFrame([(8,), (99,)], "event_id long"), ("event_id",))})
    kept = [p["path"] for p in manifest(spark, store)["tables"]["agent_events"]["parts"]]
    assert new not in kept and len(set(kept) & set(left)) == 1
    assert rows(read_snapshot(spark, store).agent_events, "event_id") == [(5,), (6,), (7,)]


def test_several_changes_of_one_table(spark):
    store = scratch_path(spark, "store")
    write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(i) for i in range(1, 20)]), "execution_logs": frame(spark, "execution_logs", [log(1), log(2), log(3)])})
    gone = spark.createDataFrame([(3,), (4,)], "task_id long")
    changed = frame(spark, "tasks", [task(4, status="failed"), task(30)])
    edits = [Delete(spark.createDataFrame([(1,)], "log_id long"), ("log_id",)), Upsert(frame(spark, "execution_logs", [{**log(2), "content": "new"}, log(9)]), ("log_id",))]
    write_snapshot(spark, store, {"tasks": [Delete(gone, ("task_id",)), Upsert(changed, ("task_id",))], "execution_logs": edits})
    after = read_snapshot(spark, store)
    assert rows(after.tasks, "task_id") == [(i,) for i in [1, 2, *range(4, 20), 30]] and rows(after.tasks.where("status = 'failed'"), "task_id") == [(4,)]
    assert rows(after.execution_logs, "log_id", "content") == [(2, "new"), (3, "c"), (9, "c")] and after.last_ids["execution_logs"] == 9
    write_snapshot(spark, store, {"tasks": DeleteBefore("created_at", at(1))})
    assert read_snapshot(spark, store).tasks.isEmpty()


def test_feed_of_changed_rows(spark):
    store = scratch_path(spark, "store")
    write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(i) for i in range(1, 9)])})
    write_snapshot(spark, store, {"tasks": Upsert(frame(spark, "tasks", [task(2, status="running"), task(10), task(11)]), ("task_id",))})
    write_snapshot(spark, store, {"tasks": [Upsert(frame(spark, "tasks", [task(2, status="failed")]), ("task_id",)), Delete(spark.createDataFrame([(10,), (5,)], "task_id long"), ("task_id",))]})

    def feed(since):
        found = changed_rows(spark, store, "tasks", since, ("task_id",))
        return None if found is None else rows(found, "task_id", "status")

    assert feed(2) == [] and feed(1) == [(2, "failed")] and feed(0) == [(2, "failed"), (11, "pending")] and feed(-1) is None
    write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(1)])})
    assert feed(2) is None  # written anew: everything may have changed


def test_vacuum_spares_versions_and_writers(spark):
    store = scratch_path(spark, "store")
    for i in range(4):
        write_snapshot(spark, store, {"tasks": frame(spark, "tasks", [task(i)])})
    assert vacuum(spark, store, keep=2) == 0  # too young
    assert vacuum(spark, store, keep=2, age_seconds=-5) == 2
    assert rows(read_snapshot(spark, store, 2).tasks, "task_id") == [(2,)] and rows(read_snapshot(spark, store).tasks, "task_id") == [(3,)]


def test_ready_and_progress_over_batches(spark):
    batches = [
        [(1, 1, 1, "pending", at(0)), (2, 1, 1, "running", at(0)), (1, 1, 1, "running", at(1))],
        [(1, 1, 1, "pending", at(2)), (2, 1, 1, "pending", at(2))],
        [(1, 1, 1, "pending", at(3)), (2, 1, 1, "completed", at(4)), (3, 2, 1, "pending", at(4))],
    ]
    store = scratch_path(spark, "ready")
    streams.task_ready(files(spark, batches, CHANGES), store).awaitTermination()
    assert rows(streams.emitted(spark, store), "task_id", "ts") == [(1, at(0)), (1, at(2)), (2, at(2)), (3, at(4))]
    store = scratch_path(spark, "progress")
    streams.progress_delta_stream(files(spark, batches, CHANGES), store).awaitTermination()
    counts = streams.session_progress_stream(streams.emitted(spark, store))
    kept = scratch_path(spark, "kept")
    streams.live_progress(files(spark, batches, CHANGES), kept).awaitTermination()
    names = ("session_id", "total_tasks", "completed_tasks", "running_tasks", "failed_tasks")
    assert rows(counts, *names) == [(1, 2, 1, 0, 0), (2, 1, 0, 0, 0)] == rows(streams.progress(spark, kept), *names)
    live = spark.readStream.schema("session_id long, total_tasks long, completed_tasks long, running_tasks long, failed_tasks long")
    totals = streams.session_progress_stream(live.parquet(f"{store}/state/out/*"))
    query = totals.writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("progress"), *names) == rows(counts, *names)


def test_session_done_and_approvals(spark):
    schema = "session_id long, agent_id long, status string, final_answer string, ts timestamp"
    batches = [[(1, 1, "active", None, at(0)), (2, 1, "completed", "x", at(0))], [(1, 1, "failed", "y" * 600, at(1))]]
    store = scratch_path(spark, "done")
    streams.session_done(files(spark, batches, schema), store).awaitTermination()
    got = streams.emitted(spark, store).collect()
    assert [(r["session_id"], r["status"], len(r["final_answer"])) for r in got] == [(1, "failed", 500)]
    schema = "approval_id long, task_id long, session_id long, status string"
    needed = streams.drain(streams.approval_needed(files(spark, [[(1, 1, 1, "pending"), (2, 1, 1, "approved")]], schema)))
    assert rows(needed) == [(1, 1, 1)]


def test_late_rows_and_repeats(spark):
    schema = "event_id long, event_type string, created_at timestamp"
    batches = [[(1, "a", at(0)), (2, "a", at(1)), (1, "a", at(0))], [(3, "b", at(60)), (2, "a", at(1))], [(7, "b", at(61))],
               [(4, "a", at(0)), (5, "b", at(120))], [(6, "c", at(200))]]
    unique = streams.drain(streams.event_log_stream(files(spark, batches[:2], schema), "2 hours"))
    assert rows(unique, "event_id") == [(1,), (2,), (3,)]
    counts = streams.drain(streams.throughput_stream(files(spark, batches, schema), "created_at", "1 minute", F.col("event_type")))
    # Row 4 arrives after the watermark has passed its minute and is not counted.
    assert rows(counts, "metric", "value", "time") == [
        ("a", 2, at(0)), ("a", 2, at(1)), ("b", 1, at(60)), ("b", 1, at(61)), ("b", 1, at(120))]


def test_heartbeats(spark):
    schema = "task_id long, status string, ts timestamp"
    batches = [
        [(1, "running", at(0)), (2, "running", at(0)), (3, "running", at(0))],
        [(2, "running", at(3)), (3, "completed", at(4))],
        [(2, "running", at(7)), (9, "running", at(12))],
        [(9, "running", at(30))],
    ]
    silent = streams.drain(streams.heartbeat_monitor(files(spark, batches, schema)))
    assert rows(silent) == [(1, at(0)), (2, at(7)), (9, at(12))]


def test_silences_and_their_ends_over_batches(spark):
    schema = "task_id long, status string, ts timestamp"
    batches = [
        [(1, "running", at(0)), (2, "running", at(0)), (3, "running", at(0)), (5, "running", at(0)), (5, "running", at(5))],
        [(2, "running", at(3)), (3, "completed", at(4)), (5, "running", at(6))],
        [(9, "running", at(12))],  # 1, 2 and 5 have been silent for six minutes or more
        [(1, "running", at(13)), (2, "running", at(2)), (3, "running", at(13)), (9, "running", at(14))],  # 1 is back; the beat of 2 is old
        [(9, "completed", at(30))],
    ]
    store = scratch_path(spark, "beats")
    streams.heartbeat_changes(files(spark, batches, schema), store).awaitTermination()
    assert rows(streams.emitted(spark, store), "task_id", "state", "ts") == sorted([
        (5, "silent", at(0)), (5, "back", at(5)),
        (1, "silent", at(0)), (2, "silent", at(3)), (5, "silent", at(6)),
        (1, "back", at(13)),
        (1, "silent", at(13)), (3, "silent", at(13)), (9, "silent", at(14)), (9, "back", at(30)),
    ])
    assert rows(read_snapshot(spark, f"{store}/state")["watch"], "task_id", "silent") == [(1, True), (2, True), (3, True), (5, True)]


def test_late_statuses_change_nothing(spark):
    batches = [[(1, 1, 1, "running", at(5))], [(1, 1, 1, "pending", at(2)), (1, 1, 1, "running", at(5))], [(1, 1, 1, "pending", at(6))]]
    store = scratch_path(spark, "late")
    streams.task_ready(files(spark, batches, CHANGES), store).awaitTermination()
    assert rows(streams.emitted(spark, store), "task_id", "ts") == [(1, at(6))]


RESPONSE = "seq long, task_id long, response string, is_final boolean"


def test_ingest_stream(spark):
    t = bundle(spark, **agents(2), sessions=[session(1)], tasks=[task(1, status="running")])
    batches = [[(1, 1, '{"action":"delegate","to_agent":"a2","task":"sub"}', False)], [(2, 2, "result", False), (9, 77, "x", False)],
               [(3, 1, '{"action":"finish","final_answer":"all done"}', False)]]
    store = scratch_path(spark, "live")
    streams.tables_to_store(t, spark, store)
    for _ in range(3):  # other writers' versions have no bearing on the stream's batches
        write_snapshot(spark, store, {"agent_meta": t.agent_meta})
    source = files(spark, batches, RESPONSE)
    streams.ingest_stream(source, store, lambda batch: NOW, f"{store}-state").awaitTermination()
    after = read_snapshot(spark, store)
    assert rows(after.tasks, "task_id", "status", "output") == [(1, "completed", "all done"), (2, "completed", "result")]
    assert rows(after.sessions, "status", "final_answer") == [("completed", "all done")]
    assert rows(after["actions"], "seq", "action") == [(1, "wait_tasks"), (2, "done"), (3, "done")]
    assert rows(after["rejects"], "seq", "reason") == [(9, "unknown_task")]
    assert rows(after.execution_logs, "log_id") == [(1,), (2,), (3,)]
    # The same checkpoint again: every batch is committed, nothing changes.
    version = manifest(spark, store)["version"]
    streams.ingest_stream(source, store, lambda batch: NOW, f"{store}-state").awaitTermination()
    assert manifest(spark, store)["version"] == version


def test_batch_leaves_written_logs_where_they_are(spark):
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(i, status="running") for i in range(1, 12)], execution_logs=[LOG])
    store = scratch_path(spark, "live")
    streams.tables_to_store(t, spark, store)
    first = manifest(spark, store)["tables"]["execution_logs"]["parts"]
    batch = [(i, i, '{"action":"ponder"}', False) for i in range(1, 11)]
    streams.ingest_stream(files(spark, [batch], RESPONSE), store, lambda batch: NOW, f"{store}-state").awaitTermination()
    parts = manifest(spark, store)["tables"]["execution_logs"]["parts"]
    assert parts[: len(first)] == first and len(parts) == len(first) + 1
    assert spark.read.parquet(f"{store}/{parts[-1]['path']}").count() == 10


def test_reembed_stream(spark):
    config = [{"config_id": 1, "model_name": "m", "dimensions": 1, "endpoint": "", "is_active": True, "activated_at": T0}]
    memory = [{"memory_id": 1, "agent_id": 1, "content": "abc", "created_at": T0}]
    t = bundle(spark, **agents(1), embedding_config=config, memory=memory)
    store = scratch_path(spark, "vectors")
    streams.tables_to_store(t, spark, store)
    ticks = files(spark, [[(1,)]], "memory_id long")
    streams.reembed_stream(ticks, store, lambda texts: [[float(len(x))] for x in texts], lambda b: NOW, f"{store}-state").awaitTermination()
    assert rows(read_snapshot(spark, store).memory, "embedding", "embedding_dims") == [([3.0], 1)]


def test_reembed_reads_what_changed(spark, monkeypatch):
    config = [{"config_id": 1, "model_name": "m", "dimensions": 1, "endpoint": "", "is_active": True, "activated_at": T0}]

    def memory(i, content):
        return {"memory_id": i, "agent_id": 1, "content": content, "created_at": T0}

    t = bundle(spark, **agents(1), embedding_config=config, memory=[memory(1, "abc"), memory(2, "bad")])
    store = scratch_path(spark, "vectors")
    streams.tables_to_store(t, spark, store)
    asked = []
    plain = streams.reembed

    def watched(due, embed, as_of):
        asked.append(rows(due.memory, "memory_id"))
        return plain(due, embed, as_of)

    monkeypatch.setattr(streams, "reembed", watched)

    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [[float(len(x))] for x in texts]

    path = scratch_path(spark, "ticks")

    def tick(n):
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema("n long").parquet(path)
        streams.reembed_stream(source, store, embed, lambda b: NOW, f"{store}-state").awaitTermination()

    tick(1)
    write_snapshot(spark, store, {"memory": Upsert(frame(spark, "memory", [memory(3, "four")]), ("memory_id",))})
    tick(2)
    tick(3)
    # All rows first; then the new one, what the tick before wrote, and what failed.
    assert asked[0] == [(1,), (2,)] and (3,) in asked[1] and (2,) in asked[1]
    assert rows(read_snapshot(spark, store).memory, "memory_id", "embedding") == [(1, [3.0]), (2, None), (3, [4.0])]
    assert rows(read_snapshot(spark, store)["unembedded"], "source", "row_id") == [("memory", "2")]


def test_two_ingest_streams_on_one_store(spark):
    """Both finish, whoever commits first: the other one's batch is ingested again on top."""
    t = bundle(spark, **agents(2), sessions=[session(1)], tasks=[task(i, status="running") for i in range(1, 7)])
    store = scratch_path(spark, "live")
    streams.tables_to_store(t, spark, store)
    running = []
    for name, own in (("left", (1, 2, 3)), ("right", (4, 5, 6))):
        batches = [[(i, i, f'{{"action":"finish","final_answer":"a{i}"}}', False)] for i in own]
        running.append(streams.ingest_stream(files(spark, batches, RESPONSE), store, lambda batch: NOW, f"{store}-{name}", name))
    for query in running:
        query.awaitTermination()
    after = read_snapshot(spark, store)
    assert rows(after.tasks, "task_id", "status", "output") == [(i, "completed", f"a{i}") for i in range(1, 7)]
    ids = [r[0] for r in rows(after.execution_logs, "log_id")]
    assert ids == list(range(1, len(ids) + 1))
    assert rows(after["actions"], "seq") == [(i,) for i in range(1, 7)]
