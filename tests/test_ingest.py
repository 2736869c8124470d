"""Set-based ingestion against the one-at-a-time model, on random batches full of interacting responses."""

import random

import pytest
from helpers import NOW, T0, agents, bundle, rows, session, task
from sequential import World

import taskloom.functions.running as running_module
from taskloom.model import Tables
from taskloom.operators.ingest import (
    ingest_sql_tool_results,
    parse_responses,
    split_by_action,
    split_by_tool_type,
    submit_results,
)

RESPONSES = [
    '{"action":"finish","final_answer":"ok"}',
    '{"action":"finish","final_answer":"fine"}',
    '{"action":"finish"}',
    "plain words",
    "42",
    '{"action":"ponder"}',
    '{"action":"delegate","to_agent":"a2","task":"sub"}',
    '{"action":"delegate","to_agent":"a2"}',
    '{"action":"delegate","to_agent":"ghost","task":"sub"}',
    '{"action":"request_approval","reason":"may I"}',
    '{"action":"request_approval"}',
    '{"action":"call_tool"}',
    '{"action":"call_tool","tool_name":"web","args":{"q":1}}',
    '{"action":"call_tool","tool_name":"off"}',
    '{"action":"call_tool","tool_name":"db","args":{"sql":"SELECT x FROM secret"}}',
    '{"action":"call_tool","tool_name":"db","args":{"sql":"SELECT x FROM v_ok"}}',
    '{"action":"call_tool","tool_name":"db"}',
]
FINISHES = RESPONSES[:4]


def world_rows(rng, n_sessions, n_tasks):
    statuses = ["pending", "waiting", "running", "completed", "failed"]
    tasks = [
        task(i, session_id=rng.randint(1, n_sessions), agent_id=rng.randint(1, 3), status=rng.choice(statuses))
        for i in range(1, n_tasks + 1)
    ]
    deps, messages = [], []
    for i in range(2, n_tasks + 1):
        for prior in rng.sample(range(1, i), min(i - 1, rng.choice([0, 1, 1, 2]))):
            deps.append({"dependency_id": len(deps) + 1, "task_id": i, "depends_on_task_id": prior})
            if rng.random() < 0.8:
                messages.append(
                    {"message_id": len(messages) + 1, "from_agent_id": tasks[i - 1]["agent_id"],
                     "to_agent_id": tasks[prior - 1]["agent_id"], "session_id": tasks[i - 1]["session_id"],
                     "parent_task_id": i, "child_task_id": prior, "direction": "instruction", "status": "delivered",
                     "content": "do", "created_at": T0}
                )
    tool = {"description": "d", "input_schema": "{}", "created_at": T0, "updated_at": T0}
    return {
        **agents(3),
        "sessions": [session(s) for s in range(1, n_sessions + 1)],
        "tasks": tasks,
        "task_dependencies": deps,
        "agent_messages": messages,
        "tool_registry": [
            {**tool, "tool_id": 1, "name": "web", "tool_type": "http", "http_endpoint": "x", "is_active": True},
            {**tool, "tool_id": 2, "name": "db", "tool_type": "sql", "is_active": True},
            {**tool, "tool_id": 3, "name": "off", "tool_type": "sql", "is_active": False},
        ],
        "agent_tool_permissions": [
            {"agent_id": a, "tool_id": t, "granted_at": T0} for a, t in ((1, 1), (1, 2), (2, 2), (1, 3))
        ],
        "sql_sandbox_allowlist": [{"view_name": "V_OK", "description": "", "created_at": T0}],
        "execution_logs": [
            {"log_id": 1, "task_id": 1, "step_number": 4, "role": "user", "content": "x", "created_at": T0}
        ],
    }


@pytest.mark.parametrize("seed", range(6))
def test_batch_equals_sequence(spark, seed, monkeypatch):
    if seed % 3 == 0:  # many buckets
        monkeypatch.setattr(running_module, "BUCKET_BITS", 2)
    rng = random.Random(seed)
    data = world_rows(rng, n_sessions=rng.choice([2, 5]), n_tasks=rng.choice([6, 14]))
    n_tasks = len(data["tasks"])
    pool = FINISHES + RESPONSES if seed % 2 else RESPONSES
    batch = [
        (seq, rng.randint(1, n_tasks + 1), rng.choice(pool), rng.random() < 0.08) for seq in range(10, 10 + rng.choice([25, 60]))
    ]
    world = World(
        data["tasks"], data["task_dependencies"], data["agent_messages"], data["agent_meta"], data["tool_registry"],
        data["agent_tool_permissions"], data["sql_sandbox_allowlist"],
    )
    world.steps[1] = 4
    expected_actions, refused = [], []
    for seq, task_id, response, final in batch:
        action = world.submit(task_id, response, final)
        (refused if action is None else expected_actions).append((seq, task_id) if action is None else (seq, task_id, action))

    t = bundle(spark, **data)
    got = submit_results(t, spark.createDataFrame(batch, "seq long, task_id long, response string, is_final boolean"), NOW)
    assert rows(got.actions, "seq", "task_id", "action") == sorted(expected_actions)
    assert rows(got.rejects, "seq", "task_id") == sorted(refused)
    after = got.tables
    expected = sorted((x["task_id"], x["status"], x.get("output")) for x in world.tasks.values())
    assert sorted(map(tuple, after.tasks.select("task_id", "status", "output").collect())) == expected
    new_logs = after.execution_logs.where("log_id > 1")
    assert rows(new_logs, "task_id", "step_number", "role", "content") == sorted(world.logs)
    assert [r["log_id"] for r in new_logs.orderBy("log_id").collect()] == list(range(2, 2 + len(world.logs)))
    assert rows(after.task_dependencies, "task_id", "depends_on_task_id") == sorted(world.deps)
    names = ("from_agent_id", "to_agent_id", "parent_task_id", "child_task_id", "direction", "content")
    assert rows(after.agent_messages, *names) == sorted(tuple(m[n] for n in names) for m in world.messages)
    events = after.agent_events.orderBy("event_id").select("task_id", "event_type").collect()
    assert [tuple(e) for e in events] == world.events
    closed = after.sessions.where("completed_at IS NOT NULL")
    assert dict(map(tuple, closed.select("session_id", "final_answer").collect())) == world.sessions
    assert rows(after.human_approvals, "task_id", "reason") == sorted(world.approvals)
    assert rows(after.session_participants, "session_id", "agent_id") == sorted(world.participants)
    assert rows(after.tool_executions, "task_id", "tool_id", "error") == sorted(world.executions)
    touched = {x["task_id"] for x in world.tasks.values() if x.get("touched")}
    assert {r[0] for r in after.tasks.where("heartbeat_at IS NOT NULL").select("task_id").collect()} == touched


def test_hot_task_and_session(spark):
    """All responses of a large batch on one task: one linear pass, exact step numbers."""
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(1, status="running"), task(2, status="running")])
    n = 3000
    batch = spark.range(n).selectExpr(
        "id AS seq", "1L AS task_id", "CASE WHEN id % 2 = 0 THEN '{\"action\":\"ponder\"}' ELSE 'answer' END AS response",
        "false AS is_final",
    )
    got = submit_results(t, batch, NOW)
    steps = got.tables.execution_logs
    assert steps.count() == n
    assert steps.agg({"step_number": "max"}).first()[0] == n
    assert got.tables.sessions.first()["status"] == "active"  # task 2 is still live
    assert got.tables.agent_events.where("event_type = 'task_end'").count() == n // 2


def test_parse_is_strict(spark):
    texts = ['{"action":"finish"} x', "{'action':1}", '{"action":1}', "[1]", "null", '{"a":1,"a":2}', "", "NaN", '"s"']
    df = spark.createDataFrame([(i, 1, x, False) for i, x in enumerate(texts)],
                               "seq long, task_id long, response string, is_final boolean")
    got = {r["seq"]: (r["is_json"], r["action"], r["final_answer"]) for r in parse_responses(df).collect()}
    assert got[0] == (False, "finish", texts[0])
    assert got[1] == (False, "finish", texts[1])
    assert got[2] == (True, "1", None)
    for i in (3, 4, 5, 8):
        assert got[i] == (True, None, None)
    assert got[6] == (False, "finish", "") and got[7][0] is False


def test_sql_outcomes_and_routing(spark):
    rng = random.Random(1)
    data = world_rows(rng, 1, 2)
    data["tasks"] = [task(1, status="running"), task(2, status="running")]
    batch = spark.createDataFrame(
        [(1, 1, RESPONSES[15], False), (2, 1, RESPONSES[12], False), (3, 2, RESPONSES[9], False)],
        "seq long, task_id long, response string, is_final boolean",
    )
    t = bundle(spark, **data)
    first = submit_results(t, batch, NOW)
    assert rows(first.pending_sql, "seq", "task_id", "tool_id", "sql_text") == [(1, 1, 2, "SELECT x FROM v_ok")]
    assert rows(first.actions.where("awaits_sql"), "seq", "action") == [(1, "continue")]
    outcome = spark.createDataFrame([(1, "[]", None)], "seq long, output string, error string")
    second = submit_results(t, batch, NOW, outcome)
    assert second.pending_sql.isEmpty() and second.actions.where("awaits_sql").isEmpty()
    assert rows(second.tables.execution_logs.where("log_id > 1"), "step_number", "role") == [
        (1, "assistant"), (5, "assistant"), (6, "tool"), (7, "assistant")]
    late = spark.createDataFrame([(1, 1, 2, "{}", None, "boom")],
                                 "seq long, task_id long, tool_id long, input string, output string, error string")
    later = ingest_sql_tool_results(first.tables, late, NOW)
    assert later.execution_logs.where("content = 'SQL ERROR: boom'").count() == 1
    assert rows(later.tool_executions, "task_id", "tool_id", "error") == [(1, 2, "boom")]
    outputs = split_by_action(second.actions)
    assert {k: v.count() for k, v in outputs.items()} == {
        "continue": 1, "done": 0, "invoke_tool": 1, "wait_tasks": 0, "wait_approval": 1}
    routes = split_by_tool_type(second.actions)
    assert {k: v.count() for k, v in routes.items()} == {"mcp": 0, "http": 1, "custom": 0, "rejects": 2}


def test_repeated_and_missing_seq_are_rejected(spark):
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(1, status="running")])
    done = '{"action":"finish","final_answer":"ok"}'
    schema = "seq long, task_id long, response string, is_final boolean"
    got = submit_results(t, spark.createDataFrame([(7, 1, done, False), (7, 1, done, False), (None, 1, done, False)], schema), NOW)
    assert rows(got.rejects, "seq", "reason") == [(7, "repeated_seq"), (7, "repeated_seq"), (None, "no_seq")]
    assert got.actions.isEmpty() and got.tables.agent_events.isEmpty() and rows(got.tables.tasks, "status") == [("running",)]


def test_lone_surrogates_are_no_json(spark):
    texts = ['{"action":"finish","final_answer":"\\ud800"}', '"\\udc00"', '"\\ud83d\\ude00"', '"\\\\ud800"', '"\\ud83d\\ude00\\ud83d"', '"\\u00e9"', '"\\\\\\ud800"']
    df = spark.createDataFrame([(i, 1, x, False) for i, x in enumerate(texts)], "seq long, task_id long, response string, is_final boolean")
    assert {r["seq"]: r["is_json"] for r in parse_responses(df).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_known_last_ids_spare_the_scan(spark):
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(1, status="running")])
    t = Tables(dict(t.items()), {"execution_logs": 40, "agent_events": 50})
    batch = spark.createDataFrame([(1, 1, "done", False)], "seq long, task_id long, response string, is_final boolean")
    after = submit_results(t, batch, NOW).tables
    assert rows(after.execution_logs, "log_id") == [(41,)] and rows(after.agent_events, "event_id") == [(51,), (52,)]
