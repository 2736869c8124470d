"""Decisions against a plain per-task model."""

import random

from helpers import NOW, T0, agents, bundle, rows, session, task

from taskloom.operators.decide import next_actions, tool_catalogue

TERMINAL = {"completed", "failed", "cancelled"}


def expected_decision(task_row, steps, limit, live_deps):
    if task_row["status"] in TERMINAL:
        return "done", task_row.get("output"), False, None
    if task_row["status"] == "waiting":
        return "wait_tasks", None, False, live_deps
    if limit is not None and steps >= limit:
        return "done", None, True, None
    return "call_llm", None, False, None


def test_decisions_equal_model(spark):
    rng = random.Random(5)
    statuses = ["pending", "waiting", "running", "completed", "failed", "cancelled"]
    data = agents(3, max_steps=2)
    data["agent_profile_assignments"] = data["agent_profile_assignments"][:2]  # agent 3 has no limit
    tasks = [task(i, agent_id=1 + i % 3, status=rng.choice(statuses), output=f"o{i}" if i % 2 else None) for i in range(1, 31)]
    deps = [{"dependency_id": i, "task_id": i, "depends_on_task_id": d} for i in range(2, 31) for d in {rng.randint(1, i - 1)}]
    logs = [
        {"log_id": i, "task_id": rng.randint(1, 30), "step_number": i, "role": rng.choice(["assistant", "tool"]),
         "content": "c", "created_at": T0}
        for i in range(1, 60)
    ]
    t = bundle(spark, **data, sessions=[session(1)], tasks=tasks, task_dependencies=deps, execution_logs=logs)
    asked = spark.createDataFrame([(i,) for i in range(1, 33)], "task_id long")
    got = next_actions(t, asked, NOW)
    assert rows(got.rejects) == [(31, "unknown_task"), (32, "unknown_task")]
    status = {x["task_id"]: x["status"] for x in tasks}
    expected, forced, started, states = [], [], [], []
    for x in tasks:
        steps = sum(1 for e in logs if e["task_id"] == x["task_id"] and e["role"] == "assistant")
        live = sum(1 for d in deps if d["task_id"] == x["task_id"] and status[d["depends_on_task_id"]] not in TERMINAL)
        decision = expected_decision(x, steps, 2 if x["agent_id"] != 3 else None, live)
        expected.append((x["task_id"], *decision))
        if decision[2]:
            forced.append(x["task_id"])
        elif decision[0] == "call_llm" and steps == 0:
            started.append(x["task_id"])
        new = "completed" if decision[2] else "running" if decision[0] == "call_llm" else x["status"]
        states.append((x["task_id"], new))
    assert forced and started
    assert sorted(rows(got.decisions, "task_id", "action", "output", "forced", "pending_count")) == sorted(
        expected, key=lambda r: r[0]
    )
    assert rows(got.tables.tasks, "task_id", "status") == states
    events = [(i, "task_end") for i in forced] + [(i, "task_start") for i in started]
    assert rows(got.tables.agent_events, "task_id", "event_type") == sorted(events)
    texts = got.tables.execution_logs.where("content = 'Max steps (2) reached.'")
    assert [r[0] for r in rows(texts, "task_id")] == sorted(forced)
    assert got.tables.sessions.first()["status"] == "active"  # a forced end closes nothing


def test_waiting_for_approval_lists_nothing(spark):
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(1, status="waiting")])
    got = next_actions(t, t.tasks.select("task_id"), NOW)
    assert rows(got.decisions, "action", "pending_count") == [("wait_tasks", 0)]
    assert got.pending.isEmpty()


def test_start_repeats_until_a_step_exists(spark):
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(1)])
    once = next_actions(t, t.tasks.select("task_id"), NOW).tables
    twice = next_actions(once, t.tasks.select("task_id"), NOW).tables
    assert twice.agent_events.where("event_type = 'task_start'").count() == 2


def test_catalogue_skips_inactive_tools(spark):
    tool = {"description": "d", "input_schema": "{}", "tool_type": "sql", "created_at": T0, "updated_at": T0}
    t = bundle(
        spark, **agents(1),
        tool_registry=[{**tool, "tool_id": 1, "name": "a", "is_active": True}, {**tool, "tool_id": 2, "name": "b", "is_active": False}],
        agent_tool_permissions=[{"agent_id": 1, "tool_id": i, "granted_at": T0} for i in (1, 2)],
    )
    assert rows(tool_catalogue(t), "agent_id", "name") == [(1, "a")]
