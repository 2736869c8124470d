"""Enqueueing, approvals, recovery and scope."""

from datetime import timedelta

import pytest
from helpers import NOW, T0, agents, bundle, rows, session, task

from taskloom.model import OPERATOR, Principal
from taskloom.operators import views
from taskloom.operators.ingest import submit_results
from taskloom.operators.lifecycle import enqueue, latest_tasks, message_trace, recover_stale, resolve_approvals, task_graph
from taskloom.operators.quality import validate_tables
from taskloom.session import settle

REQUEST = "request_id long, agent_role string, task string, session_id long"
RESPONSE = "seq long, task_id long, response string, is_final boolean"
DECISION = "approval_id long, status string, note string"


def test_enqueue(spark):
    t = bundle(spark, **agents(2), sessions=[session(7, agent_id=2)])
    asked = [(1, "a1", " go ", None), (2, "a2", "go", 7), (3, "a1", "go", 7), (4, "nobody", "go", None), (5, "a1", " ", None)]
    got = enqueue(t, spark.createDataFrame(asked, REQUEST), OPERATOR, NOW)
    assert rows(got.accepted) == [(1, 1, 8, 1), (2, 2, 7, 2)]
    assert rows(got.rejects) == [(3, "session_of_other_agent"), (4, "agent_not_found"), (5, "task_required")]
    assert rows(got.tables.sessions, "session_id", "goal") == [(7, "g7"), (8, "go")]
    assert rows(got.tables.session_participants, "session_id", "agent_id") == [(8, 1)]
    assert rows(got.tables.agent_events, "session_id", "event_type", "payload") == [(8, "session_start", '{"goal":"go"}')]
    own = enqueue(t, spark.createDataFrame(asked[:2], REQUEST), Principal("a1"), NOW)
    assert rows(own.rejects) == [(2, "permission_denied")]


def test_approvals(spark):
    asked = [
        {"approval_id": i, "task_id": x, "session_id": 1, "requested_by_agent_id": 1, "reason": "r", "status": "pending",
         "created_at": T0}
        for i, x in enumerate([1, 2, 3, 3, 4], start=1)
    ]
    tasks = [task(1, status="waiting"), task(2, status="completed"), task(3, status="waiting"), task(4, status="running")]
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=tasks, human_approvals=asked)
    decided = [(1, "approved", None), (2, "rejected", "no"), (3, "rejected", None), (4, "approved", "yes"), (5, "approved", None),
               (6, "approved", None), (7, "maybe", None)]
    got = resolve_approvals(t, spark.createDataFrame(decided, DECISION), OPERATOR, NOW)
    assert rows(got.rejects) == [(6, "not_pending"), (7, "bad_status")]
    assert rows(got.tables.tasks, "task_id", "status", "output") == [
        (1, "pending", None), (2, "failed", "no"), (3, "failed", "Rejected by human reviewer"), (4, "running", None)]
    assert got.tables.agent_events.count() == 5
    with pytest.raises(PermissionError):
        resolve_approvals(t, spark.createDataFrame(decided, DECISION), Principal("a1"), NOW)


def test_recovery_boundaries(spark):
    old = T0 - timedelta(hours=1)
    data = agents(2, max_retries=1)
    data["agent_profile_assignments"] = data["agent_profile_assignments"][:1]
    tasks = [
        task(1, status="running", heartbeat_at=old, retry_count=0),  # one retry left: exactly the limit
        task(2, status="running", heartbeat_at=old, retry_count=1),  # used up
        task(3, status="running", agent_id=2, heartbeat_at=old, retry_count=9),  # no profile: no limit
        task(4, status="running", heartbeat_at=T0 + timedelta(minutes=59)),  # alive
        task(5, status="pending", updated_at=old),
        task(6, status="running", updated_at=T0 + timedelta(minutes=55)),  # exactly 300 s: not stale yet
    ]
    t = bundle(spark, **data, sessions=[session(1)], tasks=tasks)
    got = recover_stale(t, OPERATOR, NOW)
    assert rows(got.tables.tasks, "task_id", "status", "retry_count") == [
        (1, "pending", 1), (2, "failed", 2), (3, "pending", 10), (4, "running", 0), (5, "pending", 0), (6, "running", 0)]
    assert got.tables.tasks.where("task_id = 1").first()["heartbeat_at"] == old
    assert rows(views.stale_tasks(t, NOW), "task_id", "stale_seconds") == [(1, 7200), (2, 7200), (3, 7200)]


def test_scope_and_readiness(spark):
    deps = [{"dependency_id": 1, "task_id": 2, "depends_on_task_id": 1}, {"dependency_id": 2, "task_id": 4, "depends_on_task_id": 3}]
    tasks = [task(1, status="failed"), task(2), task(3, status="completed"), task(4, agent_id=2)]
    members = [{"session_id": 1, "agent_id": 2, "joined_at": T0}]
    t = bundle(spark, **agents(2), sessions=[session(1), session(2)], tasks=tasks, task_dependencies=deps, session_participants=members)
    worker = Principal("w", is_worker=True)
    assert rows(views.ready_tasks(t, worker), "task_id") == [(4,)]  # a failed prerequisite never makes a task ready
    assert rows(views.ready_tasks(t, Principal("a1")), "task_id") == []
    assert rows(views.my_tasks(t, Principal("a2")), "task_id") == [(4,)]
    assert rows(views.my_tasks(t, worker), "task_id") == []
    assert rows(views.session_progress(t, Principal("a2")), "session_id", "total_tasks", "failed_tasks") == [(1, 4, 1)]
    assert rows(views.session_progress(t, OPERATOR), "session_id", "total_tasks") == [(1, 4), (2, 0)]
    assert rows(latest_tasks(t, OPERATOR, 2), "task_id") == [(3,), (4,)]


def test_delegation_and_approval_scenario(spark):
    """An orchestrator delegates, the executor asks for approval, gets it, finishes, and the parent goes on."""
    t = bundle(spark, **agents(2))
    t = enqueue(t, spark.createDataFrame([(1, "a1", "brief me", None)], REQUEST), OPERATOR, NOW).tables
    changed = ("tasks", "sessions", "execution_logs", "agent_messages", "task_dependencies", "agent_events", "human_approvals")

    def submit(tables, seq, task_id, response):
        return submit_results(settle(tables, *changed), spark.createDataFrame([(seq, task_id, response, False)], RESPONSE), NOW)

    got = submit(t, 1, 1, '{"action":"delegate","to_agent":"a2","task":"find it"}')
    assert rows(got.actions, "action", "pending_task_ids") == [("wait_tasks", [2])]
    assert rows(task_graph(got.tables), "task_id", "agent", "status") == [(1, "a1", "waiting"), (2, "a2", "pending")]
    assert rows(message_trace(got.tables), "sender", "receiver", "direction", "content") == [("a1", "a2", "instruction", "find it")]
    got = submit(got.tables, 2, 2, '{"action":"request_approval","reason":"send mail"}')
    assert rows(got.actions, "action", "approval_id") == [("wait_approval", 1)]
    assert rows(views.pending_approvals(got.tables), "approval_id", "reason") == [(1, "send mail")]
    approved = resolve_approvals(got.tables, spark.createDataFrame([(1, "approved", "fine")], DECISION), OPERATOR, NOW)
    assert rows(approved.tables.tasks, "task_id", "status") == [(1, "waiting"), (2, "pending")]
    got = submit(approved.tables, 3, 2, "found")
    assert rows(got.tables.tasks, "task_id", "status") == [(1, "pending"), (2, "completed")]
    got = submit(got.tables, 4, 1, '{"action":"finish","final_answer":"brief"}')
    assert rows(got.tables.sessions, "status", "final_answer") == [("completed", "brief")]
    assert validate_tables(got.tables, ["tasks", "task_dependencies", "agent_messages", "execution_logs"]).isEmpty()


def test_tool_scenario(spark):
    tool = {"tool_id": 1, "name": "web", "description": "d", "input_schema": "{}", "tool_type": "mcp", "mcp_server_url": "u",
            "is_active": True, "created_at": T0, "updated_at": T0}
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(1, status="running")], tool_registry=[tool],
               agent_tool_permissions=[{"agent_id": 1, "tool_id": 1, "granted_at": T0}])
    batch = [(1, 1, '{"action":"call_tool","tool_name":"web","args":{"q":"x"}}', False), (2, 1, '{"action":"finish","final_answer":"y"}', False)]
    got = submit_results(t, spark.createDataFrame(batch, RESPONSE), NOW)
    assert rows(got.actions, "seq", "action", "args") == [(1, "invoke_tool", '{"q":"x"}'), (2, "done", None)]
    assert rows(got.tables.tasks, "status", "output") == [("completed", "y")]


def test_blank_requests_of_any_white_space(spark):
    t = bundle(spark, **agents(1))
    asked = [(1, "a1", "\n\t ", None), (2, " a1\u00a0", "\u2003go\n", None), (3, "\t", "x", None)]
    got = enqueue(t, spark.createDataFrame(asked, REQUEST), OPERATOR, NOW)
    assert rows(got.rejects) == [(1, "task_required"), (3, "agent_role_required")]
    assert rows(got.tables.tasks, "input") == [("go",)]
