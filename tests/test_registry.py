"""Tools, agents, grants, flows, embeddings and the constraint checks."""

import json
import random

import pytest
from helpers import NOW, T0, agents, bundle, frame, rows, session, task
from pyspark.sql import functions as F

from taskloom.model import OPERATOR, Principal
from taskloom.operators import embed, registry
from taskloom.operators.guard import check_sql
from taskloom.operators.lifecycle import recover_stale
from taskloom.operators.quality import validate_tables
from taskloom.operators.retention import purge_compressed, purge_events

CONFIG = "seq long, role_name string, config string"


def agent_config(name, **more):
    return json.dumps({"name": name, "agent_role": "executor", "provider": "custom", "model_name": "m", **more})


@pytest.mark.parametrize("on_driver", [0, 5, 10_000])
def test_conflicting_agents_are_admitted_first_come(spark, monkeypatch, on_driver):
    monkeypatch.setattr(registry, "DRIVER_CONFLICTS", on_driver)
    rng = random.Random(3)
    asked = [(i, f"r{rng.randint(1, 6)}", f"n{rng.randint(1, 6)}") for i in range(1, 30)]
    roles, names, expected = set(), set(), []
    for seq, role, name in asked:
        if role not in roles and name not in names:
            roles.add(role)
            names.add(name)
            expected.append((seq, role))
    t = bundle(spark, **agents(1))
    configs = spark.createDataFrame([(s, r, agent_config(n)) for s, r, n in asked], CONFIG)
    got = registry.provision_agents(t, configs, OPERATOR, NOW)
    assert rows(got.accepted, "seq", "role_name") == expected
    assert got.rejects.count() == len(asked) - len(expected)
    assert sorted(r[0] for r in rows(got.accepted, "agent_id")) == list(range(2, 2 + len(expected)))


def test_a_chain_of_conflicts(spark):
    """Each asks for the role of the one before or its name: every other is admitted."""
    t = bundle(spark, **agents(1))
    asked = [(i, f"r{(i + 1) // 2}", agent_config(f"n{i // 2}")) for i in range(1, 101)]
    got = registry.provision_agents(t, spark.createDataFrame(asked, CONFIG), OPERATOR, NOW)
    assert rows(got.accepted, "seq") == [(i,) for i in range(1, 101, 2)]


def test_agent_defaults_and_refusals(spark):
    tool = {"tool_id": 5, "name": "t", "description": "d", "input_schema": "{}", "tool_type": "sql", "is_active": True,
            "created_at": T0, "updated_at": T0}
    t = bundle(spark, **agents(1), tool_registry=[tool])
    asked = [
        (1, "x1", agent_config("X1", tool_ids=[5, 5])), (2, "x2", agent_config("X2", tool_ids=[9])), (3, "a1", agent_config("X3")),
        (4, "x4", agent_config("X4", max_steps="many")), (5, "x5", agent_config("X5", temperature=3)), (6, "x6", "{"),
        (7, "x7", json.dumps({"name": "X7"})), (8, "x8", agent_config("X8", provider="other")),
    ]
    got = registry.provision_agents(t, spark.createDataFrame(asked, CONFIG), OPERATOR, NOW)
    assert rows(got.accepted) == [(1, 2, "x1")]
    assert dict(rows(got.rejects)) == {2: "unknown_tool", 3: "duplicate", 4: "bad_value", 5: "out_of_range", 6: "bad_json",
                                       7: "missing_field", 8: "bad_domain"}
    assert rows(got.tables.agent_tool_permissions, "agent_id", "tool_id") == [(2, 5)]
    assert rows(got.tables.agent_profiles.where("profile_id = 2"), "max_steps", "max_retries") == [(10, 3)]
    assert rows(got.tables.llm_configs.where("llm_config_id = 2"), "temperature", "max_tokens", "endpoint") == [(0.7, 4096, "")]
    with pytest.raises(PermissionError):
        registry.provision_agents(t, spark.createDataFrame(asked, CONFIG), Principal("w", is_worker=True), NOW)


def test_drop_agent_leaves_no_dangling_row(spark):
    tool = {"tool_id": 1, "name": "t", "description": "d", "input_schema": "{}", "tool_type": "sql", "is_active": True,
            "created_at": T0, "updated_at": T0}
    data = {
        **agents(2), "sessions": [session(1), session(2, agent_id=2)],
        "tasks": [task(1), task(2, agent_id=2), task(3, session_id=2, agent_id=2), task(4, session_id=2, agent_id=1)],
        "task_dependencies": [{"dependency_id": 1, "task_id": 3, "depends_on_task_id": 2}],
        "execution_logs": [{"log_id": i, "task_id": i, "step_number": 1, "role": "user", "content": "c", "created_at": T0} for i in (1, 2, 3, 4)],
        "memory": [{"memory_id": 1, "agent_id": 2, "session_id": 1, "content": "m", "created_at": T0}],
        "agent_messages": [{"message_id": 1, "from_agent_id": 2, "to_agent_id": 2, "session_id": 2, "parent_task_id": 3, "child_task_id": 4,
                            "direction": "result", "status": "delivered", "content": "c", "created_at": T0}],
        "agent_events": [{"event_id": 1, "agent_id": 1, "session_id": 2, "task_id": 4, "event_type": "task_end", "created_at": T0}],
        "system_agent_configs": [{"config_id": 1, "agent_type": "embedder", "is_enabled": True, "role_name": "a1", "run_interval_secs": 5,
                                  "settings": "{}", "updated_at": T0}],
        "tool_registry": [tool],
        "agent_tool_permissions": [{"agent_id": 1, "tool_id": 1, "granted_at": T0}],
        "flow_registry": [{"flow_id": 1, "flow_name": "f", "agent_id": 1, "is_active": True, "created_at": T0}],
    }
    t = bundle(spark, **data)
    gone = registry.drop_agents(t, spark.createDataFrame([("a1",), ("ghost",)], "role_name string"), OPERATOR)
    assert rows(gone.rejects) == [("ghost", "not_found")]
    after = gone.tables
    assert rows(after.tasks, "task_id") == [(3,)] and rows(after.execution_logs, "task_id") == [(3,)]
    assert rows(after.memory, "memory_id", "session_id") == [(1, None)]
    assert rows(after.agent_messages, "parent_task_id", "child_task_id") == [(3, None)]
    assert rows(after.agent_events, "agent_id", "session_id", "task_id") == [(None, 2, None)]
    assert after.system_agent_configs.first()["role_name"] is None
    assert after.flow_registry.isEmpty() and after.agent_tool_permissions.isEmpty() and after.task_dependencies.isEmpty()
    assert validate_tables(after).isEmpty()


def test_flows_and_grants(spark):
    t = bundle(spark, **agents(2), flow_registry=[{"flow_id": 4, "flow_name": "f", "agent_id": 1, "is_active": False, "created_at": T0}])
    flows = spark.createDataFrame([(1, "f", 2, "u"), (2, "g", 1, "a"), (3, "g", 2, "b")],
                                  "seq long, flow_name string, agent_id long, webhook_url string")
    after = registry.register_flows(t, flows, OPERATOR, NOW).flow_registry
    assert rows(after, "flow_id", "flow_name", "agent_id", "webhook_url", "is_active") == [(4, "f", 2, "u", False), (5, "g", 2, "b", True)]
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "agent_id long, tool_id long")
    granted = registry.grant_tools(t, pairs, OPERATOR, NOW)
    assert rows(granted.agent_tool_permissions, "agent_id", "tool_id") == [(1, 1), (2, 1)]
    left = registry.revoke_tools(granted, pairs.where("agent_id = 2"), OPERATOR)
    assert rows(left.agent_tool_permissions, "agent_id", "tool_id") == [(1, 1)]


def test_rotation_and_reembedding(spark):
    config = [{"config_id": 1, "model_name": "m", "dimensions": 2, "endpoint": "", "is_active": True, "activated_at": T0}]
    memory = [{"memory_id": i, "agent_id": 1, "content": c, "embedding": [1.0, 1.0], "embedding_dims": 2, "created_at": T0}
              for i, c in enumerate(["good", "bad", "short"], start=1)]
    t = bundle(spark, **agents(1), embedding_config=config, memory=memory)
    rotated = embed.plan_rotation(t, OPERATOR, "n", 3, "e", NOW)
    assert rows(rotated.targets, "row_id", "current_dims") == [("1", 2), ("2", 2), ("3", 2)]
    assert rows(rotated.tables.embedding_config, "config_id", "dimensions", "is_active") == [(1, 2, False), (2, 3, True)]

    def model(texts):
        if "bad" in texts:
            raise ValueError("cannot read")
        return [[float(len(x))] * (1 if x == "short" else 3) for x in texts]

    done = embed.reembed(rotated.tables, model, NOW)
    assert rows(done.report) == [(1, 3)]
    assert rows(done.errors, "row_id", "error") == [("2", "cannot read"), ("3", "dim mismatch: got 1 expected 3")]
    assert rows(done.tables.memory, "memory_id", "embedding_dims") == [(1, 3), (2, 2), (3, 2)]
    assert rows(embed.embedding_coverage(done.tables), "searchable", "excluded") == [(1, 2)]
    assert rows(embed.reembed(rotated.tables, model, NOW, batch=1).report) == [(1, 1)]
    assert rows(done.changes["memory"].rows, "memory_id", "embedding_dims") == [(1, 3)]
    for answer in (lambda texts: None, lambda texts: [None] * len(texts), lambda texts: [], lambda texts: ["abc"] * len(texts)):
        bad = embed.reembed(rotated.tables, answer, NOW)
        assert rows(bad.report) == [(0, 3)] and bad.errors.where("error IS NULL").isEmpty()


def test_privileged_commands(spark):
    t = bundle(spark, **agents(1))
    nobody, none = Principal("a1"), t.memory.limit(0)
    for command in (
        lambda p: embed.plan_rotation(t, p, "m", 2, "e", NOW), lambda p: embed.set_memory_embeddings(t, p, none),
        lambda p: embed.set_tool_embeddings(t, p, t.tool_registry, NOW), lambda p: embed.insert_memories(t, p, none.withColumn("seq", F.lit(1)), NOW),
        lambda p: purge_compressed(t, p, t.tasks), lambda p: purge_events(t, p, NOW), lambda p: recover_stale(t, p, NOW),
    ):
        with pytest.raises(PermissionError):
            command(nobody)


def test_guard(spark):
    texts = ["SELECT 1 FROM Ok", "select a /* from x */ from ok", "-- c\nSELECT 1 FROM ok", "SELECT 'FROM secret' FROM ok", "", "  ",
             "SELECT 1;", "WITH x AS (SELECT 1) SELECT 1 FROM ok", "SELECT a\nFROM\tother", None]
    allow = frame(spark, "sql_sandbox_allowlist", [{"view_name": "OK", "created_at": T0}])
    got = check_sql(spark.createDataFrame(list(enumerate(texts)), "request_id long, sql_text string"), allow)
    verdicts = {r["request_id"]: r["verdict"] for r in got.collect()}
    assert verdicts == {0: "ok", 1: "ok", 2: "ok", 3: "not_allowlisted", 4: "empty", 5: "empty", 6: "multi_statement", 7: "not_select",
                        8: "not_allowlisted", 9: "no_from"}


def test_purges(spark):
    log = {"step_number": 1, "role": "user", "content": "c", "created_at": T0}
    logs = [{**log, "log_id": 1, "task_id": 1, "compressed_at": T0, "compression_quality": 0.95},
            {**log, "log_id": 2, "task_id": 1, "compressed_at": T0},
            {**log, "log_id": 3, "task_id": 2, "compressed_at": T0, "compression_quality": 0.5},
            {**log, "log_id": 4, "task_id": 3}]
    t = bundle(spark, **agents(1), sessions=[session(1)], tasks=[task(i) for i in (1, 2, 3, 4)], execution_logs=logs,
               agent_events=[{"event_id": 1, "event_type": "task_end", "created_at": T0}])
    got = purge_compressed(t, OPERATOR, t.tasks)
    assert rows(got.report) == [(1, False, 2), (2, True, 0), (3, True, 0), (4, False, 0)]
    assert rows(got.tables.execution_logs, "log_id") == [(3,), (4,)]
    assert rows(purge_events(t, OPERATOR, NOW, 0).report) == [(1,)] and rows(purge_events(t, OPERATOR, NOW, 1).report) == [(0,)]


def test_checks_report_planted_violations(spark):
    bad = bundle(spark, **agents(1), sessions=[session(1), session(1, status="odd")], tasks=[task(1, retry_count=-1), task(2, agent_id=9)])
    bad = bad.replace(tasks=bad.tasks.withColumn("input", F.when(F.col("task_id") == 1, F.col("input"))))
    assert rows(validate_tables(bad, ["sessions", "tasks"])) == [
        ("sessions", "status domain", "1"), ("sessions", "unique session_id", "1"), ("tasks", "agent_id references agent_meta", "2"),
        ("tasks", "input not null", "2"), ("tasks", "retry_count range", "1")]
