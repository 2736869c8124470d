"""Written-out prompts against a per-task construction, and the sizes that stand for them."""

import random

from helpers import T0, agents, bundle, session, task

from taskloom.operators.prompts import build_messages, prompt_rows, render_prompt


def expected_prompt(data, row):
    system = data["agent_profiles"][0]["system_prompt"]
    if not any(a["role_name"] == f"a{row['agent_id']}" for a in data["agent_profile_assignments"]):
        system = ""
    messages = [("system", system)]
    for x in sorted(data["tasks"], key=lambda x: x["task_id"]):
        earlier = x["session_id"] == row["session_id"] and x["task_id"] < row["task_id"]
        if earlier and x["status"] == "completed" and x.get("output") is not None:
            messages += [("user", x["input"]), ("assistant", x["output"])]
    for m in sorted(data["agent_messages"], key=lambda m: m["message_id"]):
        mine = m["to_agent_id"] == row["agent_id"] and m["session_id"] == row["session_id"]
        if mine and m["direction"] == "result" and m["status"] == "delivered":
            messages.append(("tool", f"Subagent result from Agent {m['from_agent_id']}: {m['content']}"))
    logs = sorted((e for e in data["execution_logs"] if e["task_id"] == row["task_id"]), key=lambda e: e["step_number"])
    spoken = [(e["role"], e["content"]) for e in logs if e["role"] != "system"]
    if not any(role == "user" for role, _ in spoken):
        spoken.insert(0, ("user", row["input"]))
    return messages + spoken


def test_prompts_equal_brute_force(spark):
    rng = random.Random(2)
    data = agents(3)
    data["agent_profile_assignments"] = data["agent_profile_assignments"][:2]
    data["sessions"] = [session(1), session(2)]
    data["tasks"] = [
        task(i, session_id=rng.randint(1, 2), agent_id=rng.randint(1, 3), status=rng.choice(["pending", "completed"]),
             output=rng.choice([None, f"out {i}"]))
        for i in range(1, 25)
    ]
    data["agent_messages"] = [
        {"message_id": i, "from_agent_id": rng.randint(1, 3), "to_agent_id": rng.randint(1, 3), "session_id": rng.randint(1, 2),
         "direction": rng.choice(["result", "instruction"]), "status": rng.choice(["delivered", "pending"]),
         "content": f"m{i}", "created_at": T0}
        for i in range(1, 20)
    ]
    data["execution_logs"] = [
        {"log_id": i, "task_id": rng.randint(1, 24), "step_number": i, "role": rng.choice(["user", "assistant", "tool", "system"]),
         "content": f"c{i}", "created_at": T0}
        for i in range(1, 60)
    ]
    t = bundle(spark, **data)
    wanted = [x["task_id"] for x in data["tasks"]]
    got = {}
    asked = spark.createDataFrame([(i,) for i in [*wanted, 99]], "task_id long")
    for r in prompt_rows(t, asked).orderBy("part", "position", "tie").collect():
        got.setdefault(r["task_id"], []).append((r["role"], r["content"]))
    expected = {x["task_id"]: expected_prompt(data, x) for x in data["tasks"]}
    assert got == expected
    sizes = {r["task_id"]: (r["message_count"], r["char_count"]) for r in build_messages(t).collect()}
    assert sizes == {k: (len(v), sum(len(c) for _, c in v)) for k, v in expected.items()}
    lines = [r["line"] for r in render_prompt(prompt_rows(t, asked.where("task_id = 1"))).orderBy("part", "position", "tie").collect()]
    assert lines == [f"{role.upper()}: {content}" for role, content in expected[wanted[0]]]
