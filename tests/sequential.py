"""A plain one-response-at-a-time model of ingestion: the yardstick for the set-based operator."""

import json

TERMINAL = {"completed", "failed", "cancelled"}


class World:
    """State as dictionaries; `submit` applies one response and returns the action, or None if it is refused."""

    def __init__(self, tasks, deps, messages, agents, tools, grants, allowlist):
        self.tasks = {t["task_id"]: dict(t) for t in tasks}
        self.known = set(self.tasks)
        self.deps = [(d["task_id"], d["depends_on_task_id"]) for d in deps]
        self.messages = [dict(m) for m in messages]
        self.agents = {a["role_name"]: a["agent_id"] for a in agents if a["is_active"]}
        self.tools = {t["name"]: t for t in tools if t["is_active"]}
        self.grants = {(g["agent_id"], g["tool_id"]) for g in grants}
        self.allowlist = {a["view_name"].lower() for a in allowlist}
        self.sessions = {}
        self.logs, self.events, self.executions, self.approvals, self.participants = [], [], [], [], set()
        self.steps = {}
        self.next_task = max(self.tasks) + 1

    def live(self, task_ids):
        return any(self.tasks[t]["status"] not in TERMINAL for t in task_ids)

    def log(self, task_id, role, content):
        self.steps[task_id] = self.steps.get(task_id, 0) + 1
        self.logs.append((task_id, self.steps[task_id], role, content))

    def submit(self, task_id, response, is_final):
        if task_id not in self.known:
            return None
        task = self.tasks[task_id]
        try:
            parsed = json.loads(response)
        except ValueError:
            parsed = {"action": "finish", "final_answer": response}
        fields = parsed if isinstance(parsed, dict) else {}
        action = fields.get("action")
        instruction = next(
            (m for m in self.messages if m["child_task_id"] == task_id and m["direction"] == "instruction"), None
        )
        target = self.agents.get(fields.get("to_agent"))
        if not is_final:
            if action == "finish" and instruction and fields.get("final_answer") is None:
                return None
            if action == "delegate" and target is not None and fields.get("task") is None:
                return None
            if action == "request_approval" and fields.get("reason") is None:
                return None
        self.log(task_id, "assistant", response)
        task["touched"] = True
        if is_final:
            task.update(status="completed", output=response)
            self.events.append((task_id, "task_end"))
            return "done"
        if action == "finish":
            return self.finish(task, fields.get("final_answer"), instruction)
        if action == "call_tool":
            return self.call_tool(task, fields)
        if action == "delegate":
            return self.delegate(task, fields, target)
        if action == "request_approval":
            self.approvals.append((task_id, fields["reason"]))
            task["status"] = "waiting"
            self.events.append((task_id, "approval_request"))
            return "wait_approval"
        return "continue"

    def finish(self, task, answer, instruction):
        task.update(status="completed", output=answer)
        siblings = [t["task_id"] for t in self.tasks.values() if t["session_id"] == task["session_id"]]
        if not self.live(siblings):
            self.sessions[task["session_id"]] = answer
            self.events.append((task["task_id"], "session_end"))
        if instruction:
            parent = instruction["parent_task_id"]
            self.messages.append(
                {"from_agent_id": task["agent_id"], "to_agent_id": instruction["from_agent_id"], "direction": "result",
                 "parent_task_id": parent, "child_task_id": task["task_id"], "content": answer}
            )
            waits_for = [d for t, d in self.deps if t == parent]
            if parent in self.tasks and self.tasks[parent]["status"] == "waiting" and not self.live(waits_for):
                self.tasks[parent]["status"] = "pending"
                self.tasks[parent]["released"] = True
        self.events.append((task["task_id"], "task_end"))
        return "done"

    def call_tool(self, task, fields):
        name = fields.get("tool_name")
        tool = self.tools.get(name)
        if name is None:
            self.log(task["task_id"], "tool", "TOOL ERROR: tool_name missing in response")
            return "continue"
        if tool is None or (task["agent_id"], tool["tool_id"]) not in self.grants:
            self.log(task["task_id"], "tool", f"TOOL ERROR: tool not found or not permitted: {name}")
            return "continue"
        self.events.append((task["task_id"], "tool_call"))
        if tool["tool_type"] != "sql":
            return "invoke_tool"
        sql = fields.get("args", {}).get("sql")
        if sql is not None and sql.lower().startswith("select "):
            table = sql.lower().split("from ")[1].split()[0]
            if table in self.allowlist:
                return "continue"  # the caller runs it
            error = f"fn_execute_sql: view {table} not in sandbox allowlist"
        else:
            error = "fn_execute_sql: cannot parse FROM clause"
        self.executions.append((task["task_id"], tool["tool_id"], error))
        self.log(task["task_id"], "tool", f"SQL ERROR: {error}")
        return "continue"

    def delegate(self, task, fields, target):
        role = fields.get("to_agent")
        if target is None:
            self.log(task["task_id"], "tool", f"DELEGATE ERROR: agent not found: {role or '(null)'}")
            return "continue"
        child = self.next_task
        self.next_task += 1
        self.participants.add((task["session_id"], target))
        self.tasks[child] = {
            "task_id": child, "session_id": task["session_id"], "agent_id": target, "status": "pending", "output": None,
        }
        self.deps.append((task["task_id"], child))
        task["status"] = "waiting"
        self.messages.append(
            {"from_agent_id": task["agent_id"], "to_agent_id": target, "direction": "instruction",
             "parent_task_id": task["task_id"], "child_task_id": child, "content": fields["task"]}
        )
        self.events.append((task["task_id"], "delegation"))
        return "wait_tasks"
