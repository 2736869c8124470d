"""Ingestion of a batch of model responses.

The batch has the effect of ingesting its responses one after the other in `seq` order, but nothing is replayed: what a response
does depends on earlier ones only through three running quantities, each a distributed prefix aggregate over `seq` —
the log rows already appended to its task, the number of live tasks in its session, and the number of live prerequisites of a
waiting parent. The cost does not depend on how many responses fall on one task or session.

Responses address tasks that exist when the batch starts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import is_json, json_object, json_of, text_of
from ..functions.running import PLACE, placed, running
from ..model import TERMINAL, Tables
from ..session import stage
from .delta import Append, Upsert, assign_ids, first_free, instant, log_steps, typed
from .guard import check_sql

# Texts written to the log of a task.
TOOL_NAME_MISSING = "TOOL ERROR: tool_name missing in response"
TOOL_NOT_PERMITTED = "TOOL ERROR: tool not found or not permitted: "
DELEGATE_UNKNOWN = "DELEGATE ERROR: agent not found: "
SQL_ERROR = "SQL ERROR: "
PREVIEW_CHARS = 200
ANSWER_CHARS = 500

ACTIONS = ("continue", "done", "invoke_tool", "wait_tasks", "wait_approval")
TOOL_FIELDS = (
    "tool_id", "name", "tool_type", "mcp_server_url", "mcp_server_name", "http_endpoint", "http_method",
    "http_headers", "custom_code", "runtime", "input_schema",
)
_PARENT = "struct<from_agent_id:bigint,parent_task_id:bigint>"
_TOOL = "struct<" + ",".join(f"{f}:{'bigint' if f == 'tool_id' else 'string'}" for f in TOOL_FIELDS) + ">"
_CLASSIFIED = {
    "seq": "bigint", "task_id": "bigint", "session_id": "bigint", "agent_id": "bigint", "base_status": "string",
    "response": "string", "kind": "string", "answer": "string", "note": "string", "tool": _TOOL, "args": "string",
    "sql_text": "string", "sql_output": "string", "sql_error": "string", "to_role": "string", "to_agent_id": "bigint",
    "sub_task": "string", "reason": "string", "parent": _PARENT, "reject": "string",
}


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add `action` and its fields. Text that is not JSON finishes the task with the text as the answer."""
    text = F.col("response")
    final = F.coalesce("is_final", F.lit(False))
    read = responses.withColumn("_ok", ~final & is_json(text)).withColumn("_v", F.when(F.col("_ok"), F.try_parse_json(text)))
    v, ok = F.col("_v"), F.col("_ok")
    return read.select(
        "seq", "task_id", "response", final.alias("is_final"),
        ok.alias("is_json"),
        F.when(ok, text_of(v, "action")).when(~final, "finish").alias("action"),
        F.when(ok, text_of(v, "final_answer")).otherwise(text).alias("final_answer"),
        text_of(v, "tool_name").alias("tool_name"),
        F.when(ok, F.coalesce(json_of(v, "args"), F.lit("{}"))).alias("args"),
        text_of(v, "args.sql").alias("sql_text"),
        text_of(v, "to_agent").alias("to_agent"),
        text_of(v, "task").alias("sub_task"),
        text_of(v, "reason").alias("reason"),
    )


def _read(t: Tables, responses: DataFrame) -> DataFrame:
    """Parsed responses with their task and, for a delegated task, the instruction it came from."""
    tasks = t.tasks.select("task_id", "session_id", "agent_id", F.col("status").alias("base_status"))
    asked = responses.select("task_id").distinct()
    instructions = (
        t.agent_messages.where(F.col("direction") == "instruction")
        .join(asked.withColumnRenamed("task_id", "child_task_id"), "child_task_id", "left_semi")
        .groupBy(F.col("child_task_id").alias("task_id"))
        .agg(F.min_by(F.struct("from_agent_id", "parent_task_id"), "message_id").alias("parent"))
    )
    kind = (
        F.when(F.col("is_final"), "forced")
        .when(F.col("action").isin("finish", "call_tool", "delegate", "request_approval"), F.col("action"))
        .otherwise("continue")
    )
    repeats = responses.groupBy("seq").agg(F.count(F.lit(1)).alias("repeats")).where("repeats > 1")
    parsed = parse_responses(responses).withColumn("kind", kind).join(repeats, "seq", "left")
    joined = parsed.join(tasks, "task_id", "left").join(instructions, "task_id", "left")
    reject = (
        F.when(F.col("repeats") > 1, "repeated_seq")
        .when(F.col("seq").isNull(), "no_seq")
        .when(F.col("session_id").isNull(), "unknown_task")
        .when(F.col("response").isNull(), "no_response")
        .when((F.col("kind") == "finish") & F.col("parent").isNotNull() & F.col("final_answer").isNull(),
              "finish_without_answer")
        .when((F.col("kind") == "request_approval") & F.col("reason").isNull(), "approval_without_reason")
    )
    return joined.withColumn("reject", reject)


def _conform(df: DataFrame, **columns: Column) -> DataFrame:
    known = {c: F.col(c) for c in df.columns if c in _CLASSIFIED}
    known.update(columns)
    return df.select(*[known.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _CLASSIFIED.items()])


def _tool_calls(t: Tables, calls: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Calls with their tool, or with the note that tells why there is none. Sql calls get their verdict and outcome."""
    tools = t.tool_registry.where("is_active").select(
        F.col("name").alias("tool_name"), F.col("tool_id"), F.struct(*TOOL_FIELDS).alias("tool")
    )
    grants = t.agent_tool_permissions.select("agent_id", "tool_id", F.lit(True).alias("granted"))
    named = calls.where(F.col("tool_name").isNotNull())
    found = named.join(tools, "tool_name", "left").join(grants, ["agent_id", "tool_id"], "left")
    ok = F.coalesce("granted", F.lit(False))
    is_sql = F.col("tool.tool_type") == "sql"
    missing = _conform(
        calls.where(F.col("tool_name").isNull()), kind=F.lit("tool_error"), note=F.lit(TOOL_NAME_MISSING)
    )
    refused = _conform(
        found.where(~ok), kind=F.lit("tool_error"), note=F.concat(F.lit(TOOL_NOT_PERMITTED), "tool_name"), tool=F.lit(None)
    )
    handed = _conform(found.where(ok & ~is_sql), kind=F.lit("tool_invoke"))

    judged = check_sql(found.where(ok & is_sql), t.sql_sandbox_allowlist)
    if outcomes is not None:
        given = outcomes.select("seq", F.col("output").alias("_output"), F.col("error").alias("_error"))
        judged = judged.join(given, "seq", "left")
    else:
        judged = judged.withColumns({"_output": F.lit(None).cast("string"), "_error": F.lit(None).cast("string")})
    error = F.coalesce("message", "_error")
    output = F.when(error.isNull(), F.col("_output"))
    sql = _conform(
        judged, kind=F.lit("tool_sql"), sql_error=error, sql_output=output,
        note=F.coalesce(F.concat(F.lit(SQL_ERROR), error), output),
    )
    return reduce(DataFrame.unionByName, [missing, refused, handed, sql])


def _delegations(t: Tables, rows: DataFrame) -> DataFrame:
    agents = t.agent_meta.where("is_active").select(
        F.col("role_name").alias("to_agent"), F.col("agent_id").alias("to_agent_id")
    )
    found = rows.join(agents, "to_agent", "left")
    unknown = F.col("to_agent_id").isNull()
    return _conform(
        found,
        kind=F.when(unknown, "delegate_error").otherwise("delegate"),
        to_role=F.col("to_agent"),
        note=F.when(unknown, F.concat(F.lit(DELEGATE_UNKNOWN), F.coalesce("to_agent", F.lit("(null)")))),
        reject=F.when(~unknown & F.col("sub_task").isNull(), "delegate_without_task"),
    )


def classify(t: Tables, responses: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """What every response is going to do, as far as that does not depend on other responses."""
    read = stage(_read(t, responses))
    known = read.where(F.col("reject").isNull())
    calls, delegates = F.col("kind") == "call_tool", F.col("kind") == "delegate"
    plain = read.where(F.col("reject").isNotNull() | (~calls & ~delegates))
    answer = F.when(F.col("kind") == "forced", F.col("response")).when(F.col("kind") == "finish", F.col("final_answer"))
    return (
        _conform(plain, answer=answer)
        .unionByName(_tool_calls(t, known.where(calls), outcomes))
        .unionByName(_delegations(t, known.where(delegates)))
    )


def _transitions(c: DataFrame) -> DataFrame:
    """Responses that set the status of their task, with the change in the number of live tasks.

    `own` is the change by the task itself, `change` also counts the new task of a delegation.
    """
    status = F.when(F.col("kind").isin("forced", "finish"), "completed").when(
        F.col("kind").isin("delegate", "request_approval"), "waiting"
    )
    moves = c.withColumn("new_status", status).where(F.col("new_status").isNotNull()).select(
        "seq", "task_id", "session_id", "kind", "answer", "parent", "base_status", "new_status",
        F.col("new_status").isin(*TERMINAL).alias("ends"),
    )
    before = running(placed(moves, "seq"), ["task_id"], ["seq"], {"_prev": ("max", F.struct("seq", "ends"))})
    ended = F.coalesce("_prev.ends", F.col("base_status").isin(*TERMINAL))
    own = ended.cast("int") - F.col("ends").cast("int")
    return before.withColumn("own", own).withColumn(
        "change", F.col("own") + (F.col("kind") == "delegate").cast("int")
    )


def close_sessions(t: Tables, moves: DataFrame) -> DataFrame:
    """Finishes after which no task of the session is live."""
    touched = moves.select("session_id").distinct()
    live = (
        t.tasks.where(~F.col("status").isin(*TERMINAL))
        .join(touched, "session_id", "left_semi")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("_live"))
    )
    counted = running(moves, ["session_id"], ["seq"], {"_sum": ("sum", F.col("change"))})
    left = F.coalesce("_live", F.lit(0)) + F.col("_sum") + F.col("change")
    return (
        counted.where(F.col("kind").isNotNull())
        .join(live, "session_id", "left")
        .where((F.col("kind") == "finish") & (left == 0))
        .select("seq", "session_id", "task_id", "answer")
    )


def _live_at(moves: DataFrame, lookups: DataFrame, t: Tables) -> DataFrame:
    """Distinct (task_id, seq) with whether the task is live right after that response."""
    points = placed(
        moves.select("task_id", "seq", "ends")
        .unionByName(lookups.select("task_id", "seq", F.lit(None).cast("boolean").alias("ends")).distinct())
        .groupBy("task_id", "seq")
        .agg(F.max("ends").alias("ends")),
        "seq",
    )
    known = F.when(F.col("ends").isNotNull(), F.struct("seq", "ends"))
    before = running(points, ["task_id"], ["seq"], {"_prev": ("max", known)})
    states = t.tasks.select("task_id", F.col("status").isin(*TERMINAL).alias("_ended"))
    return before.join(states, "task_id").select("task_id", "seq", (~F.coalesce("ends", "_prev.ends", "_ended")).alias("live"))


def release_parents(t: Tables, moves: DataFrame) -> DataFrame:
    """Parents that end the batch as pending: waiting, and at some answer of a child no prerequisite was live.

    The live prerequisites of a parent over time are a running sum of the changes of its prerequisites. Where a prerequisite
    changes more often than the parent gets answers, its state is looked up at the answers instead, so the rows per edge are
    the smaller of the two counts and a busy prerequisite shared by many parents does not multiply.
    """
    answers = moves.where((F.col("kind") == "finish") & F.col("parent.parent_task_id").isNotNull()).select(
        F.col("parent.parent_task_id").alias("task_id"), "seq"
    )
    asked = answers.groupBy("task_id").agg(F.count(F.lit(1)).alias("_answers"))
    flips = moves.where("own <> 0").select(F.col("task_id").alias("depends_on_task_id"), "seq", "own")
    often = flips.groupBy("depends_on_task_id").agg(F.count(F.lit(1)).alias("_flips"))
    edges = stage(
        t.task_dependencies.select("task_id", "depends_on_task_id")
        .join(asked, "task_id")
        .join(often, "depends_on_task_id", "left")
        .select("task_id", "depends_on_task_id", (F.coalesce("_flips", F.lit(0)) > F.col("_answers")).alias("busy"))
    )
    steady, busy = edges.where(~F.col("busy")), edges.where("busy")

    live = t.tasks.where(~F.col("status").isin(*TERMINAL)).select(F.col("task_id").alias("depends_on_task_id"))
    base = steady.join(live, "depends_on_task_id").groupBy("task_id").agg(F.count(F.lit(1)).alias("_base"))
    none = F.lit(0)
    by_dependency = flips.join(steady, "depends_on_task_id").select(
        "task_id", "seq", F.col("own").alias("change"), none.alias("asks")
    )
    delegated = moves.where("kind = 'delegate'").join(asked, "task_id", "left_semi")
    by_delegation = delegated.select("task_id", "seq", F.lit(1).alias("change"), none.alias("asks"))
    by_answer = answers.select("task_id", "seq", none.alias("change"), F.lit(1).alias("asks"))
    points = placed(
        by_dependency.unionByName(by_delegation)
        .unionByName(by_answer)
        .groupBy("task_id", "seq")
        .agg(F.sum("change").alias("change"), F.max("asks").alias("asks")),
        "seq",
    )
    counted = running(points, ["task_id"], ["seq"], {"_sum": ("sum", F.col("change"))}).where("asks = 1")

    if not busy.isEmpty():
        lookups = answers.join(busy, "task_id").select(
            F.col("depends_on_task_id").alias("task_id"), "seq", F.col("task_id").alias("_parent")
        )
        blocked = lookups.join(_live_at(moves, lookups, t), ["task_id", "seq"]).where("live")
        counted = counted.join(blocked.select(F.col("_parent").alias("task_id"), "seq"), ["task_id", "seq"], "left_anti")
    last = moves.groupBy("task_id").agg(F.max(F.struct("seq", "new_status")).alias("_last"))
    states = t.tasks.select("task_id", F.col("status").alias("_status"))
    free = F.coalesce("_base", none) + F.col("_sum") + F.col("change") == 0
    later = F.coalesce(F.col("seq") > F.col("_last.seq"), F.lit(True))
    waiting = F.coalesce("_last.new_status", "_status") == "waiting"
    return (
        counted.join(base, "task_id", "left")
        .join(last, "task_id", "left")
        .join(states, "task_id")
        .where(free & later & waiting)
        .select("task_id")
        .distinct()
    )


def _note_rows(c: DataFrame) -> DataFrame:
    """The raw response as an assistant step and, where there is one, the note as a tool step right after it."""
    steps = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("slot"), F.lit("assistant").alias("role"), F.col("response").alias("content")),
            F.when(
                F.col("note").isNotNull(),
                F.struct(F.lit(1).alias("slot"), F.lit("tool").alias("role"), F.col("note").alias("content")),
            ),
        )
    )
    return c.select("seq", "task_id", F.explode(steps).alias("s")).select("seq", "task_id", "s.slot", "s.role", "s.content")


def _changed_tasks(t: Tables, c: DataFrame, released: DataFrame, now: Column) -> DataFrame:
    """The tasks that responses address or release, as they are after the batch."""
    ends = F.col("kind").isin("forced", "finish")
    moved = ends | F.col("kind").isin("delegate", "request_approval")
    status = F.when(ends, "completed").otherwise("waiting")
    own = c.groupBy("task_id").agg(
        F.max(F.when(moved, F.struct("seq", status.alias("v")))).alias("_status"),
        F.max(F.when(ends, F.struct("seq", F.col("answer").alias("v")))).alias("_output"),
        F.lit(True).alias("_hit"),
    )
    marks = own.join(released.withColumn("_released", F.lit(True)), "task_id", "full")
    changed = {
        "status": F.when(F.col("_released"), "pending").otherwise(F.coalesce("_status.v", "status")),
        "output": F.when(F.col("_output").isNotNull(), F.col("_output.v")).otherwise(F.col("output")),
        "heartbeat_at": F.when(F.col("_hit"), now).otherwise(F.col("heartbeat_at")),
        "updated_at": now,
    }
    return t.tasks.join(marks, "task_id").select(
        *[changed[x].alias(x) if x in changed else F.col(x) for x in t.tasks.columns]
    )


def _event_commands(c: DataFrame, closed: DataFrame, children: DataFrame, approvals: DataFrame) -> DataFrame:
    """Event commands; a closing session is reported before the end of the task that closed it."""

    def event(df: DataFrame, slot: int, kind: str, payload: Column) -> DataFrame:
        return df.select(
            "seq", F.lit(slot).alias("slot"), "agent_id", "session_id", "task_id",
            F.lit(kind).alias("event_type"), payload.alias("payload"),
        )

    def preview(chars: int) -> Column:
        return F.left(F.coalesce("answer", F.lit("")), F.lit(chars))

    kind = F.col("kind")
    tool = json_object(tool_name=F.col("tool.name"), tool_type=F.col("tool.tool_type"))
    agents = c.select("seq", "agent_id")
    return reduce(
        DataFrame.unionByName,
        [
            event(closed.join(agents, "seq"), 0, "session_end", json_object(final_answer=preview(ANSWER_CHARS))),
            event(c.where(kind == "finish"), 1, "task_end", json_object(output_preview=preview(PREVIEW_CHARS))),
            event(c.where(kind == "forced"), 1, "task_end", json_object(forced=F.lit(True))),
            event(c.where(kind.isin("tool_invoke", "tool_sql")), 1, "tool_call", tool),
            event(children, 1, "delegation", json_object(to_agent=F.col("to_role"), subtask_id=F.col("child_id"))),
            event(approvals, 1, "approval_request",
                  json_object(approval_id=F.col("approval_id"), reason=F.col("reason"))),
        ],
    )


def deliver_to_parent(c: DataFrame) -> DataFrame:
    """The answer of a delegated task as a message to the agent that gave the instruction."""
    return c.where((F.col("kind") == "finish") & F.col("parent").isNotNull()).select(
        "seq", F.col("agent_id").alias("from_agent_id"), F.col("parent.from_agent_id").alias("to_agent_id"), "session_id",
        F.col("parent.parent_task_id").alias("parent_task_id"), F.col("task_id").alias("child_task_id"),
        F.lit("result").alias("direction"), F.lit("delivered").alias("status"), F.col("answer").alias("content"),
    )


def _instructions(children: DataFrame) -> DataFrame:
    return children.select(
        "seq", F.col("agent_id").alias("from_agent_id"), "to_agent_id", "session_id",
        F.col("task_id").alias("parent_task_id"), F.col("child_id").alias("child_task_id"),
        F.lit("instruction").alias("direction"), F.lit("delivered").alias("status"), F.col("sub_task").alias("content"),
    )


def _actions(c: DataFrame, children: DataFrame, approvals: DataFrame) -> DataFrame:
    kind = F.col("kind")
    finish, ends = kind == "finish", kind.isin("finish", "forced")
    action = (
        F.when(ends, "done").when(kind == "tool_invoke", "invoke_tool").when(kind == "delegate", "wait_tasks")
        .when(kind == "request_approval", "wait_approval").otherwise("continue")
    )
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, pending: Column, approval: Column) -> DataFrame:
        return df.select(
            "seq", "task_id", action.alias("action"),
            F.when(ends, F.col("answer")).alias("output"),
            F.when(ends, finish).alias("need_embedding"),
            F.when(finish, F.col("agent_id")).alias("agent_id"),
            F.when(finish, F.col("session_id")).alias("session_id"),
            F.when(kind == "tool_invoke", F.col("tool")).alias("tool"),
            F.when(kind == "tool_invoke", F.col("args")).alias("args"),
            pending.cast("array<bigint>").alias("pending_task_ids"),
            approval.alias("approval_id"),
            ((kind == "tool_sql") & F.col("sql_error").isNull() & F.col("sql_output").isNull()).alias("awaits_sql"),
        )

    rest = c.where(~kind.isin("delegate", "request_approval"))
    return (
        rows(rest, F.lit(None), none)
        .unionByName(rows(children, F.array("child_id"), none))
        .unionByName(rows(approvals, F.lit(None), F.col("approval_id")))
    )


class Ingested:
    """The effect of a batch. Every part is planned when it is first asked for.

    `actions` has one row per accepted response; `awaits_sql` marks those to be held back until the result of their sql call is in.
    `rejects` has the refused ones, and `pending_sql` the sql tool calls that passed the
    checks and whose result the caller still has to supply. `tables` are the tables after the batch.
    """

    def __init__(self, t: Tables, classified: DataFrame, as_of: str | Column):
        self._t = t
        self._classified = classified
        self._as_of = as_of
        self._now = instant(as_of)
        self._accepted = classified.where(F.col("reject").isNull())

    @cached_property
    def actions(self) -> DataFrame:
        return _actions(self._accepted, self._children, self._approvals)

    @cached_property
    def rejects(self) -> DataFrame:
        return self._classified.where(F.col("reject").isNotNull()).select("seq", "task_id", F.col("reject").alias("reason"))

    @cached_property
    def pending_sql(self) -> DataFrame:
        return self._accepted.where(
            (F.col("kind") == "tool_sql") & F.col("sql_error").isNull() & F.col("sql_output").isNull()
        ).select("seq", "task_id", F.col("tool.tool_id").alias("tool_id"), F.col("args").alias("input"), "sql_text")

    @cached_property
    def changes(self) -> dict[str, Append | Upsert]:
        """What the batch adds to each table, for a store that appends and replaces rows instead of tables."""
        return {name: change() for name, change in self._planned.items()}

    @cached_property
    def tables(self) -> Tables:
        def after(name: str) -> Callable[[], DataFrame]:
            return lambda: self._planned[name]().after(self._t[name])

        return self._t.replace(**{name: after(name) for name in self._planned})

    @cached_property
    def _planned(self) -> dict[str, Callable[[], Append | Upsert]]:
        return {
            "tasks": self._tasks,
            "task_dependencies": self._dependencies,
            "execution_logs": self._logs,
            "session_participants": self._participants,
            "agent_messages": self._messages,
            "human_approvals": self._human_approvals,
            "tool_executions": self._executions,
            "sessions": self._sessions,
            "agent_events": self._events,
        }

    @cached_property
    def _moves(self) -> DataFrame:
        return stage(_transitions(self._accepted))

    @cached_property
    def _closed(self) -> DataFrame:
        return close_sessions(self._t, self._moves)

    @cached_property
    def _before(self) -> DataFrame:
        """Per response, how many rows of each kind the responses before it add: the batch is numbered once, over narrow rows."""
        kind = F.col("kind")
        answered = F.col("sql_error").isNotNull() | F.col("sql_output").isNotNull()
        finish, delegate = kind == "finish", kind == "delegate"
        adds = {
            "children": delegate,
            "approvals": kind == "request_approval",
            "messages": delegate | (finish & F.col("parent").isNotNull()),
            "executions": (kind == "tool_sql") & answered,
            "notes": F.col("note").isNotNull(),
            "reports": kind.isin("finish", "forced", "tool_invoke", "tool_sql", "delegate", "request_approval"),
        }
        flags = self._accepted.select("seq", "task_id", *[F.coalesce(v, F.lit(False)).cast("long").alias(k) for k, v in adds.items()])
        closing = self._closed.select("seq", F.lit(1).cast("long").alias("closes"))
        narrow = flags.join(closing, "seq", "left").withColumns(
            {"closes": F.coalesce("closes", F.lit(0).cast("long")), "steps": F.col("notes") + 1}
        )
        narrow = placed(narrow.withColumn("events", F.col("reports") + F.col("closes")).drop("notes", "reports"), "seq")
        names = ("children", "approvals", "messages", "executions", "steps", "events")
        every = running(narrow, [], ["seq"], {f"{n}_before": ("sum", F.col(n)) for n in names})
        own = running(narrow.select("seq", "task_id", "steps", PLACE), ["task_id"], ["seq"], {"own_before": ("sum", F.col("steps"))})
        return stage(every.drop(*names).join(own.select("seq", "own_before"), "seq").drop("task_id", PLACE))

    def _number(self, rows: DataFrame, table: str, key: str, kind: str, out: str | None = None, slot: str | Column = "") -> DataFrame:
        """Rows (seq, …) with their id: the first free one, plus what earlier responses add, plus the place within the response."""
        start = first_free(self._t[table], key, self._t.last_ids.get(table))
        place = slot if isinstance(slot, Column) else F.lit(0)
        keep = ["seq", f"{kind}_before", *(["closes"] if kind == "events" else []), *(["own_before"] if kind == "steps" else [])]
        joined = rows.join(self._before.select(*keep), "seq")
        return joined.withColumn(out or key, start + F.col(f"{kind}_before") + place).drop(f"{kind}_before")

    @cached_property
    def _children(self) -> DataFrame:
        return self._number(self._accepted.where("kind = 'delegate'"), "tasks", "task_id", "children", "child_id")

    @cached_property
    def _approvals(self) -> DataFrame:
        return self._number(self._accepted.where("kind = 'request_approval'"), "human_approvals", "approval_id", "approvals")

    def _tasks(self) -> Upsert:
        released = release_parents(self._t, self._moves)
        new = self._children.select(
            F.col("child_id").alias("task_id"), "session_id", F.col("to_agent_id").alias("agent_id"),
            F.lit("pending").alias("status"), F.col("sub_task").alias("input"), F.lit(0).alias("retry_count"),
            self._now.alias("created_at"), self._now.alias("updated_at"),
        )
        changed = _changed_tasks(self._t, self._accepted, released, self._now)
        return Upsert(changed.unionByName(typed(new, "tasks")), ("task_id",))

    def _dependencies(self) -> Append:
        edges = self._children.select("seq", "task_id", F.col("child_id").alias("depends_on_task_id"))
        return Append(typed(self._number(edges, "task_dependencies", "dependency_id", "children"), "task_dependencies"))

    def _logs(self) -> Append:
        logs = self._t.execution_logs
        asked = self._accepted.select("task_id").distinct()
        latest = logs.join(asked, "task_id", "left_semi").groupBy("task_id").agg(F.max("step_number").alias("_last"))
        numbered = self._number(_note_rows(self._accepted), "execution_logs", "log_id", "steps", slot=F.col("slot"))
        step = F.coalesce("_last", F.lit(0)) + F.col("own_before") + F.col("slot") + 1
        rows = numbered.join(latest, "task_id", "left").withColumns({"step_number": step, "created_at": self._now})
        return Append(typed(rows, "execution_logs"))

    def _participants(self) -> Append:
        key = ["session_id", "agent_id"]
        members = self._children.select("session_id", F.col("to_agent_id").alias("agent_id")).distinct()
        new = members.join(self._t.session_participants.select(*key), key, "left_anti")
        return Append(typed(new.withColumn("joined_at", self._now), "session_participants"))

    def _messages(self) -> Append:
        sent = deliver_to_parent(self._accepted).unionByName(_instructions(self._children))
        numbered = self._number(sent, "agent_messages", "message_id", "messages")
        return Append(typed(numbered.withColumn("created_at", self._now), "agent_messages"))

    def _human_approvals(self) -> Append:
        asked = self._approvals.select(
            "approval_id", "task_id", "session_id", F.col("agent_id").alias("requested_by_agent_id"), "reason",
            F.lit("pending").alias("status"), self._now.alias("created_at"),
        )
        return Append(typed(asked, "human_approvals"))

    def _executions(self) -> Append:
        answered = F.col("sql_error").isNotNull() | F.col("sql_output").isNotNull()
        ran = self._accepted.where((F.col("kind") == "tool_sql") & answered).select(
            "seq", "task_id", F.col("tool.tool_id").alias("tool_id"), F.col("args").alias("input"),
            F.col("sql_output").alias("output"), F.col("sql_error").alias("error"),
        )
        rows = self._number(ran, "tool_executions", "exec_id", "executions")
        return Append(typed(rows.withColumn("executed_at", self._now), "tool_executions"))

    def _sessions(self) -> Upsert:
        endings = self._closed.groupBy("session_id").agg(F.max(F.struct("seq", "answer")).alias("_end"))
        ended = {"status": F.lit("completed"), "final_answer": F.col("_end.answer"), "completed_at": self._now}
        rows = self._t.sessions.join(endings, "session_id").select(
            *[ended[c].alias(c) if c in ended else F.col(c) for c in self._t.sessions.columns]
        )
        return Upsert(rows, ("session_id",))

    def _events(self) -> Append:
        commands = _event_commands(self._accepted, self._closed, self._children, self._approvals)
        # The end of a session is reported first, anything else after it.
        place = F.when(F.col("slot") == 0, F.lit(0)).otherwise(F.col("closes"))
        rows = self._number(commands, "agent_events", "event_id", "events", slot=place)
        return Append(typed(rows.withColumn("created_at", self._now), "agent_events"))


def submit_results(
    t: Tables, responses: DataFrame, as_of: str | Column, outcomes: DataFrame | None = None
) -> Ingested:
    """Ingest responses (seq, task_id, response, is_final); those that share a `seq`, or have none, are rejected.

    `outcomes` (seq, output, error) are results of sql tool calls the caller has already run. Results that come later go through
    `ingest_sql_tool_results`.
    """
    return Ingested(t, stage(classify(t, responses, outcomes)), as_of)


def ingest_sql_tool_results(t: Tables, outcomes: DataFrame, as_of: str | Column) -> Tables:
    """Record results (seq, task_id, tool_id, input, output, error) of sql tool calls that were run outside."""
    now = instant(as_of)
    rows = assign_ids(outcomes, t.tool_executions, "exec_id", "seq").withColumn("executed_at", now)
    failed = F.concat(F.lit(SQL_ERROR), "error")
    steps = outcomes.select(
        "seq", "task_id", F.lit("tool").alias("role"), F.coalesce(failed, "output").alias("content")
    )
    return t.replace(
        tool_executions=t.tool_executions.unionByName(typed(rows, "tool_executions")),
        execution_logs=t.execution_logs.unionByName(log_steps(t.execution_logs, steps, as_of)),
    )


def split_by_action(actions: DataFrame) -> dict[str, DataFrame]:
    """The five disjoint outputs of an ingestion."""
    return {name: actions.where(F.col("action") == name) for name in ACTIONS}


def split_by_tool_type(invocations: DataFrame) -> dict[str, DataFrame]:
    """Invocations per external tool type; envelopes of another action, without or with another type are rejects."""
    kind = F.col("tool.tool_type")
    valid = F.coalesce((F.col("action") == "invoke_tool") & kind.isin("mcp", "http", "custom"), F.lit(False))
    routes = {name: invocations.where(valid & (kind == name)) for name in ("mcp", "http", "custom")}
    return {**routes, "rejects": invocations.where(~valid)}
