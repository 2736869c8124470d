"""The next action of every asked task, decided from one snapshot of the tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import json_object
from ..model import TERMINAL, Tables
from .delta import instant, log_events, log_steps
from .prompts import prompt_rows, prompt_sizes
from .search import DEFAULT_K, search_memory

LLM_FIELDS = ("provider", "endpoint", "model_name", "api_key_ref", "temperature", "max_tokens", "request_options")


def pending_dependencies(t: Tables) -> DataFrame:
    """Prerequisites of a task that are not terminal yet, one row each."""
    live = t.tasks.where(~F.col("status").isin(*TERMINAL)).select(F.col("task_id").alias("pending_task_id"))
    edges = t.task_dependencies.select("task_id", F.col("depends_on_task_id").alias("pending_task_id"))
    return edges.join(live, "pending_task_id").select("task_id", "pending_task_id")


def _agent_limits(t: Tables) -> DataFrame:
    """max_steps per agent, null without a profile."""
    profiles = t.agent_profiles.select("profile_id", "max_steps")
    assigned = t.agent_profile_assignments.select("role_name", "profile_id").join(profiles, "profile_id")
    return t.agent_meta.select("agent_id", "role_name").join(assigned, "role_name", "left").select(
        "agent_id", "max_steps"
    )


def _budgeted(t: Tables, counted: DataFrame) -> DataFrame:
    """Rows (agent_id, steps, …) of known agents with their limit, and whether it is used up. No limit is never used up."""
    joined = counted.join(_agent_limits(t), "agent_id")
    return joined.withColumn("exhausted", F.coalesce(F.col("steps") >= F.col("max_steps"), F.lit(False)))


def _counted(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """Tasks, all or those asked for, with the number of their assistant steps."""
    spoken = t.execution_logs.where("role = 'assistant'")
    tasks = t.tasks.select("task_id", "session_id", "agent_id", "status", "input", "output")
    if asked is not None:
        spoken, tasks = spoken.join(asked, "task_id", "left_semi"), tasks.join(asked, "task_id", "left_semi")
    steps = spoken.groupBy("task_id").agg(F.count(F.lit(1)).alias("_steps"))
    return tasks.join(steps, "task_id", "left").select(
        *tasks.columns, F.coalesce("_steps", F.lit(0).cast("long")).alias("steps")
    )


def step_budget(t: Tables) -> DataFrame:
    """Assistant steps a task has taken against the limit of its agent."""
    return _budgeted(t, _counted(t)).select("task_id", "steps", "max_steps", "exhausted")


def llm_config_envelope(t: Tables) -> DataFrame:
    """The model settings of every assigned agent as one struct."""
    assigned = t.agent_profile_assignments.select("role_name", "llm_config_id")
    models = t.llm_configs.select("llm_config_id", F.struct(*LLM_FIELDS).alias("llm_config"))
    return t.agent_meta.select("agent_id", "role_name").join(assigned, "role_name").join(models, "llm_config_id").select(
        "agent_id", "llm_config"
    )


def tool_catalogue(t: Tables) -> DataFrame:
    """The active tools granted to each agent, one row per tool."""
    tools = t.tool_registry.where("is_active").select("tool_id", "name", "description", "input_schema", "tool_type")
    return t.agent_tool_permissions.select("agent_id", "tool_id").join(tools, "tool_id").select(
        "agent_id", "name", "description", "input_schema", "tool_type"
    )


def tool_counts(t: Tables) -> DataFrame:
    active = t.tool_registry.where("is_active").select("tool_id")
    granted = t.agent_tool_permissions.select("agent_id", "tool_id").join(active, "tool_id", "left_semi")
    return granted.groupBy("agent_id").agg(F.count(F.lit(1)).alias("tool_count"))


def memory_context(t: Tables, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Per task (task_id, agent_id, query_vec) the k nearest memories of its agent, one row each, nearest first."""
    asked = queries.where(F.col("query_vec").isNotNull()).select(
        F.col("task_id").alias("query_id"), "agent_id", "query_vec"
    )
    return search_memory(t, asked, k).select(
        F.col("query_id").alias("task_id"), "rank", "memory_id", "content", "similarity"
    )


# Fixed value: the answer of a task whose steps are used up.
def _budget_text(limit: Column) -> Column:
    return F.concat(F.lit("Max steps ("), limit.cast("string"), F.lit(") reached."))


def _judged(t: Tables, counted: DataFrame) -> DataFrame:
    """Tasks with their action; `forced` marks an exhausted budget, `started` a task without any step yet."""
    terminal, waiting = F.col("status").isin(*TERMINAL), F.col("status") == "waiting"
    exhausted = F.col("exhausted")
    action = F.when(terminal, "done").when(waiting, "wait_tasks").when(exhausted, "done").otherwise("call_llm")
    return _budgeted(t, counted).withColumns(
        {
            "action": action,
            "forced": ~terminal & ~waiting & exhausted,
            "started": ~terminal & ~waiting & ~exhausted & (F.col("steps") == 0),
        }
    )


def task_start_events(t: Tables, asked: DataFrame) -> DataFrame:
    """Event commands for tasks about to take their first step. Asked again before that step, they start again."""
    return _start_commands(_judged(t, _counted(t, asked.select("task_id").distinct())))


def _start_commands(judged: DataFrame) -> DataFrame:
    return judged.where("started").select(
        F.col("task_id").alias("seq"), "agent_id", "session_id", "task_id",
        F.lit("task_start").alias("event_type"), json_object(input=F.col("input")).alias("payload"),
    )


class Decisions:
    """Decisions for asked tasks. Every part is planned when it is first asked for.

    `decisions` has one row per known task, `rejects` the unknown ones. Parts of unbounded length are rows that refer to the task:
    `pending` the prerequisites a waiting task waits for; for tasks whose model is called `messages` the prompt, `tools` the tools
    granted and `memory` the memories nearest to its query. `tables` are the tables after.
    """

    def __init__(self, t: Tables, requests: DataFrame, as_of: str | Column, k: int):
        self._t = t
        self._requests = requests
        self._as_of = as_of
        self._k = k

    @cached_property
    def _asked(self) -> DataFrame:
        return self._requests.select("task_id").distinct()

    @cached_property
    def _judged(self) -> DataFrame:
        return _judged(self._t, _counted(self._t, self._asked))

    @cached_property
    def rejects(self) -> DataFrame:
        t = self._t
        known = t.tasks.select("task_id", "agent_id").join(t.agent_meta.select("agent_id"), "agent_id", "left_semi")
        return self._asked.join(known, "task_id", "left_anti").select("task_id", F.lit("unknown_task").alias("reason"))

    @cached_property
    def pending(self) -> DataFrame:
        waiting = self._asked.join(self._t.tasks.where("status = 'waiting'").select("task_id"), "task_id")
        return pending_dependencies(self._t).join(waiting, "task_id", "left_semi")

    @cached_property
    def decisions(self) -> DataFrame:
        t = self._t
        waits = self.pending.groupBy("task_id").agg(F.count(F.lit(1)).alias("pending_count"))
        sizes = ("history_messages", "result_messages", "log_messages", "message_count")
        judged = _judged(t, prompt_sizes(t, self._asked))
        joined = (
            judged.join(waits, "task_id", "left")
            .join(llm_config_envelope(t), "agent_id", "left")
            .join(tool_counts(t), "agent_id", "left")
        )
        calls = F.col("action") == "call_llm"
        none = F.lit(0).cast("long")
        return joined.select(
            "task_id", "agent_id", "session_id", "action",
            F.when((F.col("action") == "done") & ~F.col("forced"), F.col("output")).alias("output"),
            "forced",
            F.when(F.col("action") == "wait_tasks", F.coalesce("pending_count", none)).alias("pending_count"),
            *[F.when(calls, F.col(c)).alias(c) for c in (*sizes, "llm_config")],
            F.when(calls, F.coalesce("tool_count", none)).alias("tool_count"),
        )

    @cached_property
    def _calling(self) -> DataFrame:
        return self._judged.where("action = 'call_llm'").select("task_id", "agent_id")

    @cached_property
    def messages(self) -> DataFrame:
        return prompt_rows(self._t, self._calling)

    @cached_property
    def tools(self) -> DataFrame:
        return self._calling.join(tool_catalogue(self._t), "agent_id").drop("agent_id")

    @cached_property
    def memory(self) -> DataFrame:
        if "query_vec" not in self._requests.columns:
            return self._requests.sparkSession.createDataFrame(
                [], "task_id bigint, rank int, memory_id bigint, content string, similarity double"
            )
        return memory_context(self._t, self._requests.select("task_id", "query_vec").join(self._calling, "task_id"), self._k)

    @cached_property
    def tables(self) -> Tables:
        return self._t.replace(tasks=self._tasks, execution_logs=self._logs, agent_events=self._events)

    def _tasks(self) -> DataFrame:
        now = instant(self._as_of)
        forced, hit = F.coalesce("forced", F.lit(False)), F.col("_hit")
        marks = self._judged.where("forced OR (status = 'pending' AND action = 'call_llm')").select(
            "task_id", "forced", _budget_text(F.col("max_steps")).alias("_text"), F.lit(True).alias("_hit")
        )
        changed = {
            "status": F.when(forced, "completed").when(hit, "running"),
            "output": F.when(forced, F.col("_text")),
            "heartbeat_at": F.when(hit, now),
            "updated_at": F.when(hit, now),
        }
        tasks = self._t.tasks
        return tasks.join(marks, "task_id", "left").select(
            *[F.coalesce(changed[c], F.col(c)).alias(c) if c in changed else F.col(c) for c in tasks.columns]
        )

    def _logs(self) -> DataFrame:
        steps = self._judged.where("forced").select(
            F.col("task_id").alias("seq"), "task_id", F.lit("assistant").alias("role"),
            _budget_text(F.col("max_steps")).alias("content"),
        )
        return self._t.execution_logs.unionByName(log_steps(self._t.execution_logs, steps, self._as_of))

    def _events(self) -> DataFrame:
        ended = self._judged.where("forced").select(
            F.col("task_id").alias("seq"), "agent_id", "session_id", "task_id",
            F.lit("task_end").alias("event_type"), json_object(forced=F.lit(True)).alias("payload"),
        )
        commands = _start_commands(self._judged).unionByName(ended)
        return self._t.agent_events.unionByName(log_events(self._t.agent_events, commands, self._as_of))


def next_actions(t: Tables, requests: DataFrame, as_of: str | Column, k: int = DEFAULT_K) -> Decisions:
    """Decide for requests (task_id[, query_vec]), at most one per task, all against the same snapshot.

    Prompts, tools and memories are rows that refer to the task; `decisions` carries their sizes. A task whose step budget is used up is completed with a fixed text; its session and
    its parent are left as they are.
    """
    return Decisions(t, requests, as_of, k)
