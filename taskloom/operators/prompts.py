"""Prompt assembly.

The prompt of a task is: a system message, the (input, output) pairs of earlier completed tasks of its session, the results other
agents delivered to its agent in its session, then its own log. The second and third part are shared by many tasks, so written out
per task they grow with the square of a session. They are therefore kept once, as ordered message streams, and each task refers to
a prefix of the history stream and to one result stream:

    history_segment   one row per message and session, ordered by item_id; a task sees the rows with source_task_id < task_id
    subagent_segment  one row per message and (agent, session)
    log_segment       one row per message and task
    build_messages    one row per task: the references and the exact number of messages and characters of every part
    prompt_rows       the written-out prompts of requested tasks
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running
from ..model import Tables

# Fixed value: how a delivered result is introduced.
RESULT_PREFIX = "Subagent result from "


def _length(column: str) -> Column:
    return F.length(column).cast("long")


def _history_pairs(t: Tables) -> DataFrame:
    """Tasks that left a (user, assistant) pair behind."""
    return t.tasks.where((F.col("status") == "completed") & F.col("output").isNotNull()).select(
        "session_id", "task_id", "input", "output"
    )


def history_segment(t: Tables) -> DataFrame:
    """The history stream of every session."""
    pair = F.array(
        F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), F.col("input").alias("content")),
        F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), F.col("output").alias("content")),
    )
    return (
        _history_pairs(t)
        .select("session_id", F.col("task_id").alias("source_task_id"), F.explode(pair).alias("m"))
        .select("session_id", "source_task_id", (F.col("source_task_id") * 2 + F.col("m.half")).alias("item_id"),
                "m.role", "m.content")
    )


def _with_extent(tasks: DataFrame) -> DataFrame:
    left = (F.col("status") == "completed") & F.col("output").isNotNull()
    none = F.lit(0).cast("long")
    measures = {
        "history_messages": ("sum", F.when(left, F.lit(2).cast("long")).otherwise(none)),
        "history_chars": ("sum", F.when(left, F.col("input_chars") + _length("output")).otherwise(none)),
    }
    return running(tasks, ["session_id"], ["task_id"], measures)


def history_extent(t: Tables) -> DataFrame:
    """Messages and characters of history every task sees, by running totals over its session."""
    rows = t.tasks.select("task_id", "session_id", "status", _length("input").alias("input_chars"), "output")
    return _with_extent(rows).select("task_id", "history_messages", "history_chars")


def subagent_segment(t: Tables) -> DataFrame:
    """Delivered results per receiving agent and session, in order of arrival."""
    names = t.agent_meta.select(F.col("agent_id").alias("from_agent_id"), "display_name")
    results = t.agent_messages.where((F.col("direction") == "result") & (F.col("status") == "delivered"))
    return results.join(names, "from_agent_id").select(
        F.col("to_agent_id").alias("agent_id"),
        "session_id",
        "created_at",
        "message_id",
        F.lit("tool").alias("role"),
        F.concat(F.lit(RESULT_PREFIX), "display_name", F.lit(": "), "content").alias("content"),
    )


def log_segment(t: Tables) -> DataFrame:
    """A task's own conversation; the task input comes first (step 0) unless a user message is logged."""
    spoken = t.execution_logs.where(F.col("role").isin("user", "assistant", "tool")).select(
        "task_id", "step_number", "log_id", "role", "content"
    )
    asked = spoken.where("role = 'user'").select("task_id")
    opening = t.tasks.join(asked, "task_id", "left_anti").select(
        "task_id", F.lit(0).alias("step_number"), F.lit(None).cast("long").alias("log_id"),
        F.lit("user").alias("role"), F.col("input").alias("content"),
    )
    return opening.unionByName(spoken)


def system_prompts(t: Tables) -> DataFrame:
    """The system message of every agent; empty where the agent has no profile."""
    profiles = t.agent_profiles.select("profile_id", "system_prompt")
    assigned = t.agent_profile_assignments.select("role_name", "profile_id").join(profiles, "profile_id")
    return t.agent_meta.join(assigned, "role_name", "left").select(
        "agent_id", F.coalesce("system_prompt", F.lit("")).alias("system_prompt")
    )


def narrowed(t: Tables, asked: DataFrame) -> Tables:
    """The tables with only the logs of the asked tasks, and only the tasks and results of their sessions."""
    sessions = t.tasks.join(asked, "task_id", "left_semi").select("session_id").distinct()
    return t.replace(
        tasks=t.tasks.join(sessions, "session_id", "left_semi").select(*t.tasks.columns),
        execution_logs=t.execution_logs.join(asked, "task_id", "left_semi").select(*t.execution_logs.columns),
        agent_messages=t.agent_messages.join(sessions, "session_id", "left_semi").select(*t.agent_messages.columns),
    )


def prompt_sizes(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """`build_messages` with the state of the task and its assistant steps, from one pass over tasks and one over logs.

    With `asked` (task_id) only for these tasks, and nothing else than their sessions and logs is aggregated.
    """
    if asked is not None:
        return prompt_sizes(narrowed(t, asked)).join(asked, "task_id", "left_semi")
    none = F.lit(0).cast("long")
    results = subagent_segment(t).groupBy("agent_id", "session_id").agg(
        F.count(F.lit(1)).alias("result_messages"), F.sum(_length("content")).alias("result_chars")
    )
    # Logs are counted per task before the join; the counts also tell whether the opening message is needed.
    spoken = t.execution_logs.where(F.col("role").isin("user", "assistant", "tool"))
    logs = spoken.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("logged"),
        F.sum(_length("content")).alias("logged_chars"),
        F.count_if(F.col("role") == "user").alias("asked"),
        F.count_if(F.col("role") == "assistant").alias("taken"),
    )
    opening = F.coalesce("asked", none) == 0
    tasks = t.tasks.select("task_id", "session_id", "agent_id", "status", "output", _length("input").alias("input_chars"))
    joined = (
        _with_extent(tasks)
        .join(logs, "task_id", "left")
        .join(results, ["agent_id", "session_id"], "left")
        .join(system_prompts(t), "agent_id")
    )
    parts = joined.select(
        "task_id", "session_id", "agent_id", "status", "output", F.coalesce("taken", none).alias("steps"),
        "system_prompt", "history_messages", "history_chars",
        F.coalesce("result_messages", none).alias("result_messages"),
        F.coalesce("result_chars", none).alias("result_chars"),
        (F.coalesce("logged", none) + opening.cast("long")).alias("log_messages"),
        (F.coalesce("logged_chars", none) + F.when(opening, F.col("input_chars")).otherwise(none)).alias("log_chars"),
    )
    counts = ("history", "result", "log")
    return parts.withColumns(
        {
            "message_count": sum((F.col(f"{p}_messages") for p in counts), F.lit(1).cast("long")),
            "char_count": sum((F.col(f"{p}_chars") for p in counts), _length("system_prompt")),
        }
    )


def build_messages(t: Tables) -> DataFrame:
    """One row per task: what its prompt consists of and how long each part is."""
    return prompt_sizes(t).drop("status", "output", "steps")


def prompt_rows(t: Tables, requests: DataFrame) -> DataFrame:
    """The written-out prompts of the requested tasks (task_id): (task_id, part, position, tie, role, content).

    Rows that are ordered by (part, position, tie) within a task are its messages. Requests come first: only the sessions and logs of
    the tasks asked for are read, and the result is as long as their prompts.
    """
    asked = requests.select("task_id").distinct()
    t = narrowed(t, asked)
    wanted = t.tasks.join(asked, "task_id", "left_semi").select("task_id", "session_id", "agent_id")

    def rows(df: DataFrame, part: int, *position: Column) -> DataFrame:
        order = [*position, F.lit(0), F.lit(0)][:2]
        return df.select(
            "task_id", F.lit(part).alias("part"), order[0].cast("long").alias("position"),
            order[1].cast("long").alias("tie"), "role", "content",
        )

    system = wanted.join(system_prompts(t), "agent_id").select(
        "task_id", F.lit("system").alias("role"), F.col("system_prompt").alias("content")
    )
    history = wanted.join(history_segment(t), "session_id").where(F.col("source_task_id") < F.col("task_id"))
    results = wanted.join(subagent_segment(t), ["agent_id", "session_id"])
    logs = log_segment(t).join(asked, "task_id", "left_semi")
    return (
        rows(system, 0)
        .unionByName(rows(history, 1, F.col("item_id")))
        .unionByName(rows(results, 2, F.unix_micros("created_at"), F.col("message_id")))
        .unionByName(rows(logs, 3, F.col("step_number"), F.coalesce("log_id", F.lit(0))))
    )


def render_prompt(messages: DataFrame) -> DataFrame:
    """Replace role and content by the line `ROLE: content`.

    Ordered, and written as text with an empty line between records (`lineSep="\\n\\n"`), the lines of a task are its prompt.
    """
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    return messages.withColumn("line", line).drop("role", "content")
