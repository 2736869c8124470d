"""The 18 dashboard queries. `roles=None` selects all agents; time ranges include both ends; counters carry the time they hold for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import STALE_SECONDS, Tables
from ..operators.delta import instant
from ..operators.views import _event_rows, _profiled, stale_tasks, tool_stats

# Thresholds of the two coloured counters, highest first.
FAILED_LEVELS = ((5, "red"), (1, "yellow"))
STALE_LEVELS = ((1, "red"),)


def _count(df: DataFrame, as_of: str | Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("int").alias("value")).select(instant(as_of).alias("time"), "value")


def _level(value: str, levels: Sequence[tuple[int, str]]) -> Column:
    level = F.lit("green")
    for limit, colour in reversed(levels):
        level = F.when(F.col(value) >= limit, colour).otherwise(level)
    return level.alias("level")


def _agents(t: Tables, roles: Sequence[str] | None) -> DataFrame:
    agents = t.agent_meta.select("agent_id", "role_name")
    return agents if roles is None else agents.where(F.col("role_name").isin(list(roles)))


def _since(column: str, as_of: str | Column, hours: int) -> Column:
    return F.col(column) > instant(as_of) - F.make_dt_interval(hours=F.lit(hours))


def _within(column: str, start: str, end: str) -> Column:
    return F.col(column).between(instant(start), instant(end))


def active_sessions_count(t: Tables, as_of: str | Column) -> DataFrame:
    return _count(t.sessions.where("status = 'active'"), as_of)


def running_tasks_count(t: Tables, as_of: str | Column) -> DataFrame:
    return _count(t.tasks.where("status = 'running'"), as_of)


def waiting_tasks_count(t: Tables, as_of: str | Column) -> DataFrame:
    return _count(t.tasks.where(F.col("status").isin("waiting", "pending")), as_of)


def pending_approvals_count(t: Tables, as_of: str | Column) -> DataFrame:
    return _count(t.human_approvals.where("status = 'pending'"), as_of)


def failed_recent(t: Tables, as_of: str | Column, hours: int = 24) -> DataFrame:
    """Tasks failed lately, with the colour of the counter."""
    failed = t.tasks.where((F.col("status") == "failed") & _since("updated_at", as_of, hours))
    return _count(failed, as_of).select("time", "value", _level("value", FAILED_LEVELS))


def stale_count(t: Tables, as_of: str | Column, seconds: int = STALE_SECONDS) -> DataFrame:
    return _count(stale_tasks(t, as_of, seconds), as_of).select("time", "value", _level("value", STALE_LEVELS))


def task_throughput(t: Tables, start: str, end: str) -> DataFrame:
    """Tasks created per minute and status."""
    return (
        t.tasks.where(_within("created_at", start, end))
        .groupBy(F.date_trunc("minute", "created_at").alias("time"), "status")
        .agg(F.count(F.lit(1)).cast("int").alias("value"))
        .orderBy("time", "status")
    )


def tool_calls(t: Tables, start: str, end: str) -> DataFrame:
    """Tool calls per minute and tool. Counted per tool id first, so names meet only the counts."""
    counts = (
        t.tool_executions.where(_within("executed_at", start, end))
        .groupBy(F.date_trunc("minute", "executed_at").alias("time"), "tool_id")
        .agg(F.count(F.lit(1)).cast("int").alias("value"))
    )
    names = t.tool_registry.select("tool_id", F.col("name").alias("metric"))
    return counts.join(names, "tool_id").select("time", "metric", "value").orderBy("time", "metric")


def active_sessions(t: Tables, n: int = 50) -> DataFrame:
    """Newest active sessions."""
    names = t.agent_meta.select("agent_id", F.col("role_name").alias("agent"))
    return (
        t.sessions.where("status = 'active'")
        .join(names, "agent_id")
        .select("session_id", "agent", "goal", "status", "started_at")
        .orderBy(F.desc("started_at"), "session_id")
        .limit(n)
    )


def tool_stats_top(t: Tables, n: int = 50) -> DataFrame:
    return (
        tool_stats(t)
        .select("name", "tool_type", "total_calls", "error_count", "avg_duration_ms", "last_called_at")
        .orderBy(F.desc_nulls_last("total_calls"), "name")
        .limit(n)
    )


def recent_events(t: Tables, n: int = 100) -> DataFrame:
    return (
        _event_rows(t)
        .orderBy(F.desc("created_at"), "event_id")
        .limit(n)
        .select("created_at", F.col("role_name").alias("agent"), "event_type", "session_id", "task_id", "payload")
    )


def agent_names(t: Tables) -> DataFrame:
    return t.agent_meta.where("is_active").select("role_name").orderBy("role_name")


def agent_inventory(t: Tables, roles: Sequence[str] | None = None) -> DataFrame:
    agents = _profiled(t)
    if roles is not None:
        agents = agents.where(F.col("role_name").isin(list(roles)))
    return agents.select(
        "role_name", "display_name", "agent_role", "provider", "model_name", "max_steps", "is_active"
    ).orderBy("role_name")


def _completed_recent(t: Tables, as_of: str | Column, hours: int, roles: Sequence[str] | None) -> DataFrame:
    done = t.tasks.where((F.col("status") == "completed") & _since("updated_at", as_of, hours))
    return done.select("task_id", "agent_id").join(_agents(t, roles), "agent_id")


def completed_recent(
    t: Tables, as_of: str | Column, hours: int = 24, roles: Sequence[str] | None = None
) -> DataFrame:
    return _count(_completed_recent(t, as_of, hours, roles), as_of)


def avg_steps_per_task(
    t: Tables, as_of: str | Column, hours: int = 24, roles: Sequence[str] | None = None
) -> DataFrame:
    """Mean number of assistant log rows of recently completed tasks, tasks without any included; 0 without tasks."""
    steps = t.execution_logs.where("role = 'assistant'").groupBy("task_id").agg(F.count(F.lit(1)).alias("steps"))
    tasks = _completed_recent(t, as_of, hours, roles).join(steps, "task_id", "left")
    mean = F.avg(F.coalesce("steps", F.lit(0).cast("long")))
    return tasks.agg(F.coalesce(mean, F.lit(0.0)).alias("value")).select(instant(as_of).alias("time"), "value")


def tasks_per_agent(t: Tables, start: str, end: str, roles: Sequence[str] | None = None) -> DataFrame:
    """Completed tasks per hour and agent."""
    counts = (
        t.tasks.where((F.col("status") == "completed") & _within("updated_at", start, end))
        .groupBy(F.date_trunc("hour", "updated_at").alias("time"), "agent_id")
        .agg(F.count(F.lit(1)).cast("int").alias("value"))
    )
    return (
        counts.join(_agents(t, roles), "agent_id")
        .select("time", F.col("role_name").alias("metric"), "value")
        .orderBy("time", "metric")
    )


def tool_grants(t: Tables, roles: Sequence[str] | None = None) -> DataFrame:
    tools = t.tool_registry.select("tool_id", F.col("name").alias("tool"), "tool_type")
    return (
        t.agent_tool_permissions.join(_agents(t, roles), "agent_id")
        .join(tools, "tool_id")
        .select(F.col("role_name").alias("agent"), "tool", "tool_type", "granted_at")
        .orderBy("agent", "tool")
    )


def recent_failures(
    t: Tables, as_of: str | Column, days: int = 7, n: int = 50, roles: Sequence[str] | None = None
) -> DataFrame:
    failed = t.tasks.where((F.col("status") == "failed") & _since("updated_at", as_of, 24 * days))
    return (
        failed.join(_agents(t, roles), "agent_id")
        .orderBy(F.desc("updated_at"), "task_id")
        .limit(n)
        .select("task_id", F.col("role_name").alias("agent"), "input", F.col("output").alias("reason"), "updated_at")
    )
