"""Task lifecycle: enqueueing, approvals, recovery, and the task and message listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsontext import json_object
from ..model import STALE_SECONDS, Principal, Tables
from .delta import Delete, Upsert, assign_ids, instant, log_events, patch, typed
from .views import last_sign_of_life, my_tasks

# Fixed value: the note of a rejection that gives none.
DEFAULT_REJECTION = "Rejected by human reviewer"


@dataclass(frozen=True)
class Outcome:
    """Accepted commands with what they produced, refused commands with the reason, and the new tables; where given, the same as
    changes for a store."""

    accepted: DataFrame
    rejects: DataFrame
    tables: Tables
    changes: Mapping[str, Sequence[Delete | Upsert]] = field(default_factory=dict)


def require(allowed: bool, what: str) -> None:
    if not allowed:
        raise PermissionError(f"{what}: privileged role required")


def _stripped(column: str) -> Column:
    """Text without white space of any kind at either end; empty for null."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def enqueue(t: Tables, requests: DataFrame, p: Principal, as_of: str | Column) -> Outcome:
    """Create tasks for requests (request_id, agent_role, task, session_id). Without a session a new one is opened."""
    now = instant(as_of)
    cleaned = requests.select(
        F.col("request_id").cast("long").alias("request_id"),
        _stripped("agent_role").alias("agent_role"),
        _stripped("task").alias("task"),
        F.col("session_id").cast("long").alias("asked_session"),
    )
    agents = t.agent_meta.where("is_active").select(F.col("role_name").alias("agent_role"), "agent_id")
    owners = t.sessions.select(F.col("session_id").alias("asked_session"), F.col("agent_id").alias("owner_id"))
    joined = cleaned.join(agents, "agent_role", "left").join(owners, "asked_session", "left")
    denied = F.lit(False) if p.privileged else F.col("agent_role") != p.name
    owned = F.coalesce(F.col("owner_id") == F.col("agent_id"), F.lit(False))
    reason = (
        F.when(F.col("agent_role") == "", "agent_role_required")
        .when(F.col("task") == "", "task_required")
        .when(denied, "permission_denied")
        .when(F.col("agent_id").isNull(), "agent_not_found")
        .when(F.col("asked_session").isNotNull() & ~owned, "session_of_other_agent")
    )
    judged = joined.withColumn("reason", reason)
    rejects = judged.where(F.col("reason").isNotNull()).select("request_id", "reason")
    ok = judged.where(F.col("reason").isNull()).select("request_id", "agent_id", "task", "asked_session")

    opened = assign_ids(ok.where(F.col("asked_session").isNull()), t.sessions, "session_id", "request_id")
    joined_to = ok.where(F.col("asked_session").isNotNull()).withColumn("session_id", F.col("asked_session"))
    tasks = assign_ids(opened.unionByName(joined_to), t.tasks, "task_id", "request_id")

    sessions = opened.select(
        "session_id", "agent_id", F.lit("active").alias("status"), F.col("task").alias("goal"), now.alias("started_at")
    )
    members = opened.select("session_id", "agent_id", now.alias("joined_at"))
    starts = opened.select(
        F.col("request_id").alias("seq"), "agent_id", "session_id", F.lit(None).cast("long").alias("task_id"),
        F.lit("session_start").alias("event_type"), json_object(goal=F.col("task")).alias("payload"),
    )
    rows = tasks.select(
        "task_id", "session_id", "agent_id", F.lit("pending").alias("status"), F.col("task").alias("input"),
        F.lit(0).alias("retry_count"), now.alias("created_at"), now.alias("updated_at"),
    )
    tables = t.replace(
        sessions=lambda: t.sessions.unionByName(typed(sessions, "sessions")),
        session_participants=lambda: t.session_participants.unionByName(typed(members, "session_participants")),
        tasks=lambda: t.tasks.unionByName(typed(rows, "tasks")),
        agent_events=lambda: t.agent_events.unionByName(log_events(t.agent_events, starts, as_of)),
    )
    return Outcome(tasks.select("request_id", "task_id", "session_id", "agent_id"), rejects, tables)


def resolve_approvals(t: Tables, decisions: DataFrame, p: Principal, as_of: str | Column) -> Outcome:
    """Apply decisions (approval_id, status, note), at most one per approval, in the order of the approval ids.

    An approved task that waits becomes pending. A rejected task fails, whatever its status; of several rejections the last one
    gives the text, and an approval cannot revive a failed task.
    """
    require(p.privileged, "resolve_approvals")
    now = instant(as_of)
    open_ = t.human_approvals.where("status = 'pending'").select(
        "approval_id", "task_id", "session_id", F.col("requested_by_agent_id").alias("agent_id")
    )
    judged = decisions.join(open_, "approval_id", "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False)), "bad_status").when(
            F.col("task_id").isNull(), "not_pending"
        ),
    )
    rejects = judged.where(F.col("reason").isNotNull()).select("approval_id", "reason")
    ok = judged.where(F.col("reason").isNull())
    accepted = ok.select("approval_id", "status", "task_id")

    resolved = ok.select(
        "approval_id", "status", F.lit(p.name).alias("resolved_by"), now.alias("resolved_at"),
        F.col("note").alias("resolution_note"),
    )
    refused = F.col("status") == "rejected"
    per_task = ok.groupBy("task_id").agg(
        F.max(F.when(refused, F.struct("approval_id", F.coalesce("note", F.lit(DEFAULT_REJECTION)).alias("text")))).alias("_no"),
        F.bool_or(~refused).alias("_yes"),
    )
    failed = F.col("_no").isNotNull()
    resumed = F.coalesce(F.col("_yes") & (F.col("status") == "waiting"), F.lit(False))
    changed = {
        "status": F.when(failed, "failed").when(resumed, "pending").otherwise(F.col("status")),
        "output": F.when(failed, F.col("_no.text")).otherwise(F.col("output")),
        "updated_at": F.when(failed | resumed, now).otherwise(F.col("updated_at")),
    }
    tasks = t.tasks.join(per_task, "task_id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in t.tasks.columns]
    )
    commands = ok.select(
        F.col("approval_id").alias("seq"), "agent_id", "session_id", "task_id",
        F.lit("approval_resolved").alias("event_type"),
        json_object(approval_id=F.col("approval_id"), status=F.col("status")).alias("payload"),
    )
    tables = t.replace(
        human_approvals=lambda: patch(t.human_approvals, resolved, "approval_id"),
        tasks=tasks,
        agent_events=lambda: t.agent_events.unionByName(log_events(t.agent_events, commands, as_of)),
    )
    return Outcome(accepted, rejects, tables)


def recover_stale(t: Tables, p: Principal, as_of: str | Column, seconds: int = STALE_SECONDS) -> Outcome:
    """Running tasks without a sign of life go back to pending, or fail when their retries are used up.

    Retries are unlimited for agents without a profile. The heartbeat is left as it is.
    """
    require(p.privileged, "recover_stale")
    now = instant(as_of)
    stale = (F.col("status") == "running") & (last_sign_of_life() < now - F.make_dt_interval(secs=F.lit(seconds)))
    profiles = t.agent_profiles.select("profile_id", "max_retries")
    assigned = t.agent_profile_assignments.select("role_name", "profile_id").join(profiles, "profile_id")
    limits = t.agent_meta.select("agent_id", "role_name").join(assigned, "role_name").select("agent_id", "max_retries")
    joined = t.tasks.join(limits, "agent_id", "left").withColumn("_stale", F.coalesce(stale, F.lit(False)))
    tries = F.col("retry_count") + 1
    hit = F.col("_stale")
    changed = {
        "status": F.when(hit & (tries > F.col("max_retries")), "failed").when(hit, "pending").otherwise(F.col("status")),
        "retry_count": F.when(hit, tries).otherwise(F.col("retry_count")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    columns = [changed[c].alias(c) if c in changed else F.col(c) for c in t.tasks.columns]
    recovered = joined.where(hit).select(*columns).select("task_id", "status", "retry_count")
    refused = recovered.where(F.lit(False)).select("task_id", F.lit(None).cast("string").alias("reason"))
    return Outcome(recovered, refused, t.replace(tasks=joined.select(*columns)))


def task_graph(t: Tables) -> DataFrame:
    """Tasks per session with the agent that works on them."""
    names = t.agent_meta.select("agent_id", F.col("role_name").alias("agent"))
    return t.tasks.join(names, "agent_id").select("session_id", "task_id", "agent", "status", "input").orderBy(
        "session_id", "task_id"
    )


def message_trace(t: Tables) -> DataFrame:
    """Messages with the names of sender and receiver."""
    names = t.agent_meta.select("agent_id", "role_name")
    senders = names.select(F.col("agent_id").alias("from_agent_id"), F.col("role_name").alias("sender"))
    receivers = names.select(F.col("agent_id").alias("to_agent_id"), F.col("role_name").alias("receiver"))
    return t.agent_messages.join(senders, "from_agent_id").join(receivers, "to_agent_id").select(
        "session_id", "message_id", "sender", "receiver", "direction", "status", "content"
    )


def latest_tasks(t: Tables, p: Principal, n: int = 3) -> DataFrame:
    """The newest n tasks the principal may see."""
    return my_tasks(t, p).orderBy(F.desc("created_at"), F.desc("task_id")).limit(n)


def latest_tasks_per_agent(t: Tables, n: int = 3) -> DataFrame:
    """The newest n tasks of every agent. All but n rows per agent and partition are dropped before the shuffle."""
    newest = Window.partitionBy("agent_id").orderBy(F.desc("created_at"), F.desc("task_id"))
    return (
        t.tasks.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= n)
        .select("agent_id", "rank", "task_id", "session_id", "status", "created_at")
    )
