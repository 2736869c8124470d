"""The 14 operational views and the listings. Each returns a frame over whole tables, scoped by an explicit principal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import json_object, parsed
from ..model import DEFAULT_COMPRESS_AFTER, STALE_SECONDS, Principal, Tables
from .delta import instant


def _names(t: Tables, *extra: str) -> DataFrame:
    return t.agent_meta.select("agent_id", "role_name", *extra)


def _scoped(df: DataFrame, allowed: bool, principal: Principal) -> DataFrame:
    """Everything for an allowed role, else the rows of the principal. The role test folds away at plan time."""
    return df if allowed else df.where(F.col("role_name") == principal.name)


def _profiled(t: Tables) -> DataFrame:
    """Agents with their profile and model settings; agents without an assignment drop out."""
    assignments = t.agent_profile_assignments.select("role_name", "profile_id", "llm_config_id")
    profiles = t.agent_profiles.select(
        "profile_id", "agent_role", "system_prompt", "max_steps", "max_retries"
    )
    models = t.llm_configs.drop("created_at")
    return t.agent_meta.join(assignments, "role_name").join(profiles, "profile_id").join(models, "llm_config_id")


def agent_context(t: Tables, p: Principal) -> DataFrame:
    """The principal's own active agent with its profile and model settings."""
    mine = t.agent_meta.where((F.col("role_name") == p.name) & F.col("is_active"))
    return _profiled(t.replace(agent_meta=mine)).select(
        "agent_id", "role_name", "display_name", "is_active",
        "profile_id", "agent_role", "system_prompt", "max_steps", "max_retries",
        "llm_config_id", "provider", "endpoint", "model_name",
        "api_key_ref", "temperature", "max_tokens", "request_options",
    )


def my_tasks(t: Tables, p: Principal) -> DataFrame:
    return _scoped(t.tasks.join(_names(t), "agent_id"), p.is_operator, p).select(
        "task_id", "session_id", "status", "input", "output",
        "retry_count", "heartbeat_at", "created_at", "updated_at",
    )


def my_memory(t: Tables, p: Principal) -> DataFrame:
    scoped = _scoped(t.memory.join(_names(t), "agent_id"), p.is_operator, p)
    return scoped.select("memory_id", "session_id", "content", "embedding", "embedding_dims", "created_at").orderBy(
        F.desc("created_at"), "memory_id"
    )


def my_tools(t: Tables, p: Principal) -> DataFrame:
    """Active tools granted to the principal. An operator sees one row per grant."""
    grants = _scoped(t.agent_tool_permissions.join(_names(t), "agent_id"), p.is_operator, p).select("tool_id")
    tools = t.tool_registry.where("is_active").select(
        "tool_id", "name", "description", "input_schema", "tool_type", "is_active"
    )
    return grants.join(tools, "tool_id").select(*tools.columns)


def session_progress(t: Tables, p: Principal) -> DataFrame:
    """Task counts per session; sessions without tasks are kept. Counts are formed before the join to the sessions."""
    status = F.col("status")
    counts = t.tasks.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(status == "completed").alias("completed_tasks"),
        F.count_if(status == "running").alias("running_tasks"),
        F.count_if(status.isin("failed", "cancelled")).alias("failed_tasks"),
    )
    sessions = t.sessions.join(_names(t, "display_name"), "agent_id")
    if not p.is_operator:
        me = t.agent_meta.where(F.col("role_name") == p.name).select("agent_id")
        shared = t.session_participants.join(me, "agent_id").select("session_id").distinct()
        sessions = sessions.join(shared.withColumn("_shared", F.lit(True)), "session_id", "left").where(
            (F.col("role_name") == p.name) | F.col("_shared")
        )
    zero = F.lit(0).cast("long")
    return sessions.join(counts, "session_id", "left").select(
        "session_id", "status", "goal", "started_at", "completed_at", "role_name", "display_name",
        *[F.coalesce(c, zero).alias(c) for c in counts.columns if c != "session_id"],
    )


def session_audit(t: Tables) -> DataFrame:
    """Sessions with their tasks and log rows, in reading order."""
    tasks = t.tasks.select(
        "task_id", "session_id", F.col("status").alias("task_status"),
        F.col("input").alias("task_input"), F.col("output").alias("task_output"),
    )
    logs = t.execution_logs.select(
        "task_id", "log_id", "step_number", F.col("role").alias("log_role"), F.col("content").alias("log_content"),
        "compressed_at", "compression_quality", F.col("created_at").alias("log_created_at"),
    )
    sessions = t.sessions.join(_names(t, "display_name"), "agent_id")
    joined = sessions.join(tasks, "session_id", "left").join(logs, "task_id", "left")
    return joined.select(
        "session_id", F.col("status").alias("session_status"), "goal", "final_answer", "started_at", "completed_at",
        "role_name", "display_name", "task_id", "task_status", "task_input", "task_output",
        "log_id", "step_number", "log_role", "log_content", "compressed_at", "compression_quality", "log_created_at",
    ).orderBy("session_id", F.asc_nulls_last("task_id"), F.asc_nulls_last("step_number"), "log_id")


def unmet_dependencies(t: Tables) -> DataFrame:
    """Edges whose prerequisite exists and is not completed."""
    states = t.tasks.where("status <> 'completed'").select(F.col("task_id").alias("depends_on_task_id"))
    return t.task_dependencies.join(states, "depends_on_task_id").select("task_id", "depends_on_task_id")


def ready_tasks(t: Tables, p: Principal) -> DataFrame:
    """Pending tasks all of whose prerequisites are completed."""
    pending = t.tasks.where("status = 'pending'").select(
        "task_id", "session_id", "agent_id", "status", "input", "created_at"
    )
    scoped = _scoped(pending.join(_names(t), "agent_id"), p.privileged, p)
    return scoped.join(unmet_dependencies(t), "task_id", "left_anti").select(
        *pending.columns, F.col("role_name").alias("agent_role_name")
    )


def pending_approvals(t: Tables) -> DataFrame:
    """Open approval requests, oldest first."""
    asked = t.human_approvals.where("status = 'pending'").select(
        "approval_id", "task_id", "session_id", "reason", "created_at", F.col("requested_by_agent_id").alias("agent_id")
    )
    tasks = t.tasks.select("task_id", F.col("input").alias("task_input"))
    goals = t.sessions.select("session_id", F.col("goal").alias("session_goal"))
    joined = asked.join(_names(t, "display_name"), "agent_id").join(tasks, "task_id").join(goals, "session_id")
    return joined.select(
        "approval_id", "task_id", "session_id", "reason", "created_at",
        F.col("role_name").alias("requested_by"), F.col("display_name").alias("requested_by_name"),
        "task_input", "session_goal",
    ).orderBy("created_at", "approval_id")


def tool_stats(t: Tables) -> DataFrame:
    """Calls, errors, mean duration and last call per tool; tools never called are kept.

    Executions are aggregated on their own key first: only one row per called tool meets the registry.
    """
    calls = t.tool_executions.groupBy("tool_id").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count("error").alias("error_count"),
        F.round(F.avg("duration_ms")).cast("int").alias("avg_duration_ms"),
        F.max("executed_at").alias("last_called_at"),
    )
    zero = F.lit(0).cast("long")
    tools = t.tool_registry.select("tool_id", "name", "tool_type", "is_active")
    return tools.join(calls, "tool_id", "left").select(
        *tools.columns,
        F.coalesce("total_calls", zero).alias("total_calls"),
        F.coalesce("error_count", zero).alias("error_count"),
        "avg_duration_ms",
        "last_called_at",
    )


def _event_rows(t: Tables) -> DataFrame:
    agents = t.agent_meta.select("agent_id", "role_name", "display_name", F.col("agent_id").alias("_known"))
    return t.agent_events.join(agents, "agent_id", "left").select(
        "event_id", "event_type", "payload", "created_at", "session_id", "task_id",
        F.col("_known").alias("agent_id"), "role_name", "display_name",
    )


def agent_events(t: Tables) -> DataFrame:
    """Events with agent names, newest first; events without an agent are kept."""
    return _event_rows(t).orderBy(F.desc("created_at"), "event_id")


def compress_threshold(t: Tables) -> Column:
    """Log rows a task needs before it is worth compressing: a setting of the compressor, else the default."""
    settings = t.system_agent_configs.where("agent_type = 'compressor'")
    value = F.try_variant_get(parsed(F.col("settings")), "$.compress_after_steps", "int")
    return F.coalesce(settings.agg(F.max(value)).scalar(), F.lit(DEFAULT_COMPRESS_AFTER))


def compressible_logs(t: Tables) -> DataFrame:
    """Finished tasks with enough log rows of which some are not compressed yet."""
    steps = t.execution_logs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(F.col("compressed_at").isNull()).alias("uncompressed_steps"),
        F.count("compressed_at").alias("compressed_steps"),
    )
    enough = steps.where((F.col("total_steps") >= compress_threshold(t)) & (F.col("uncompressed_steps") > 0))
    done = t.tasks.where(F.col("status").isin("completed", "failed")).select("task_id", "session_id")
    return done.join(enough, "task_id").select(
        "task_id", "session_id", "total_steps", "uncompressed_steps", "compressed_steps"
    )


def last_sign_of_life() -> Column:
    return F.coalesce("heartbeat_at", "updated_at")


def stale_tasks(t: Tables, as_of: str | Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Running tasks without a sign of life for more than `seconds`."""
    now, seen = instant(as_of), last_sign_of_life()
    limit = now - F.make_dt_interval(secs=F.lit(seconds))
    age = F.round(now.cast("double") - seen.cast("double")).cast("int")
    return t.tasks.where((F.col("status") == "running") & (seen < limit)).select(
        "task_id", "session_id", "agent_id", "status", "input",
        "heartbeat_at", "retry_count", "updated_at", age.alias("stale_seconds"),
    )


def active_dims(t: Tables) -> DataFrame:
    """Vector width of the active embedding model: one row, null when no model is active."""
    return t.embedding_config.where("is_active").agg(F.max("dimensions").alias("dimensions"))


def _reembedding(df: DataFrame, source: str, key: str, content: str, vector: str, dims: Column) -> DataFrame:
    stale = F.col(vector).isNull() | ~F.col("embedding_dims").eqNullSafe(dims)
    return df.where(dims.isNotNull() & stale).select(
        F.lit(source).alias("source"),
        F.col(key).cast("string").alias("row_id"),
        F.col(content).alias("content"),
        F.col("embedding_dims").alias("current_dims"),
    )


def reembedding_targets(t: Tables) -> DataFrame:
    """Memories and active tools whose vector is missing or has another width than the active model."""
    dims = active_dims(t).scalar()
    memory = _reembedding(t.memory, "memory", "memory_id", "content", "embedding", dims)
    tools = _reembedding(
        t.tool_registry.where("is_active"), "tool_registry", "tool_id", "description", "description_embedding", dims
    )
    return memory.union(tools)


def system_agents(t: Tables) -> DataFrame:
    """System agents with their next run and the size of their work list."""
    agents = t.agent_meta.select("role_name", "display_name", F.col("is_active").alias("agent_is_active"))
    backlog = {
        "compressor": compressible_logs(t).agg(F.count(F.lit(1))).scalar(),
        "embedder": reembedding_targets(t).agg(F.count(F.lit(1))).scalar(),
    }
    pending = F.lit(None).cast("long")
    for kind, count in backlog.items():
        pending = F.when(F.col("agent_type") == kind, count).otherwise(pending)
    return t.system_agent_configs.join(agents, "role_name", "left").select(
        "config_id", "agent_type", "is_enabled", "role_name", "display_name", "agent_is_active",
        "run_interval_secs", "settings", "last_run_at",
        (F.col("last_run_at") + F.make_dt_interval(secs=F.col("run_interval_secs"))).alias("next_run_at"),
        pending.alias("pending_targets"),
        "updated_at",
    )


def list_agents(t: Tables) -> DataFrame:
    """Agent inventory, oldest first."""
    return (
        _profiled(t)
        .select("agent_id", "role_name", "display_name", "agent_role", "provider", "model_name", "is_active",
                "created_at")
        .orderBy("created_at", "agent_id")
    )


def list_sessions(t: Tables, role: str | None = None) -> DataFrame:
    """Sessions, newest first, of one agent or of all."""
    names = _names(t) if role is None else _names(t).where(F.col("role_name") == role)
    return (
        t.sessions.join(names, "agent_id")
        .select("session_id", F.col("role_name").alias("agent_role"), "status", "goal", "started_at", "completed_at")
        .orderBy(F.desc("started_at"), "session_id")
    )


def session_documents(t: Tables) -> DataFrame:
    """The document of every session as rows: its header, then its tasks by id, then its participants.

    One JSON text per element instead of one nested value per session, so a session with very many tasks never has to fit
    one row or one task. The header carries the counts, hence empty lists are visible. Sorted, the rows of a session are its
    document in reading order.
    """
    tasks = t.tasks.groupBy("session_id").agg(F.count(F.lit(1)).alias("task_count"))
    members = t.session_participants.join(_names(t), "agent_id")
    people = members.groupBy("session_id").agg(F.count(F.lit(1)).alias("participant_count"))
    zero = F.lit(0).cast("long")
    heads = t.sessions.join(tasks, "session_id", "left").join(people, "session_id", "left")

    def rows(df: DataFrame, section: int, kind: str, key: str, fields: list[Column | str]) -> DataFrame:
        body = json_object(**{f if isinstance(f, str) else f[0]: F.col(f) if isinstance(f, str) else f[1] for f in fields})
        return df.select(
            "session_id", F.lit(section).alias("section_no"), F.lit(kind).alias("section"),
            F.col(key).alias("item_id"), body.alias("body"),
        )

    header = rows(
        heads.withColumns({c: F.coalesce(c, zero) for c in ("task_count", "participant_count")}),
        0, "session", "session_id", [*t.sessions.columns, "task_count", "participant_count"],
    )
    return header.unionByName(rows(t.tasks, 1, "task", "task_id", t.tasks.columns)).unionByName(
        rows(members, 2, "participant", "agent_id", ["role_name"])
    )
