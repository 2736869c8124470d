"""Every operator as a query over the driver tables, each with the SQL that must give the same rows.

Results are flat: structs are spread into columns and doubles rounded to six decimals. A query reads whole tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, export_vectors, ingest_vectors
from ..model import CHECKS, FOREIGN_KEYS, KEYS, OPERATOR, SCHEMAS, UNIQUES, Principal, Tables
from ..operators import decide, embed, guard, ingest, lifecycle, prompts, quality, registry, retention, search, views
from ..operators.delta import apply_delta, assign_ids, log_events, log_steps, typed
from ..session import configure, scratch_path
from ..sources.fixtures import AS_OF, AS_OF_EVENTS, command, from_driver_tables, live_tables, live_tool_calls, oracle_ctes
from ..sources.tables import load_tables, read_snapshot
from ..streaming import streams
from . import monitoring

AGENT = Principal("agent_3")
FROM, TO = "1990-01-01 00:00:00", "2030-01-01 00:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"
DAY = "INTERVAL '24' HOUR"


class Context:
    """The derived tables and command inputs of one data folder."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = configure(spark)
        self.directory = directory
        self.t: Tables = from_driver_tables(spark, directory)

    def command(self, name: str, live: bool = False) -> DataFrame:
        return command(self.spark, self.directory, name, live)

    def live(self) -> Tables:
        return live_tables(self.spark, self.directory)


Build = Callable[[Context], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(Context(spark, directory))


CATALOG: dict[str, Query] = {}


def _add(name: str, build: Build, needs: str = "", sql: str | None = None) -> None:
    """Register a query. `needs` names the derived tables its SQL reads; the SQL may open with further CTEs."""
    oracle = None
    if sql is not None:
        prefix = oracle_ctes(*needs.split()) if needs else ""
        joiner = ", " if sql.lstrip().startswith("WITH ") and prefix else " "
        oracle = prefix + joiner + (sql.lstrip().removeprefix("WITH ") if joiner == ", " else sql)
    CATALOG[name] = Query(build, oracle)


# ---------------------------------------------------------------- views

_CONTEXT = (
    "FROM agent_meta am JOIN agent_profile_assignments apa ON apa.role_name = am.role_name "
    "JOIN agent_profiles ap ON ap.profile_id = apa.profile_id JOIN llm_configs lc ON lc.llm_config_id = apa.llm_config_id"
)
_CONTEXT_NEEDS = "agent_meta agent_profile_assignments agent_profiles llm_configs"
_MY_TASKS = (
    "SELECT t.task_id, t.session_id, t.status, t.input, t.output, t.retry_count, t.heartbeat_at, t.created_at, t.updated_at "
    "FROM tasks t JOIN agent_meta am ON am.agent_id = t.agent_id"
)
_PROGRESS = (
    "SELECT s.session_id, s.status, s.goal, s.started_at, s.completed_at, am.role_name, am.display_name, "
    "count(t.task_id) AS total_tasks, count(t.task_id) FILTER (WHERE t.status = 'completed') AS completed_tasks, "
    "count(t.task_id) FILTER (WHERE t.status = 'running') AS running_tasks, "
    "count(t.task_id) FILTER (WHERE t.status IN ('failed', 'cancelled')) AS failed_tasks "
    "FROM sessions s JOIN agent_meta am ON am.agent_id = s.agent_id LEFT JOIN tasks t ON t.session_id = s.session_id "
    "{} GROUP BY ALL"
)
_READY = (
    "SELECT t.task_id, t.session_id, t.agent_id, t.status, t.input, t.created_at, am.role_name AS agent_role_name "
    "FROM tasks t JOIN agent_meta am ON am.agent_id = t.agent_id WHERE t.status = 'pending' {} AND NOT EXISTS "
    "(SELECT 1 FROM task_dependencies td JOIN tasks d ON d.task_id = td.depends_on_task_id "
    "WHERE td.task_id = t.task_id AND d.status <> 'completed')"
)
_STATS = (
    "SELECT t.tool_id, t.name, t.tool_type, t.is_active, count(te.exec_id) AS total_calls, count(te.error) AS error_count, "
    "CAST(round(avg(te.duration_ms)) AS INT) AS avg_duration_ms, max(te.executed_at) AS last_called_at "
    "FROM tool_registry t LEFT JOIN tool_executions te ON te.tool_id = t.tool_id GROUP BY ALL"
)
_COMPRESSIBLE = (
    "SELECT t.task_id, t.session_id, count(*) AS total_steps, count(*) FILTER (WHERE el.compressed_at IS NULL) "
    "AS uncompressed_steps, count(*) FILTER (WHERE el.compressed_at IS NOT NULL) AS compressed_steps "
    "FROM tasks t JOIN execution_logs el ON el.task_id = t.task_id WHERE t.status IN ('completed', 'failed') "
    "GROUP BY t.task_id, t.session_id HAVING count(*) >= 5 AND count(*) FILTER (WHERE el.compressed_at IS NULL) > 0"
)
_STALE = f"t.status = 'running' AND coalesce(t.heartbeat_at, t.updated_at) < {NOW} - INTERVAL '300' SECOND"


def _targets(width: int) -> str:
    return (
        "SELECT 'memory' AS source, CAST(memory_id AS VARCHAR) AS row_id, content, embedding_dims AS current_dims "
        f"FROM memory WHERE embedding IS NULL OR embedding_dims IS DISTINCT FROM {width} UNION ALL "
        "SELECT 'tool_registry', CAST(tool_id AS VARCHAR), description, embedding_dims FROM tool_registry "
        f"WHERE is_active AND (description_embedding IS NULL OR embedding_dims IS DISTINCT FROM {width})"
    )


_add(
    "agent_context", lambda c: views.agent_context(c.t, AGENT), _CONTEXT_NEEDS,
    "SELECT am.agent_id, am.role_name, am.display_name, am.is_active, ap.profile_id, ap.agent_role, ap.system_prompt, "
    "ap.max_steps, ap.max_retries, lc.llm_config_id, lc.provider, lc.endpoint, lc.model_name, lc.api_key_ref, lc.temperature, "
    f"lc.max_tokens, lc.request_options {_CONTEXT} WHERE am.role_name = 'agent_3' AND am.is_active",
)
_add("my_tasks", lambda c: views.my_tasks(c.t, OPERATOR), "tasks agent_meta", _MY_TASKS)
_add("my_tasks_of_agent", lambda c: views.my_tasks(c.t, AGENT), "tasks agent_meta",
     f"{_MY_TASKS} WHERE am.role_name = 'agent_3'")
_add(
    "my_memory",
    lambda c: views.my_memory(c.t, OPERATOR).withColumn("embedding", F.size("embedding")),
    "memory agent_meta",
    "SELECT m.memory_id, m.session_id, m.content, CAST(len(m.embedding) AS INT) AS embedding, m.embedding_dims, m.created_at "
    "FROM memory m JOIN agent_meta am ON am.agent_id = m.agent_id",
)
_add(
    "my_memory_of_agent",
    lambda c: views.my_memory(c.t, AGENT).withColumn("embedding", F.size("embedding")),
    "memory agent_meta",
    "SELECT m.memory_id, m.session_id, m.content, CAST(len(m.embedding) AS INT) AS embedding, m.embedding_dims, m.created_at "
    "FROM memory m JOIN agent_meta am ON am.agent_id = m.agent_id WHERE am.role_name = 'agent_3'",
)
_add(
    "my_tools_of_agent", lambda c: views.my_tools(c.t, AGENT), "tool_registry agent_tool_permissions agent_meta",
    "SELECT t.tool_id, t.name, t.description, t.input_schema, t.tool_type, t.is_active FROM tool_registry t JOIN agent_tool_permissions p "
    "ON p.tool_id = t.tool_id JOIN agent_meta am ON am.agent_id = p.agent_id WHERE t.is_active AND am.role_name = 'agent_3'",
)
_add("ready_tasks_of_agent", lambda c: views.ready_tasks(c.t, AGENT), "tasks agent_meta task_dependencies",
     _READY.format("AND am.role_name = 'agent_3'"))
_add(
    "my_tools", lambda c: views.my_tools(c.t, OPERATOR), "tool_registry agent_tool_permissions agent_meta",
    "SELECT t.tool_id, t.name, t.description, t.input_schema, t.tool_type, t.is_active FROM tool_registry t "
    "JOIN agent_tool_permissions p ON p.tool_id = t.tool_id JOIN agent_meta am ON am.agent_id = p.agent_id WHERE t.is_active",
)
_add("session_progress", lambda c: views.session_progress(c.t, OPERATOR), "sessions tasks agent_meta", _PROGRESS.format(""))
_add(
    "session_progress_of_agent", lambda c: views.session_progress(c.t, AGENT),
    "sessions tasks agent_meta session_participants",
    _PROGRESS.format(
        "WHERE am.role_name = 'agent_3' OR EXISTS (SELECT 1 FROM session_participants sp JOIN agent_meta a2 "
        "ON a2.agent_id = sp.agent_id WHERE sp.session_id = s.session_id AND a2.role_name = 'agent_3')"
    ),
)
_add(
    "session_audit", lambda c: views.session_audit(c.t), "sessions tasks agent_meta execution_logs",
    "SELECT s.session_id, s.status AS session_status, s.goal, s.final_answer, s.started_at, s.completed_at, am.role_name, "
    "am.display_name, t.task_id, t.status AS task_status, t.input AS task_input, t.output AS task_output, el.log_id, "
    "el.step_number, el.role AS log_role, el.content AS log_content, el.compressed_at, el.compression_quality, "
    "el.created_at AS log_created_at FROM sessions s JOIN agent_meta am ON am.agent_id = s.agent_id "
    "LEFT JOIN tasks t ON t.session_id = s.session_id LEFT JOIN execution_logs el ON el.task_id = t.task_id",
)
_add("ready_tasks", lambda c: views.ready_tasks(c.t, OPERATOR), "tasks agent_meta task_dependencies", _READY.format(""))
_add(
    "pending_approvals", lambda c: views.pending_approvals(c.t), "human_approvals agent_meta tasks sessions",
    "SELECT ha.approval_id, ha.task_id, ha.session_id, ha.reason, ha.created_at, am.role_name AS requested_by, "
    "am.display_name AS requested_by_name, t.input AS task_input, s.goal AS session_goal FROM human_approvals ha "
    "JOIN agent_meta am ON am.agent_id = ha.requested_by_agent_id JOIN tasks t ON t.task_id = ha.task_id "
    "JOIN sessions s ON s.session_id = ha.session_id WHERE ha.status = 'pending'",
)
_add("tool_stats", lambda c: views.tool_stats(c.t), "tool_registry tool_executions", _STATS)
_add(
    "agent_events", lambda c: views.agent_events(c.t), "agent_events agent_meta",
    "SELECT e.event_id, e.event_type, e.payload, e.created_at, e.session_id, e.task_id, am.agent_id, am.role_name, "
    "am.display_name FROM agent_events e LEFT JOIN agent_meta am ON am.agent_id = e.agent_id",
)
_add("compressible_logs", lambda c: views.compressible_logs(c.t), "tasks execution_logs", _COMPRESSIBLE)
_add(
    "stale_tasks", lambda c: views.stale_tasks(c.t, AS_OF), "tasks",
    "SELECT t.task_id, t.session_id, t.agent_id, t.status, t.input, t.heartbeat_at, t.retry_count, t.updated_at, "
    f"CAST(round(epoch({NOW}) - epoch(coalesce(t.heartbeat_at, t.updated_at))) AS INT) AS stale_seconds FROM tasks t WHERE {_STALE}",
)
_add("reembedding_targets", lambda c: views.reembedding_targets(c.t), "memory tool_registry", _targets(64))
_add(
    "system_agents", lambda c: views.system_agents(c.t),
    "system_agent_configs agent_meta tasks execution_logs memory tool_registry",
    "SELECT sc.config_id, sc.agent_type, sc.is_enabled, sc.role_name, am.display_name, am.is_active AS agent_is_active, "
    "sc.run_interval_secs, sc.settings, sc.last_run_at, sc.last_run_at + sc.run_interval_secs * INTERVAL '1' SECOND AS next_run_at, "
    f"CASE sc.agent_type WHEN 'compressor' THEN (SELECT count(*) FROM ({_COMPRESSIBLE})) "
    f"ELSE (SELECT count(*) FROM ({_targets(64)})) END AS pending_targets, sc.updated_at "
    "FROM system_agent_configs sc LEFT JOIN agent_meta am ON am.role_name = sc.role_name",
)

# ---------------------------------------------------------------- listings

_JSON_TS = "strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"


def _json(table: str, *columns: str) -> str:
    parts = []
    for column in columns:
        value = _JSON_TS.format(column) if column.endswith("_at") else column
        parts.append(f"'{column}', {value}")
    return f"CAST(json_object({', '.join(parts)}) AS VARCHAR)"


_add(
    "list_agents", lambda c: views.list_agents(c.t), _CONTEXT_NEEDS,
    f"SELECT am.agent_id, am.role_name, am.display_name, ap.agent_role, lc.provider, lc.model_name, am.is_active, am.created_at {_CONTEXT}",
)
_add(
    "list_sessions", lambda c: views.list_sessions(c.t), "sessions agent_meta",
    "SELECT s.session_id, am.role_name AS agent_role, s.status, s.goal, s.started_at, s.completed_at FROM sessions s "
    "JOIN agent_meta am ON am.agent_id = s.agent_id",
)
_add(
    "list_sessions_of_role", lambda c: views.list_sessions(c.t, AGENT.name), "sessions agent_meta",
    "SELECT s.session_id, am.role_name AS agent_role, s.status, s.goal, s.started_at, s.completed_at FROM sessions s "
    f"JOIN agent_meta am ON am.agent_id = s.agent_id WHERE am.role_name = '{AGENT.name}'",
)
_add(
    "session_documents", lambda c: views.session_documents(c.t), "sessions tasks session_participants agent_meta",
    "WITH h AS (SELECT s.*, (SELECT count(*) FROM tasks t WHERE t.session_id = s.session_id) AS task_count, "
    "(SELECT count(*) FROM session_participants p WHERE p.session_id = s.session_id) AS participant_count FROM sessions s) "
    "SELECT session_id, 0 AS section_no, 'session' AS section, session_id AS item_id, "
    + _json("h", "session_id", "agent_id", "status", "goal", "final_answer", "started_at", "completed_at", "task_count",
            "participant_count")
    + " AS body FROM h UNION ALL SELECT session_id, 1, 'task', task_id, "
    + _json("t", "task_id", "session_id", "agent_id", "status", "input", "output", "retry_count", "heartbeat_at", "created_at",
            "updated_at")
    + " FROM tasks UNION ALL SELECT p.session_id, 2, 'participant', p.agent_id, CAST(json_object('role_name', am.role_name) AS VARCHAR) "
    "FROM session_participants p JOIN agent_meta am ON am.agent_id = p.agent_id",
)

# ---------------------------------------------------------------- vectors

_COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST(q.query_vec AS DOUBLE[]))"
_MEMORY_HITS = (
    f"WITH hits AS (SELECT q.query_id, m.memory_id, m.content, m.created_at, {_COSINE.format('m.embedding')} AS s "
    "FROM search_queries q JOIN memory m ON m.agent_id = q.agent_id WHERE m.embedding IS NOT NULL AND m.embedding_dims = 64), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, memory_id) AS rank FROM hits) "
)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_add(
    "cosine_similarity",
    lambda c: c.t.memory.where("embedding IS NOT NULL").join(c.command("search_queries"), "agent_id").select(
        "memory_id", F.round(cosine_similarity(F.col("embedding"), F.col("query_vec")), 6).alias("similarity")
    ),
    "memory search_queries",
    f"SELECT m.memory_id, round({_COSINE.format('m.embedding')}, 6) AS similarity FROM memory m "
    "JOIN search_queries q ON q.agent_id = m.agent_id WHERE m.embedding IS NOT NULL",
)
_add(
    "search_memory", lambda c: _rounded(search.search_memory(c.t, c.command("search_queries")), "similarity"),
    "memory search_queries",
    f"{_MEMORY_HITS} SELECT query_id, CAST(rank AS INT) AS rank, memory_id, content, round(s, 6) AS similarity, created_at "
    "FROM ranked WHERE rank <= 5",
)
_add(
    "search_memory_blocks",
    lambda c: _rounded(search.search_memory(c.t, c.command("search_queries"), broadcast_components=64 * 16), "similarity"),
    "memory search_queries",
    f"{_MEMORY_HITS} SELECT query_id, CAST(rank AS INT) AS rank, memory_id, content, round(s, 6) AS similarity, created_at "
    "FROM ranked WHERE rank <= 5",
)
_add(
    "search_tools", lambda c: _rounded(search.search_tools(c.t, c.command("search_queries")), "similarity"),
    "tool_registry agent_tool_permissions search_queries",
    f"WITH hits AS (SELECT q.query_id, t.*, {_COSINE.format('t.description_embedding')} AS s FROM search_queries q "
    "JOIN agent_tool_permissions p ON p.agent_id = q.agent_id JOIN tool_registry t ON t.tool_id = p.tool_id "
    "WHERE t.is_active AND t.description_embedding IS NOT NULL AND t.embedding_dims = 64), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, tool_id) AS rank FROM hits) "
    "SELECT query_id, CAST(rank AS INT) AS rank, tool_id, name, description, input_schema, tool_type, round(s, 6) AS similarity "
    "FROM ranked WHERE rank <= 5",
)
CATALOG["search_tools_blocks"] = Query(
    lambda c: _rounded(search.search_tools(c.t, c.command("search_queries"), broadcast_components=64 * 16), "similarity"), CATALOG["search_tools"].oracle
)
_add(
    "ingest_vectors",
    lambda c: ingest_vectors(c.command("vector_payloads"))[0].select(
        "item_id", "embedding_dims",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"),
    ),
    "",
    "SELECT vec_id AS item_id, CAST(len(embedding) AS INT) AS embedding_dims, "
    "round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id % 6 < 3",
)
_add("ingest_vectors_rejects", lambda c: ingest_vectors(c.command("vector_payloads"))[1], "vector_payloads",
     "SELECT item_id, payload FROM vector_payloads WHERE item_id % 6 >= 3")
_add(
    "export_vectors", lambda c: export_vectors(c.t.memory.select("memory_id", "embedding")), "memory",
    "SELECT memory_id, CASE WHEN embedding IS NOT NULL THEN '[' || array_to_string(list_transform(embedding, "
    "lambda x: printf('%.8f', CAST(x AS DOUBLE))), ',') || ']' END AS literal FROM memory",
)

# ---------------------------------------------------------------- prompts

_HISTORY = "status = 'completed' AND output IS NOT NULL"
_RESULTS = (
    "SELECT mm.to_agent_id AS agent_id, mm.session_id, mm.created_at, mm.message_id, 'tool' AS role, "
    "'Subagent result from ' || am.display_name || ': ' || mm.content AS content FROM agent_messages mm "
    "JOIN agent_meta am ON am.agent_id = mm.from_agent_id WHERE mm.direction = 'result' AND mm.status = 'delivered'"
)
_LOGS = (
    "SELECT t.task_id, 0 AS step_number, CAST(NULL AS BIGINT) AS log_id, 'user' AS role, t.input AS content FROM tasks t "
    "WHERE NOT EXISTS (SELECT 1 FROM execution_logs el WHERE el.task_id = t.task_id AND el.role = 'user') UNION ALL "
    "SELECT task_id, step_number, log_id, role, content FROM execution_logs WHERE role IN ('user', 'assistant', 'tool')"
)
_EXTENT = (
    "SELECT t.task_id, CAST(count(p.task_id) * 2 AS BIGINT) AS history_messages, "
    "CAST(coalesce(sum(length(p.input) + length(p.output)), 0) AS BIGINT) AS history_chars FROM tasks t LEFT JOIN "
    f"(SELECT * FROM tasks WHERE {_HISTORY}) p ON p.session_id = t.session_id AND p.task_id < t.task_id GROUP BY t.task_id"
)
_SYSTEM = (
    "SELECT am.agent_id, coalesce(ap.system_prompt, '') AS system_prompt FROM agent_meta am "
    "LEFT JOIN agent_profile_assignments apa ON apa.role_name = am.role_name "
    "LEFT JOIN agent_profiles ap ON ap.profile_id = apa.profile_id"
)
_PROMPT_NEEDS = "tasks execution_logs agent_messages agent_meta agent_profile_assignments agent_profiles"
_PARTS = (
    f"WITH h AS ({_EXTENT}), r AS (SELECT agent_id, session_id, count(*) AS n, sum(length(content)) AS chars FROM ({_RESULTS}) "
    f"GROUP BY ALL), l AS (SELECT task_id, count(*) AS n, sum(length(content)) AS chars FROM ({_LOGS}) GROUP BY ALL), "
    f"s AS ({_SYSTEM}), parts AS (SELECT t.task_id, t.session_id, t.agent_id, s.system_prompt, h.history_messages, h.history_chars, "
    "CAST(coalesce(r.n, 0) AS BIGINT) AS result_messages, CAST(coalesce(r.chars, 0) AS BIGINT) AS result_chars, "
    "CAST(coalesce(l.n, 0) AS BIGINT) AS log_messages, CAST(coalesce(l.chars, 0) AS BIGINT) AS log_chars FROM tasks t "
    "JOIN h ON h.task_id = t.task_id JOIN s ON s.agent_id = t.agent_id LEFT JOIN l ON l.task_id = t.task_id "
    "LEFT JOIN r ON r.agent_id = t.agent_id AND r.session_id = t.session_id), built AS (SELECT *, "
    "1 + history_messages + result_messages + log_messages AS message_count, "
    "length(system_prompt) + history_chars + result_chars + log_chars AS char_count FROM parts) "
)

_HISTORY_ROWS = (
    f"SELECT session_id, task_id AS source_task_id, task_id * 2 AS item_id, 'user' AS role, input AS content FROM tasks "
    f"WHERE {_HISTORY} UNION ALL SELECT session_id, task_id, task_id * 2 + 1, 'assistant', output FROM tasks WHERE {_HISTORY}"
)
_add("history_segment", lambda c: prompts.history_segment(c.t), "tasks", _HISTORY_ROWS)
_add("history_extent", lambda c: prompts.history_extent(c.t), "tasks", _EXTENT)
_add("subagent_segment", lambda c: prompts.subagent_segment(c.t), "agent_messages agent_meta", _RESULTS)
_add("log_segment", lambda c: prompts.log_segment(c.t), "tasks execution_logs", _LOGS)
_add("build_messages", lambda c: prompts.build_messages(c.t), _PROMPT_NEEDS, f"{_PARTS} SELECT * FROM built")
_WRITTEN = (
    f"SELECT a.task_id, 0 AS part, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS tie, 'system' AS role, s.system_prompt AS content "
    f"FROM asked a JOIN ({_SYSTEM}) s ON s.agent_id = a.agent_id UNION ALL "
    f"SELECT a.task_id, 1, h.item_id, 0, h.role, h.content FROM asked a JOIN ({_HISTORY_ROWS}) h ON h.session_id = a.session_id "
    f"AND h.source_task_id < a.task_id UNION ALL SELECT a.task_id, 2, epoch_us(r.created_at), r.message_id, r.role, r.content "
    f"FROM asked a JOIN ({_RESULTS}) r ON r.agent_id = a.agent_id AND r.session_id = a.session_id UNION ALL "
    f"SELECT l.task_id, 3, l.step_number, coalesce(l.log_id, 0), l.role, l.content FROM ({_LOGS}) l JOIN asked a ON a.task_id = l.task_id"
)
_add(
    "prompt_rows", lambda c: prompts.prompt_rows(c.t, views.ready_tasks(c.t, OPERATOR)), f"{_PROMPT_NEEDS} task_dependencies",
    f"WITH asked AS ({_READY.format('')}) {_WRITTEN}",
)
_add(
    "render_prompt",
    lambda c: prompts.render_prompt(prompts.prompt_rows(c.t, views.ready_tasks(c.t, OPERATOR))), f"{_PROMPT_NEEDS} task_dependencies",
    f"WITH asked AS ({_READY.format('')}) SELECT task_id, part, position, tie, upper(role) || ': ' || content AS line FROM ({_WRITTEN})",
)
_add(
    "render_log", lambda c: prompts.render_prompt(prompts.log_segment(c.t)), "tasks execution_logs",
    f"SELECT task_id, step_number, log_id, upper(role) || ': ' || content AS line FROM ({_LOGS})",
)

# ---------------------------------------------------------------- decisions

_LIVE = "status NOT IN ('completed', 'failed', 'cancelled')"
_PENDING = (
    "SELECT td.task_id, td.depends_on_task_id AS pending_task_id FROM task_dependencies td "
    f"JOIN tasks d ON d.task_id = td.depends_on_task_id WHERE d.{_LIVE}"
)
_BUDGET = (
    "SELECT t.task_id, count(el.log_id) AS steps, ap.max_steps, coalesce(count(el.log_id) >= ap.max_steps, FALSE) AS exhausted "
    "FROM tasks t JOIN agent_meta am ON am.agent_id = t.agent_id "
    "LEFT JOIN agent_profile_assignments apa ON apa.role_name = am.role_name "
    "LEFT JOIN agent_profiles ap ON ap.profile_id = apa.profile_id "
    "LEFT JOIN execution_logs el ON el.task_id = t.task_id AND el.role = 'assistant' GROUP BY t.task_id, ap.max_steps"
)
_CATALOGUE = (
    "SELECT p.agent_id, t.name, t.description, t.input_schema, t.tool_type FROM agent_tool_permissions p "
    "JOIN tool_registry t ON t.tool_id = p.tool_id WHERE t.is_active"
)
_BUDGET_NEEDS = "tasks agent_meta agent_profile_assignments agent_profiles execution_logs"
_JUDGED = (
    f"WITH budget AS ({_BUDGET}), judged AS (SELECT t.*, b.steps, b.max_steps, CASE WHEN t.status IN "
    "('completed', 'failed', 'cancelled') THEN 'done' WHEN t.status = 'waiting' THEN 'wait_tasks' WHEN b.exhausted THEN 'done' "
    "ELSE 'call_llm' END AS action, t.status IN ('pending', 'running') AND b.exhausted AS forced "
    "FROM tasks t JOIN budget b ON b.task_id = t.task_id) "
)
_MAX_STEPS = "'Max steps (' || max_steps || ') reached.'"


def _decisions(c: Context) -> decide.Decisions:
    return decide.next_actions(c.t, c.t.tasks.select("task_id"), AS_OF)


_add("pending_dependencies", lambda c: decide.pending_dependencies(c.t), "tasks task_dependencies", _PENDING)
_add("step_budget", lambda c: decide.step_budget(c.t), _BUDGET_NEEDS, _BUDGET)
_add(
    "llm_config_envelope", lambda c: decide.llm_config_envelope(c.t).select("agent_id", "llm_config.*"),
    "agent_meta agent_profile_assignments llm_configs",
    "SELECT am.agent_id, lc.provider, lc.endpoint, lc.model_name, lc.api_key_ref, lc.temperature, lc.max_tokens, "
    "lc.request_options FROM llm_configs lc JOIN agent_profile_assignments apa ON apa.llm_config_id = lc.llm_config_id "
    "JOIN agent_meta am ON am.role_name = apa.role_name",
)
_add("tool_catalogue", lambda c: decide.tool_catalogue(c.t), "agent_tool_permissions tool_registry", _CATALOGUE)
_add(
    "memory_context",
    lambda c: _rounded(
        decide.memory_context(c.t, c.command("search_queries").withColumnRenamed("query_id", "task_id")), "similarity"
    ),
    "memory search_queries",
    f"{_MEMORY_HITS} SELECT query_id AS task_id, CAST(rank AS INT) AS rank, memory_id, content, round(s, 6) AS similarity "
    "FROM ranked WHERE rank <= 5",
)
_add(
    "task_start_events", lambda c: decide.task_start_events(c.t, c.t.tasks).drop("seq"), _BUDGET_NEEDS,
    f"{_JUDGED} SELECT agent_id, session_id, task_id, 'task_start' AS event_type, CAST(json_object('input', input) AS VARCHAR) "
    "AS payload FROM judged WHERE action = 'call_llm' AND steps = 0",
)
_add(
    "next_actions",
    lambda c: _decisions(c).decisions.select(
        "*", F.col("llm_config.provider").alias("provider"), F.col("llm_config.model_name").alias("model_name")
    ).drop("llm_config"),
    f"{_PROMPT_NEEDS} task_dependencies llm_configs agent_tool_permissions tool_registry",
    _JUDGED
    + ", " + _PARTS.removeprefix("WITH ").rstrip()
    + f", waits AS (SELECT task_id, count(*) AS n FROM ({_PENDING}) GROUP BY ALL), "
    f"tools AS (SELECT agent_id, count(*) AS n FROM ({_CATALOGUE}) GROUP BY ALL), "
    "models AS (SELECT am.agent_id, lc.provider, lc.model_name FROM llm_configs lc JOIN agent_profile_assignments apa "
    "ON apa.llm_config_id = lc.llm_config_id JOIN agent_meta am ON am.role_name = apa.role_name) "
    "SELECT j.task_id, j.agent_id, j.session_id, j.action, CASE WHEN j.action = 'done' AND NOT j.forced THEN j.output END AS output, "
    "j.forced, CASE WHEN j.action = 'wait_tasks' THEN coalesce(w.n, 0) END AS pending_count, "
    + ", ".join(
        f"CASE WHEN j.action = 'call_llm' THEN b.{x} END AS {x}"
        for x in ("history_messages", "result_messages", "log_messages", "message_count")
    )
    + ", CASE WHEN j.action = 'call_llm' THEN coalesce(tools.n, 0) END AS tool_count, "
    "CASE WHEN j.action = 'call_llm' THEN m.provider END AS provider, CASE WHEN j.action = 'call_llm' THEN m.model_name END AS model_name "
    "FROM judged j LEFT JOIN built b ON b.task_id = j.task_id LEFT JOIN waits w ON w.task_id = j.task_id "
    "LEFT JOIN tools ON tools.agent_id = j.agent_id LEFT JOIN models m ON m.agent_id = j.agent_id",
)
_add(
    "next_actions_rejects",
    lambda c: decide.next_actions(
        c.t, c.command("enqueue_requests").select((F.col("request_id") * 20).alias("task_id")), AS_OF
    ).rejects,
    "enqueue_requests tasks",
    "SELECT r.request_id * 20 AS task_id, 'unknown_task' AS reason FROM enqueue_requests r "
    "WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_id = r.request_id * 20)",
)
_add(
    "next_actions_messages", lambda c: _decisions(c).messages, f"{_PROMPT_NEEDS}",
    f"{_JUDGED}, asked AS (SELECT * FROM judged WHERE action = 'call_llm') {_WRITTEN}",
)
_add(
    "next_actions_tools", lambda c: _decisions(c).tools, f"{_BUDGET_NEEDS} agent_tool_permissions tool_registry",
    f"{_JUDGED} SELECT j.task_id, k.name, k.description, k.input_schema, k.tool_type FROM judged j JOIN ({_CATALOGUE}) k "
    "ON k.agent_id = j.agent_id WHERE j.action = 'call_llm'",
)


def _with_vectors(c: Context) -> decide.Decisions:
    """Every task asks with the mean vector of its agent."""
    centres = c.command("search_queries").select("agent_id", "query_vec")
    return decide.next_actions(c.t, c.t.tasks.select("task_id", "agent_id").join(centres, "agent_id").select("task_id", "query_vec"), AS_OF)


_add(
    "next_actions_memory", lambda c: _rounded(_with_vectors(c).memory, "similarity"), f"{_BUDGET_NEEDS} memory search_queries",
    f"{_MEMORY_HITS}, " + _JUDGED.removeprefix("WITH ")
    + "SELECT j.task_id, CAST(r.rank AS INT) AS rank, r.memory_id, r.content, round(r.s, 6) AS similarity FROM judged j "
    "JOIN ranked r ON r.query_id = j.agent_id WHERE j.action = 'call_llm' AND r.rank <= 5",
)
_add(
    "next_actions_tasks",
    lambda c: _decisions(c).tables.tasks.select("task_id", "status", "output", "heartbeat_at", "updated_at"),
    _BUDGET_NEEDS,
    f"{_JUDGED} SELECT task_id, CASE WHEN forced THEN 'completed' WHEN action = 'call_llm' THEN 'running' ELSE status END AS status, "
    f"CASE WHEN forced THEN {_MAX_STEPS} ELSE output END AS output, "
    f"CASE WHEN forced OR (action = 'call_llm' AND status = 'pending') THEN {NOW} ELSE heartbeat_at END AS heartbeat_at, "
    f"CASE WHEN forced OR (action = 'call_llm' AND status = 'pending') THEN {NOW} ELSE updated_at END AS updated_at FROM judged",
)
_add(
    "next_actions_logs",
    lambda c: _decisions(c).tables.execution_logs.groupBy("task_id").agg(
        F.count("*").alias("n"), F.max("step_number").alias("last_step"), F.max_by("content", "step_number").alias("last")
    ),
    _BUDGET_NEEDS,
    f"{_JUDGED}, logs AS (SELECT task_id, step_number, content FROM execution_logs UNION ALL SELECT j.task_id, "
    f"coalesce((SELECT max(step_number) FROM execution_logs e WHERE e.task_id = j.task_id), 0) + 1, {_MAX_STEPS} "
    "FROM judged j WHERE forced) SELECT task_id, count(*) AS n, CAST(max(step_number) AS INT) AS last_step, "
    "arg_max(content, step_number) AS last FROM logs GROUP BY task_id",
)

# ---------------------------------------------------------------- ingestion

_NOT_TERMINAL = "NOT IN ('completed', 'failed', 'cancelled')"
_INGEST_NEEDS = (
    "responses tasks agent_messages tool_registry agent_tool_permissions agent_meta task_dependencies execution_logs "
    "human_approvals sessions session_participants agent_events tool_executions"
)
_PARSED = (
    "parsed AS (SELECT *, NOT is_final AND json_valid(response) AS ok, "
    "CASE WHEN NOT is_final AND json_valid(response) THEN response ELSE '{}' END AS body FROM responses), "
    "fields AS (SELECT seq, task_id, response, is_final, ok, "
    "CASE WHEN is_final THEN NULL WHEN ok THEN json_extract_string(body, '$.action') ELSE 'finish' END AS action, "
    "CASE WHEN ok THEN json_extract_string(body, '$.final_answer') ELSE response END AS final_answer, "
    "json_extract_string(body, '$.tool_name') AS tool_name, "
    "CASE WHEN ok THEN coalesce(CAST(json_extract(body, '$.args') AS VARCHAR), '{}') END AS args, "
    "json_extract_string(body, '$.to_agent') AS to_agent, json_extract_string(body, '$.task') AS sub_task, "
    "json_extract_string(body, '$.reason') AS reason FROM parsed)"
)
# One row per response, with everything that does not depend on other responses (`kind`), then the moves of tasks over `seq`.
_CLASSIFIED = (
    f"WITH {_PARSED}, parents AS (SELECT child_task_id, arg_min(from_agent_id, message_id) AS p_agent, "
    "arg_min(parent_task_id, message_id) AS p_task FROM agent_messages WHERE direction = 'instruction' GROUP BY 1), "
    "c AS (SELECT f.*, t.session_id, t.agent_id, t.status AS base_status, p.p_agent, p.p_task, tool.tool_id, tool.tool_type, "
    "tool.name AS tool_found, am.agent_id AS to_agent_id, CASE WHEN f.is_final THEN 'forced' WHEN f.action = 'finish' THEN 'finish' "
    "WHEN f.action = 'call_tool' AND tool.tool_id IS NULL THEN 'tool_error' WHEN f.action = 'call_tool' AND tool.tool_type = 'sql' "
    "THEN 'tool_sql' WHEN f.action = 'call_tool' THEN 'tool_invoke' WHEN f.action = 'delegate' AND am.agent_id IS NULL "
    "THEN 'delegate_error' WHEN f.action = 'delegate' THEN 'delegate' WHEN f.action = 'request_approval' THEN 'approval' "
    "ELSE 'continue' END AS kind, CASE WHEN f.is_final THEN f.response WHEN f.action = 'finish' THEN f.final_answer END AS answer "
    "FROM fields f JOIN tasks t ON t.task_id = f.task_id LEFT JOIN parents p ON p.child_task_id = f.task_id "
    "LEFT JOIN (SELECT r.*, g.agent_id AS g_agent FROM tool_registry r JOIN agent_tool_permissions g ON g.tool_id = r.tool_id "
    "WHERE r.is_active) tool ON f.action = 'call_tool' AND tool.name = f.tool_name AND tool.g_agent = t.agent_id "
    "LEFT JOIN agent_meta am ON f.action = 'delegate' AND am.role_name = f.to_agent AND am.is_active), "
    "noted AS (SELECT *, CASE kind WHEN 'tool_error' THEN 'TOOL ERROR: tool not found or not permitted: ' || tool_name "
    "WHEN 'tool_sql' THEN 'SQL ERROR: fn_execute_sql: cannot parse FROM clause' "
    "WHEN 'delegate_error' THEN 'DELEGATE ERROR: agent not found: ' || to_agent END AS note FROM c), "
    "moves AS (SELECT *, CASE WHEN kind IN ('forced', 'finish') THEN 'completed' ELSE 'waiting' END AS new_status FROM c "
    "WHERE kind IN ('forced', 'finish', 'delegate', 'approval')), "
    "children AS (SELECT *, (SELECT max(task_id) FROM tasks) + row_number() OVER (ORDER BY seq) AS child_id FROM c "
    "WHERE kind = 'delegate'), "
    "approvals AS (SELECT *, (SELECT max(approval_id) FROM human_approvals) + row_number() OVER (ORDER BY seq) AS approval_id "
    "FROM c WHERE kind = 'approval'), "
    # state of task x at the time of response f: its last move so far, else its status before the batch
    "states AS (SELECT f.seq, x.task_id, x.session_id, coalesce((SELECT arg_max(m.new_status, m.seq) FROM moves m "
    "WHERE m.task_id = x.task_id AND m.seq <= f.seq), x.status) AS status FROM c f JOIN tasks x ON x.session_id = f.session_id "
    "WHERE f.kind = 'finish'), "
    "closed AS (SELECT f.* FROM c f WHERE f.kind = 'finish' AND NOT EXISTS (SELECT 1 FROM states s WHERE s.seq = f.seq "
    f"AND s.status {_NOT_TERMINAL}) AND NOT EXISTS (SELECT 1 FROM children d WHERE d.session_id = f.session_id AND d.seq < f.seq)), "
    "released AS (SELECT DISTINCT f.p_task AS task_id FROM c f JOIN tasks p ON p.task_id = f.p_task WHERE f.kind = 'finish' "
    "AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.task_id = f.p_task AND m.seq > f.seq) "
    "AND coalesce((SELECT arg_max(m.new_status, m.seq) FROM moves m WHERE m.task_id = f.p_task AND m.seq <= f.seq), p.status) = 'waiting' "
    "AND NOT EXISTS (SELECT 1 FROM children d WHERE d.task_id = f.p_task AND d.seq < f.seq) "
    "AND NOT EXISTS (SELECT 1 FROM task_dependencies td JOIN tasks x ON x.task_id = td.depends_on_task_id WHERE td.task_id = f.p_task "
    "AND coalesce((SELECT arg_max(m.new_status, m.seq) FROM moves m WHERE m.task_id = x.task_id AND m.seq <= f.seq), x.status) "
    f"{_NOT_TERMINAL})) "
)


def _ingested(c: Context) -> ingest.Ingested:
    return ingest.submit_results(c.t, c.command("responses"), AS_OF)


_add(
    "parse_responses", lambda c: ingest.parse_responses(c.command("responses")).drop("is_final", "sql_text"), "responses",
    f"WITH {_PARSED} SELECT seq, task_id, response, ok AS is_json, action, final_answer, tool_name, args, to_agent, sub_task, reason FROM fields",
)
_add(
    "ingest_actions",
    lambda c: _ingested(c).actions.select(
        "seq", "task_id", "action", "output", "need_embedding", "agent_id", "session_id", F.col("tool.name").alias("tool_name"),
        F.col("tool.tool_type").alias("tool_type"), "args", F.col("pending_task_ids")[0].alias("pending_task_id"), "approval_id",
    ),
    _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT c.seq, c.task_id, CASE WHEN c.kind IN ('forced', 'finish') THEN 'done' WHEN c.kind = 'tool_invoke' THEN "
    "'invoke_tool' WHEN c.kind = 'delegate' THEN 'wait_tasks' WHEN c.kind = 'approval' THEN 'wait_approval' ELSE 'continue' END AS action, "
    "c.answer AS output, CASE c.kind WHEN 'finish' THEN TRUE WHEN 'forced' THEN FALSE END AS need_embedding, "
    "CASE WHEN c.kind = 'finish' THEN c.agent_id END AS agent_id, CASE WHEN c.kind = 'finish' THEN c.session_id END AS session_id, "
    "CASE WHEN c.kind = 'tool_invoke' THEN c.tool_found END AS tool_name, CASE WHEN c.kind = 'tool_invoke' THEN c.tool_type END AS tool_type, "
    "CASE WHEN c.kind = 'tool_invoke' THEN c.args END AS args, d.child_id AS pending_task_id, a.approval_id "
    "FROM c LEFT JOIN children d ON d.seq = c.seq LEFT JOIN approvals a ON a.seq = c.seq",
)
_INGEST_TASKS = (
    f"{_CLASSIFIED} SELECT t.task_id, CASE WHEN r.task_id IS NOT NULL THEN 'pending' ELSE coalesce((SELECT arg_max(m.new_status, m.seq) "
    "FROM moves m WHERE m.task_id = t.task_id), t.status) END AS status, CASE WHEN EXISTS (SELECT 1 FROM moves m WHERE m.task_id = "
    "t.task_id AND m.new_status = 'completed') THEN (SELECT arg_max(m.answer, m.seq) FROM moves m WHERE m.task_id = t.task_id AND "
    f"m.new_status = 'completed') ELSE t.output END AS output, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.task_id = t.task_id) THEN {NOW} "
    f"ELSE t.heartbeat_at END AS heartbeat_at, CASE WHEN r.task_id IS NOT NULL OR EXISTS (SELECT 1 FROM c WHERE c.task_id = t.task_id) THEN "
    f"{NOW} ELSE t.updated_at END AS updated_at FROM tasks t LEFT JOIN released r ON r.task_id = t.task_id UNION ALL "
    f"SELECT child_id, 'pending', NULL, NULL, {NOW} FROM children"
)
_TASK_COLUMNS = ("task_id", "status", "output", "heartbeat_at", "updated_at")
_add("ingest_tasks", lambda c: _ingested(c).tables.tasks.select(*_TASK_COLUMNS), _INGEST_NEEDS, _INGEST_TASKS)
_LOG_COLUMNS = ("log_id", "task_id", "step_number", "role", "content")
_INGEST_LOGS = (
    f"{_CLASSIFIED}, added AS (SELECT seq * 2 AS pos, task_id, 'assistant' AS role, response AS content FROM noted UNION ALL "
    "SELECT seq * 2 + 1, task_id, 'tool', note FROM noted WHERE note IS NOT NULL) "
    "SELECT log_id, task_id, step_number, role, content FROM execution_logs UNION ALL SELECT (SELECT max(log_id) FROM execution_logs) "
    "+ row_number() OVER (ORDER BY pos), task_id, CAST(coalesce((SELECT max(e.step_number) FROM execution_logs e WHERE e.task_id = "
    "added.task_id), 0) + row_number() OVER (PARTITION BY task_id ORDER BY pos) AS INT), role, content FROM added"
)
_add("ingest_logs", lambda c: _ingested(c).tables.execution_logs.select(*_LOG_COLUMNS), _INGEST_NEEDS, _INGEST_LOGS)
_add(
    "ingest_dependencies", lambda c: _ingested(c).tables.task_dependencies, _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT dependency_id, task_id, depends_on_task_id FROM task_dependencies UNION ALL SELECT "
    "(SELECT max(dependency_id) FROM task_dependencies) + row_number() OVER (ORDER BY seq), task_id, child_id FROM children",
)
_add(
    "ingest_messages",
    lambda c: _ingested(c).tables.agent_messages.drop("created_at"),
    _INGEST_NEEDS,
    f"{_CLASSIFIED}, added AS (SELECT seq, agent_id AS f, p_agent AS t, session_id, p_task AS p, task_id AS ch, 'result' AS direction, "
    "answer AS content FROM c WHERE kind = 'finish' AND p_task IS NOT NULL UNION ALL SELECT seq, agent_id, to_agent_id, session_id, "
    "task_id, child_id, 'instruction', sub_task FROM children) SELECT message_id, from_agent_id, to_agent_id, session_id, "
    "parent_task_id, child_task_id, direction, status, content FROM agent_messages UNION ALL SELECT (SELECT max(message_id) FROM "
    "agent_messages) + row_number() OVER (ORDER BY seq), f, t, session_id, p, ch, direction, 'delivered', content FROM added",
)
_add(
    "ingest_approvals", lambda c: _ingested(c).tables.human_approvals.select("approval_id", "task_id", "session_id", "reason", "status"),
    _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT approval_id, task_id, session_id, reason, status FROM human_approvals UNION ALL "
    "SELECT approval_id, task_id, session_id, reason, 'pending' FROM approvals",
)
_add(
    "ingest_sessions", lambda c: _ingested(c).tables.sessions.select("session_id", "status", "final_answer", "completed_at"),
    _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT s.session_id, CASE WHEN e.session_id IS NOT NULL THEN 'completed' ELSE s.status END AS status, "
    "CASE WHEN e.session_id IS NOT NULL THEN e.answer ELSE s.final_answer END AS final_answer, CASE WHEN e.session_id IS NOT NULL "
    f"THEN {NOW} ELSE s.completed_at END AS completed_at FROM sessions s LEFT JOIN (SELECT session_id, arg_max(answer, seq) AS answer "
    "FROM closed GROUP BY 1) e ON e.session_id = s.session_id",
)
_add(
    "ingest_participants", lambda c: _ingested(c).tables.session_participants.select("session_id", "agent_id"), _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT session_id, agent_id FROM session_participants UNION SELECT session_id, to_agent_id FROM children",
)
_add(
    "ingest_executions",
    lambda c: _ingested(c).tables.tool_executions.select("exec_id", "task_id", "tool_id", "input", "output", "error"),
    _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT exec_id, task_id, tool_id, input, output, error FROM tool_executions UNION ALL SELECT (SELECT max(exec_id) "
    "FROM tool_executions) + row_number() OVER (ORDER BY seq), task_id, tool_id, args, NULL, "
    "'fn_execute_sql: cannot parse FROM clause' FROM c WHERE kind = 'tool_sql'",
)
_add(
    "ingest_events",
    lambda c: _ingested(c).tables.agent_events.select("event_id", "agent_id", "session_id", "task_id", "event_type", "payload"),
    _INGEST_NEEDS,
    f"{_CLASSIFIED}, added AS (SELECT seq * 2 AS pos, agent_id, session_id, task_id, 'session_end' AS event_type, "
    "CAST(json_object('final_answer', left(coalesce(answer, ''), 500)) AS VARCHAR) AS payload FROM closed UNION ALL "
    "SELECT seq * 2 + 1, agent_id, session_id, task_id, 'task_end', CASE kind WHEN 'forced' THEN '{\"forced\":true}' ELSE "
    "CAST(json_object('output_preview', left(coalesce(answer, ''), 200)) AS VARCHAR) END FROM c WHERE kind IN ('forced', 'finish') "
    "UNION ALL SELECT seq * 2 + 1, agent_id, session_id, task_id, 'tool_call', CAST(json_object('tool_name', tool_found, 'tool_type', "
    "tool_type) AS VARCHAR) FROM c WHERE kind IN ('tool_sql', 'tool_invoke') UNION ALL SELECT seq * 2 + 1, agent_id, session_id, task_id, "
    "'delegation', CAST(json_object('to_agent', to_agent, 'subtask_id', child_id) AS VARCHAR) FROM children UNION ALL "
    "SELECT seq * 2 + 1, agent_id, session_id, task_id, 'approval_request', CAST(json_object('approval_id', approval_id, 'reason', "
    "reason) AS VARCHAR) FROM approvals) SELECT event_id, agent_id, session_id, task_id, event_type, payload FROM agent_events UNION ALL "
    "SELECT (SELECT max(event_id) FROM agent_events) + row_number() OVER (ORDER BY pos), agent_id, session_id, task_id, event_type, "
    "payload FROM added",
)


# One response for every task, of the kinds the conversations lack. Sql calls name a granted tool of the task's agent.
_BROAD = (
    "sql_tools AS (SELECT p.agent_id, min(t.name) AS tool FROM agent_tool_permissions p JOIN tool_registry t ON t.tool_id = p.tool_id "
    "WHERE t.is_active AND t.tool_type = 'sql' GROUP BY p.agent_id), "
    "broad AS (SELECT t.task_id AS seq, CASE k WHEN 6 THEN -t.task_id ELSE t.task_id END AS task_id, k, CASE k "
    "WHEN 0 THEN '{\"action\":\"finish\"}' WHEN 1 THEN '{\"action\":\"call_tool\"}' WHEN 2 THEN concat("
    "'{\"action\":\"call_tool\",\"tool_name\":\"', coalesce(s.tool, 'none'), '\",\"args\":{\"sql\":\"SELECT * FROM public.v_ready_tasks\"}}') "
    "WHEN 3 THEN '{\"action\":\"delegate\",\"to_agent\":\"agent_1\"}' WHEN 4 THEN '{\"action\":\"request_approval\"}' "
    "WHEN 5 THEN NULL ELSE '{\"action\":\"ponder\"}' END AS response, FALSE AS is_final "
    "FROM (SELECT *, (task_id + session_id) % 8 AS k FROM tasks) t LEFT JOIN sql_tools s ON s.agent_id = t.agent_id)"
)
_BROAD_NEEDS = "tasks agent_tool_permissions tool_registry"


def _broad(c: Context) -> ingest.Ingested:
    for name in _BROAD_NEEDS.split():
        c.t[name].createOrReplaceTempView(f"broad_{name}")
    text = _BROAD
    for name in _BROAD_NEEDS.split():
        text = text.replace(f"FROM {name}", f"FROM broad_{name}").replace(f"JOIN {name}", f"JOIN broad_{name}")
    return ingest.submit_results(c.t, c.spark.sql(f"WITH {text} SELECT seq, task_id, response, is_final FROM broad"), AS_OF)


_add(
    "ingest_rejects", lambda c: _broad(c).rejects, f"{_BROAD_NEEDS} agent_messages",
    f"WITH {_BROAD} SELECT seq, task_id, CASE k WHEN 6 THEN 'unknown_task' WHEN 5 THEN 'no_response' WHEN 0 THEN 'finish_without_answer' "
    "WHEN 3 THEN 'delegate_without_task' ELSE 'approval_without_reason' END AS reason FROM broad WHERE k IN (3, 4, 5, 6) OR (k = 0 AND "
    "task_id IN (SELECT child_task_id FROM agent_messages WHERE direction = 'instruction'))",
)


def _sql_results(c: Context) -> DataFrame:
    """Sql calls that pass the checks, with results that came later: half of them errors."""
    done = _broad(c)
    even = F.col("seq") % 2 == 0
    outcomes = done.pending_sql.select(
        "seq", "task_id", "tool_id", "input", F.when(even, F.lit("[]")).alias("output"), F.when(~even, F.lit("boom")).alias("error")
    )
    after = ingest.ingest_sql_tool_results(done.tables, outcomes, AS_OF).tool_executions
    return after.where(F.col("executed_at") == F.lit(AS_OF).cast("timestamp")).select("task_id", "tool_id", "input", "output", "error")


_add(
    "ingest_sql_results", _sql_results, _BROAD_NEEDS,
    f"WITH {_BROAD} SELECT b.task_id, t.tool_id, '{{\"sql\":\"SELECT * FROM public.v_ready_tasks\"}}' AS input, CASE WHEN b.seq % 2 = 0 THEN '[]' "
    "END AS output, CASE WHEN b.seq % 2 <> 0 THEN 'boom' END AS error FROM broad b JOIN tasks x ON x.task_id = b.task_id "
    "JOIN sql_tools s ON s.agent_id = x.agent_id JOIN tool_registry t ON t.name = s.tool WHERE b.k = 2",
)
_add(
    "ingest_missing_tool_names",
    lambda c: _broad(c).changes["execution_logs"].rows.where(F.col("content") == ingest.TOOL_NAME_MISSING).select("task_id", "role", "content"),
    _BROAD_NEEDS,
    f"WITH {_BROAD} SELECT task_id, 'tool' AS role, '{ingest.TOOL_NAME_MISSING}' AS content FROM broad WHERE k = 1",
)


def _by_action(c: Context) -> DataFrame:
    parts = ingest.split_by_action(_ingested(c).actions)
    frames = [f.select(F.lit(name).alias("output_name"), "seq", "task_id") for name, f in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _by_tool_type(c: Context) -> DataFrame:
    parts = ingest.split_by_tool_type(_ingested(c).actions)
    frames = [f.select(F.lit(name).alias("route"), "seq", "task_id") for name, f in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


_add(
    "split_by_action", _by_action, _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT CASE WHEN kind IN ('forced', 'finish') THEN 'done' WHEN kind = 'tool_invoke' THEN 'invoke_tool' WHEN kind = "
    "'delegate' THEN 'wait_tasks' WHEN kind = 'approval' THEN 'wait_approval' ELSE 'continue' END AS output_name, seq, task_id FROM c",
)
_add(
    "split_by_tool_type", _by_tool_type, _INGEST_NEEDS,
    f"{_CLASSIFIED} SELECT CASE WHEN kind = 'tool_invoke' THEN tool_type ELSE 'rejects' END AS route, seq, task_id FROM c",
)

# ---------------------------------------------------------------- lifecycle

_ENQUEUE = (
    "WITH judged AS (SELECT r.request_id, r.agent_role, trim(r.task) AS task, r.session_id AS asked, am.agent_id, CASE "
    "WHEN trim(r.task) = '' THEN 'task_required' WHEN am.agent_id IS NULL THEN 'agent_not_found' WHEN r.session_id IS NOT NULL AND "
    "NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = r.session_id AND s.agent_id = am.agent_id) THEN 'session_of_other_agent' "
    "END AS reason FROM enqueue_requests r LEFT JOIN agent_meta am ON am.role_name = r.agent_role AND am.is_active), "
    "opened AS (SELECT *, (SELECT max(session_id) FROM sessions) + row_number() OVER (ORDER BY request_id) AS new_session FROM judged "
    "WHERE reason IS NULL AND asked IS NULL), accepted AS (SELECT j.request_id, (SELECT max(task_id) FROM tasks) + row_number() OVER "
    "(ORDER BY j.request_id) AS task_id, coalesce(j.asked, o.new_session) AS session_id, j.agent_id, j.task FROM judged j "
    "LEFT JOIN opened o ON o.request_id = j.request_id WHERE j.reason IS NULL) "
)
_ENQUEUE_NEEDS = "enqueue_requests agent_meta sessions tasks session_participants agent_events"


def _enqueued(c: Context) -> lifecycle.Outcome:
    return lifecycle.enqueue(c.t, c.command("enqueue_requests"), OPERATOR, AS_OF)


_add("enqueue", lambda c: _enqueued(c).accepted, _ENQUEUE_NEEDS,
     f"{_ENQUEUE} SELECT request_id, task_id, session_id, agent_id FROM accepted")
_add("enqueue_rejects", lambda c: _enqueued(c).rejects, _ENQUEUE_NEEDS,
     f"{_ENQUEUE} SELECT request_id, reason FROM judged WHERE reason IS NOT NULL")
_add(
    "enqueue_tasks", lambda c: _enqueued(c).tables.tasks.select("task_id", "session_id", "agent_id", "status", "input"), _ENQUEUE_NEEDS,
    f"{_ENQUEUE} SELECT task_id, session_id, agent_id, status, input FROM tasks UNION ALL SELECT task_id, session_id, agent_id, "
    "'pending', task FROM accepted",
)
_add(
    "enqueue_sessions", lambda c: _enqueued(c).tables.sessions.select("session_id", "agent_id", "status", "goal", "started_at"),
    _ENQUEUE_NEEDS,
    f"{_ENQUEUE} SELECT session_id, agent_id, status, goal, started_at FROM sessions UNION ALL SELECT new_session, agent_id, 'active', "
    f"task, {NOW} FROM opened",
)
_add(
    "enqueue_events", lambda c: _enqueued(c).tables.agent_events.select("event_id", "agent_id", "session_id", "event_type", "payload"),
    _ENQUEUE_NEEDS,
    f"{_ENQUEUE} SELECT event_id, agent_id, session_id, event_type, payload FROM agent_events UNION ALL SELECT (SELECT max(event_id) "
    "FROM agent_events) + row_number() OVER (ORDER BY request_id), agent_id, new_session, 'session_start', "
    "CAST(json_object('goal', task) AS VARCHAR) FROM opened",
)

_RESOLVE = (
    "WITH judged AS (SELECT d.approval_id, d.status, d.note, a.task_id, CASE WHEN d.status NOT IN ('approved', 'rejected') THEN "
    "'bad_status' WHEN a.status <> 'pending' THEN 'not_pending' END AS reason FROM approval_decisions d JOIN human_approvals a "
    "ON a.approval_id = d.approval_id), ok AS (SELECT * FROM judged WHERE reason IS NULL) "
)
_RESOLVE_NEEDS = "approval_decisions human_approvals tasks"


def _resolved(c: Context) -> lifecycle.Outcome:
    return lifecycle.resolve_approvals(c.t, c.command("approval_decisions"), OPERATOR, AS_OF)


_add("resolve_approvals", lambda c: _resolved(c).accepted, _RESOLVE_NEEDS, f"{_RESOLVE} SELECT approval_id, status, task_id FROM ok")
_add("resolve_approvals_rejects", lambda c: _resolved(c).rejects, _RESOLVE_NEEDS,
     f"{_RESOLVE} SELECT approval_id, reason FROM judged WHERE reason IS NOT NULL")
_add(
    "resolve_approvals_tasks", lambda c: _resolved(c).tables.tasks.select("task_id", "status", "output", "updated_at"), _RESOLVE_NEEDS,
    f"{_RESOLVE} SELECT t.task_id, CASE WHEN ok.status = 'rejected' THEN 'failed' WHEN ok.status = 'approved' AND t.status = 'waiting' "
    "THEN 'pending' ELSE t.status END AS status, CASE WHEN ok.status = 'rejected' THEN coalesce(ok.note, 'Rejected by human reviewer') "
    "ELSE t.output END AS output, CASE WHEN ok.status = 'rejected' OR (ok.status = 'approved' AND t.status = 'waiting') THEN "
    f"{NOW} ELSE t.updated_at END AS updated_at FROM tasks t LEFT JOIN ok ON ok.task_id = t.task_id",
)
_add(
    "resolve_approvals_queue",
    lambda c: _resolved(c).tables.human_approvals.select("approval_id", "status", "resolved_by", "resolved_at", "resolution_note"),
    _RESOLVE_NEEDS,
    f"{_RESOLVE} SELECT a.approval_id, coalesce(ok.status, a.status) AS status, CASE WHEN ok.approval_id IS NOT NULL THEN 'operator' ELSE "
    f"a.resolved_by END AS resolved_by, CASE WHEN ok.approval_id IS NOT NULL THEN {NOW} ELSE a.resolved_at END AS resolved_at, "
    "CASE WHEN ok.approval_id IS NOT NULL THEN ok.note ELSE a.resolution_note END AS resolution_note FROM human_approvals a "
    "LEFT JOIN ok ON ok.approval_id = a.approval_id",
)
_RETRY = (
    "(SELECT ap.max_retries FROM agent_profile_assignments apa JOIN agent_profiles ap ON ap.profile_id = apa.profile_id "
    "JOIN agent_meta am ON am.role_name = apa.role_name WHERE am.agent_id = t.agent_id)"
)
_add(
    "recover_stale",
    lambda c: lifecycle.recover_stale(c.t, OPERATOR, AS_OF).tables.tasks.select("task_id", "status", "retry_count", "heartbeat_at", "updated_at"),
    "tasks agent_profile_assignments agent_profiles agent_meta",
    f"SELECT t.task_id, CASE WHEN {_STALE} THEN CASE WHEN t.retry_count + 1 > {_RETRY} THEN 'failed' ELSE 'pending' END ELSE t.status END "
    f"AS status, CASE WHEN {_STALE} THEN t.retry_count + 1 ELSE t.retry_count END AS retry_count, t.heartbeat_at, "
    f"CASE WHEN {_STALE} THEN {NOW} ELSE t.updated_at END AS updated_at FROM tasks t",
)
_add("recover_stale_count", lambda c: lifecycle.recover_stale(c.t, OPERATOR, AS_OF).accepted.agg(F.count("*").alias("recovered")), "tasks",
     f"SELECT count(*) AS recovered FROM tasks t WHERE {_STALE}")
_add(
    "task_graph", lambda c: lifecycle.task_graph(c.t), "tasks agent_meta",
    "SELECT t.session_id, t.task_id, am.role_name AS agent, t.status, t.input FROM tasks t JOIN agent_meta am ON am.agent_id = t.agent_id",
)
_add(
    "message_trace", lambda c: lifecycle.message_trace(c.t), "agent_messages agent_meta",
    "SELECT m.session_id, m.message_id, f.role_name AS sender, r.role_name AS receiver, m.direction, m.status, m.content "
    "FROM agent_messages m JOIN agent_meta f ON f.agent_id = m.from_agent_id JOIN agent_meta r ON r.agent_id = m.to_agent_id",
)
_add(
    "latest_tasks", lambda c: lifecycle.latest_tasks(c.t, OPERATOR), "tasks agent_meta",
    f"{_MY_TASKS} ORDER BY t.created_at DESC, t.task_id DESC LIMIT 3",
)
_add(
    "latest_tasks_per_agent", lambda c: lifecycle.latest_tasks_per_agent(c.t), "tasks",
    "SELECT agent_id, CAST(rank AS INT) AS rank, task_id, session_id, status, created_at FROM (SELECT *, row_number() OVER "
    "(PARTITION BY agent_id ORDER BY created_at DESC, task_id DESC) AS rank FROM tasks) WHERE rank <= 3",
)

# ---------------------------------------------------------------- registry

_TOOL_CONFIGS = (
    "WITH read AS (SELECT seq, json_valid(config) AS ok, CASE WHEN json_valid(config) THEN config ELSE '{}' END AS body FROM tool_configs), "
    "f AS (SELECT seq, ok, json_extract_string(body, '$.name') AS name, json_extract_string(body, '$.tool_type') AS tool_type, "
    "json_extract_string(body, '$.mcp_server_url') AS url, coalesce(json_extract_string(body, '$.http_method'), 'POST') AS http_method, "
    "json_extract_string(body, '$.http_endpoint') AS http_endpoint FROM read), "
    "j AS (SELECT *, CASE WHEN NOT ok THEN 'bad_json' WHEN tool_type NOT IN ('mcp', 'sql', 'http', 'custom') THEN 'bad_tool_type' "
    "WHEN tool_type = 'mcp' AND url IS NULL THEN 'missing_type_field' WHEN name IN (SELECT name FROM tool_registry) THEN 'duplicate_name' "
    "END AS reason FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS n FROM j WHERE reason IS NULL), "
    "accepted AS (SELECT *, (SELECT max(tool_id) FROM tool_registry) + row_number() OVER (ORDER BY seq) AS tool_id FROM k WHERE n = 1) "
)


def _tools(c: Context) -> lifecycle.Outcome:
    return registry.register_tools(c.t, c.command("tool_configs"), OPERATOR, AS_OF)


_add(
    "register_tools",
    lambda c: _tools(c).tables.tool_registry.select("tool_id", "name", "tool_type", "http_endpoint", "http_method", "is_active"),
    "tool_configs tool_registry",
    f"{_TOOL_CONFIGS} SELECT tool_id, name, tool_type, http_endpoint, http_method, is_active FROM tool_registry UNION ALL "
    "SELECT tool_id, name, tool_type, http_endpoint, http_method, TRUE FROM accepted",
)
_add(
    "register_tools_rejects", lambda c: _tools(c).rejects, "tool_configs tool_registry",
    f"{_TOOL_CONFIGS} SELECT seq, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT seq, 'duplicate_name' FROM k WHERE n > 1",
)
_AGENT_CONFIGS = (
    "WITH f AS (SELECT seq, role_name, json_extract_string(config, '$.name') AS name, json_extract_string(config, '$.agent_role') AS agent_role, "
    "json_extract_string(config, '$.model_name') AS model_name, coalesce(json_extract_string(config, '$.max_steps'), '10') AS max_steps, "
    "coalesce(CAST(json_extract_string(config, '$.temperature') AS DOUBLE), 0.7) AS temperature, "
    "CAST(json_extract_string(config, '$.tool_ids[0]') AS BIGINT) AS tool_id FROM agent_configs), "
    "j AS (SELECT *, CASE WHEN model_name IS NULL THEN 'missing_field' WHEN agent_role = 'boss' THEN 'bad_domain' WHEN max_steps = 'zz' "
    "THEN 'bad_value' WHEN temperature > 2 THEN 'out_of_range' WHEN tool_id NOT IN (SELECT tool_id FROM tool_registry) THEN 'unknown_tool' "
    "END AS reason FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY role_name ORDER BY seq) AS n FROM j WHERE reason IS NULL), "
    "accepted AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM k WHERE n = 1) "
)
_AGENT_CONFIG_NEEDS = "agent_configs tool_registry agent_meta agent_profiles llm_configs agent_tool_permissions"


def _agents(c: Context) -> lifecycle.Outcome:
    return registry.provision_agents(c.t, c.command("agent_configs"), OPERATOR, AS_OF)


_add(
    "provision_agents",
    lambda c: (lambda o: o.accepted.join(
        o.tables.agent_profile_assignments.select("role_name", "profile_id", "llm_config_id"), "role_name"
    ).join(o.tables.agent_profiles.select("profile_id", "name", "max_steps"), "profile_id").join(
        o.tables.llm_configs.select("llm_config_id", "model_name", "temperature"), "llm_config_id"
    ))(_agents(c)),
    _AGENT_CONFIG_NEEDS,
    f"{_AGENT_CONFIGS} SELECT seq, role_name, (SELECT max(agent_id) FROM agent_meta) + r AS agent_id, (SELECT max(profile_id) FROM "
    "agent_profiles) + r AS profile_id, (SELECT max(llm_config_id) FROM llm_configs) + r AS llm_config_id, name, "
    "CAST(max_steps AS INT) AS max_steps, model_name, temperature FROM accepted",
)
_add(
    "provision_agents_rejects", lambda c: _agents(c).rejects, _AGENT_CONFIG_NEEDS,
    f"{_AGENT_CONFIGS} SELECT seq, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT seq, 'duplicate' FROM k WHERE n > 1",
)
_add(
    "provision_agents_grants", lambda c: _agents(c).tables.agent_tool_permissions, _AGENT_CONFIG_NEEDS,
    f"{_AGENT_CONFIGS} SELECT agent_id, tool_id, granted_at FROM agent_tool_permissions UNION ALL SELECT (SELECT max(agent_id) FROM "
    f"agent_meta) + r, tool_id, {NOW} FROM accepted",
)


def _dropped(c: Context) -> Tables:
    return registry.drop_agents(c.t, c.t.agent_meta.where("NOT is_active").select("role_name"), OPERATOR).tables


_GONE = (
    "WITH ga AS (SELECT agent_id, role_name FROM agent_meta WHERE NOT is_active), "
    "gs AS (SELECT session_id FROM sessions WHERE agent_id IN (SELECT agent_id FROM ga)), "
    "gt AS (SELECT task_id FROM tasks WHERE agent_id IN (SELECT agent_id FROM ga) OR session_id IN (SELECT session_id FROM gs)) "
)
_add(
    "drop_agents_tasks", lambda c: _dropped(c).tasks.select("task_id", "session_id", "agent_id"), "agent_meta sessions tasks",
    f"{_GONE} SELECT task_id, session_id, agent_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM gt)",
)
_add(
    "drop_agents_logs", lambda c: _dropped(c).execution_logs.select("log_id", "task_id"), "agent_meta sessions tasks execution_logs",
    f"{_GONE} SELECT log_id, task_id FROM execution_logs WHERE task_id NOT IN (SELECT task_id FROM gt)",
)


def _nulled(column: str, gone: str, key: str) -> str:
    return f"CASE WHEN {column} IN (SELECT {key} FROM {gone}) THEN NULL ELSE {column} END AS {column}"


_add(
    "drop_agents_messages",
    lambda c: _dropped(c).agent_messages.select("message_id", "session_id", "parent_task_id", "child_task_id"),
    "agent_meta sessions tasks agent_messages",
    f"{_GONE} SELECT message_id, {_nulled('session_id', 'gs', 'session_id')}, {_nulled('parent_task_id', 'gt', 'task_id')}, "
    f"{_nulled('child_task_id', 'gt', 'task_id')} FROM agent_messages WHERE from_agent_id NOT IN (SELECT agent_id FROM ga) "
    "AND to_agent_id NOT IN (SELECT agent_id FROM ga)",
)
_add(
    "drop_agents_events",
    lambda c: _dropped(c).agent_events.select("event_id", "agent_id", "session_id", "task_id"),
    "agent_meta sessions tasks agent_events",
    f"{_GONE} SELECT event_id, {_nulled('agent_id', 'ga', 'agent_id')}, {_nulled('session_id', 'gs', 'session_id')}, "
    f"{_nulled('task_id', 'gt', 'task_id')} FROM agent_events",
)


def _pairs(c: Context) -> DataFrame:
    return c.t.tasks.select("agent_id", (F.col("task_id") % 150).alias("tool_id"))


_PAIRS = "SELECT DISTINCT agent_id, task_id % 150 AS tool_id FROM tasks"
_add(
    "grant_tools", lambda c: registry.grant_tools(c.t, _pairs(c), OPERATOR, AS_OF).agent_tool_permissions,
    "tasks agent_tool_permissions",
    f"SELECT agent_id, tool_id, granted_at FROM agent_tool_permissions UNION ALL SELECT agent_id, tool_id, {NOW} FROM ({_PAIRS}) x "
    "WHERE NOT EXISTS (SELECT 1 FROM agent_tool_permissions p WHERE p.agent_id = x.agent_id AND p.tool_id = x.tool_id)",
)
_add(
    "revoke_tools", lambda c: registry.revoke_tools(c.t, _pairs(c), OPERATOR).agent_tool_permissions, "tasks agent_tool_permissions",
    f"SELECT agent_id, tool_id, granted_at FROM agent_tool_permissions p WHERE NOT EXISTS (SELECT 1 FROM ({_PAIRS}) x "
    "WHERE p.agent_id = x.agent_id AND p.tool_id = x.tool_id)",
)
_add(
    "register_flows",
    lambda c: registry.register_flows(c.t, c.command("flow_requests"), OPERATOR, AS_OF).flow_registry,
    "flow_requests flow_registry",
    "WITH last AS (SELECT flow_name, min(seq) AS seq, arg_max(agent_id, seq) AS agent_id, arg_max(webhook_url, seq) AS webhook_url "
    "FROM flow_requests GROUP BY 1) SELECT r.flow_id, r.flow_name, coalesce(l.agent_id, r.agent_id) AS agent_id, coalesce(l.webhook_url, "
    "r.webhook_url) AS webhook_url, r.is_active, r.created_at FROM flow_registry r LEFT JOIN last l ON l.flow_name = r.flow_name UNION ALL "
    "SELECT (SELECT max(flow_id) FROM flow_registry) + row_number() OVER (ORDER BY seq), flow_name, agent_id, webhook_url, TRUE, "
    f"{NOW} FROM last WHERE flow_name NOT IN (SELECT flow_name FROM flow_registry)",
)

# ---------------------------------------------------------------- embedding lifecycle


def _digest_vector(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: 64 numbers from a digest of the text."""
    return [[byte / 255 for byte in hashlib.blake2b(text.encode(), digest_size=64).digest()] for text in texts]


_COVERAGE = (
    "SELECT source, agent_id, count(*) FILTER (WHERE seen) AS searchable, count(*) FILTER (WHERE NOT seen) AS excluded, "
    "round(count(*) FILTER (WHERE seen) / count(*), 6) AS share FROM (SELECT 'memory' AS source, CAST(agent_id AS BIGINT) AS agent_id, "
    "{memory} AS seen FROM memory UNION ALL SELECT 'tool_registry', NULL, {tools} FROM tool_registry WHERE is_active) GROUP BY 1, 2"
)
_add("plan_rotation", lambda c: embed.plan_rotation(c.t, OPERATOR, "model-b", 32, "local", AS_OF).targets, "memory tool_registry", _targets(32))
_add(
    "rotation_events",
    lambda c: embed.plan_rotation(c.t, OPERATOR, "model-b", 32, "local", AS_OF).tables.agent_events.select("event_id", "event_type", "payload"),
    "agent_events",
    "SELECT event_id, event_type, payload FROM agent_events UNION ALL SELECT (SELECT max(event_id) FROM agent_events) + 1, "
    "'embedding_rotated', '{\"model\":\"model-b\",\"dims\":32}'",
)
_add(
    "embedding_coverage", lambda c: embed.embedding_coverage(c.t), "memory tool_registry",
    _COVERAGE.format(memory="coalesce(embedding IS NOT NULL AND embedding_dims = 64, FALSE)",
                     tools="coalesce(description_embedding IS NOT NULL AND embedding_dims = 64, FALSE)"),
)
_add(
    "reembed_coverage", lambda c: embed.embedding_coverage(embed.reembed(c.t, _digest_vector, AS_OF).tables), "memory tool_registry",
    _COVERAGE.format(memory="TRUE", tools="TRUE"),
)
_add(
    "reembed_report", lambda c: embed.reembed(c.t, _digest_vector, AS_OF).report, "memory tool_registry",
    f"SELECT count(*) AS processed, count(*) AS attempted FROM ({_targets(64)})",
)


def _parsed_vectors(c: Context, key: str) -> DataFrame:
    return ingest_vectors(c.command("vector_payloads"))[0].withColumnRenamed("item_id", key)


_add(
    "set_memory_embeddings",
    lambda c: embed.set_memory_embeddings(c.t, OPERATOR, _parsed_vectors(c, "memory_id")).memory.select(
        "memory_id", "embedding_dims", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total")
    ),
    "memory",
    "SELECT m.memory_id, CASE WHEN m.memory_id % 6 < 3 THEN 64 ELSE m.embedding_dims END AS embedding_dims, "
    "round(list_sum(CAST(CASE WHEN m.memory_id % 6 < 3 THEN e.embedding ELSE m.embedding END AS DOUBLE[])), 6) AS total "
    "FROM memory m JOIN embeddings e ON e.vec_id = m.memory_id",
)
_add(
    "set_tool_embeddings",
    lambda c: embed.set_tool_embeddings(c.t, OPERATOR, _parsed_vectors(c, "tool_id"), AS_OF).tool_registry.select(
        "tool_id", "embedding_dims", "updated_at"
    ),
    "tool_registry",
    "SELECT t.tool_id, CASE WHEN e.vec_id IS NOT NULL THEN 64 ELSE t.embedding_dims END AS embedding_dims, "
    f"CASE WHEN e.vec_id IS NOT NULL THEN {NOW} ELSE t.updated_at END AS updated_at FROM tool_registry t "
    "LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 6 < 3) e ON e.vec_id = t.tool_id",
)
_add(
    "insert_memories",
    lambda c: embed.insert_memories(
        c.t, OPERATOR,
        c.t.tasks.where("status = 'completed' AND output IS NOT NULL").select(
            F.col("task_id").alias("seq"), "agent_id", "session_id", F.col("output").alias("content"),
            F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("int").alias("embedding_dims"),
        ),
        AS_OF,
    ).memory.select("memory_id", "agent_id", "session_id", "content", "embedding_dims", "created_at"),
    "memory tasks",
    "SELECT memory_id, CAST(agent_id AS BIGINT) AS agent_id, session_id, content, embedding_dims, created_at FROM memory UNION ALL "
    "SELECT (SELECT max(memory_id) FROM memory) + row_number() OVER (ORDER BY task_id), agent_id, session_id, output, NULL, "
    f"{NOW} FROM tasks WHERE {_HISTORY}",
)

# ---------------------------------------------------------------- retention, guard, checks

_PURGE = (
    "WITH state AS (SELECT t.task_id, count(el.log_id) AS n, coalesce(bool_or(el.log_id IS NOT NULL AND (el.compressed_at IS NULL OR "
    "coalesce(el.compression_quality < 0.9, FALSE))), FALSE) AS blocked FROM tasks t LEFT JOIN execution_logs el ON el.task_id = t.task_id "
    "GROUP BY 1) "
)
_add(
    "purge_compressed", lambda c: retention.purge_compressed(c.t, OPERATOR, c.t.tasks).report, "tasks execution_logs",
    f"{_PURGE} SELECT task_id, blocked, CASE WHEN blocked THEN 0 ELSE n END AS deleted FROM state",
)
_add(
    "purge_compressed_logs",
    lambda c: retention.purge_compressed(c.t, OPERATOR, c.t.tasks).tables.execution_logs.select("log_id", "task_id", "step_number"),
    "tasks execution_logs",
    f"{_PURGE} SELECT el.log_id, el.task_id, el.step_number FROM execution_logs el LEFT JOIN state s ON s.task_id = el.task_id "
    "WHERE coalesce(s.blocked, TRUE)",
)
_OLD = f"created_at < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL '10' DAY"
_add("purge_events", lambda c: retention.purge_events(c.t, OPERATOR, AS_OF_EVENTS, 10).report, "agent_events",
     f"SELECT count(*) AS deleted FROM agent_events WHERE {_OLD}")
_add("purge_events_kept", lambda c: retention.purge_events(c.t, OPERATOR, AS_OF_EVENTS, 10).tables.agent_events, "agent_events",
     f"SELECT * FROM agent_events WHERE NOT ({_OLD})")
_add(
    "check_sql", lambda c: guard.check_sql(c.command("sql_requests"), c.t.sql_sandbox_allowlist).drop("sql_text"),
    "sql_requests sql_sandbox_allowlist",
    r"WITH s AS (SELECT request_id, trim(regexp_replace(regexp_replace(sql_text, '--[^\n]*', '', 'g'), '/\*.*?\*/', '', 'gs')) AS q "
    r"FROM sql_requests), f AS (SELECT *, lower(regexp_extract(q, '(?i)FROM\s+([\w.]+)', 1)) AS table_name FROM s), "
    "v AS (SELECT *, CASE WHEN q = '' THEN 'empty' WHEN position(';' IN q) > 0 THEN 'multi_statement' "
    r"WHEN NOT regexp_matches(q, '(?i)^\s*SELECT\s') THEN 'not_select' WHEN table_name = '' THEN 'no_from' "
    "WHEN table_name NOT IN (SELECT lower(view_name) FROM sql_sandbox_allowlist) THEN 'not_allowlisted' ELSE 'ok' END AS verdict FROM f) "
    "SELECT request_id, table_name, verdict, CASE verdict WHEN 'empty' THEN 'fn_execute_sql: empty SQL' WHEN 'multi_statement' THEN "
    "'fn_execute_sql: multiple statements not allowed' WHEN 'not_select' THEN 'fn_execute_sql: only SELECT allowed (got: ' || left(q, 50) "
    "|| ')' WHEN 'no_from' THEN 'fn_execute_sql: cannot parse FROM clause' WHEN 'not_allowlisted' THEN 'fn_execute_sql: view ' || "
    "table_name || ' not in sandbox allowlist' END AS message FROM v",
)


def _validation_sql() -> str:
    def key(table: str, columns: tuple[str, ...] | None = None) -> str:
        return "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns or KEYS[table]) + ")"

    parts = [
        f"SELECT '{x.table}' AS table_name, '{x.rule}' AS rule, {key(x.table)} AS row_key FROM {x.table} "
        f"WHERE {x.violated.replace('size(', 'len(')}"
        for x in CHECKS
    ]
    for u in UNIQUES:
        listed = ", ".join(u.columns)
        given = " AND ".join(f"{c} IS NOT NULL" for c in u.columns)
        parts.append(
            f"SELECT '{u.table}', 'unique {','.join(u.columns)}', {key(u.table, u.columns)} FROM {u.table} WHERE {u.where} AND {given} "
            f"GROUP BY {listed} HAVING count(*) > 1"
        )
    parts += [
        f"SELECT '{fk.table}', '{fk.column} references {fk.parent}', {key(fk.table)} FROM {fk.table} WHERE {fk.column} IS NOT NULL AND "
        f"{fk.column} NOT IN (SELECT {fk.parent_column} FROM {fk.parent})"
        for fk in FOREIGN_KEYS
    ]
    return " UNION ALL ".join(parts)


_add("validate_tables", lambda c: quality.validate_tables(c.t), " ".join(KEYS), _validation_sql())

# ---------------------------------------------------------------- store primitives


def _status_delta(c: Context) -> DataFrame:
    """Failed tasks with one retry more, as full rows."""
    return c.t.tasks.where("status = 'failed'").withColumn("retry_count", F.col("retry_count") + 1)


_add(
    "apply_delta_upsert",
    lambda c: apply_delta(c.t.tasks, _status_delta(c), ["task_id"]).select("task_id", "status", "retry_count"), "tasks",
    "SELECT task_id, status, CASE WHEN status = 'failed' THEN retry_count + 1 ELSE retry_count END AS retry_count FROM tasks",
)
_add("apply_delta_delete", lambda c: apply_delta(c.t.tasks, _status_delta(c), ["task_id"], "delete").select("task_id"), "tasks",
     "SELECT task_id FROM tasks WHERE status <> 'failed'")
_add(
    "assign_ids",
    lambda c: assign_ids(c.command("enqueue_requests"), c.t.tasks, "task_id", "request_id").select("request_id", "task_id"),
    "enqueue_requests tasks",
    "SELECT request_id, (SELECT max(task_id) FROM tasks) + row_number() OVER (ORDER BY request_id) AS task_id FROM enqueue_requests",
)
_add(
    "log_events",
    lambda c: log_events(
        c.t.agent_events,
        c.t.sessions.where("status = 'active'").select(
            F.col("session_id").alias("seq"), "agent_id", "session_id", F.lit(None).cast("long").alias("task_id"),
            F.lit("session_start").alias("event_type"), F.col("goal").alias("payload"),
        ),
        AS_OF,
    ),
    "agent_events sessions",
    "SELECT (SELECT max(event_id) FROM agent_events) + row_number() OVER (ORDER BY session_id) AS event_id, agent_id, session_id, "
    f"CAST(NULL AS BIGINT) AS task_id, 'session_start' AS event_type, goal AS payload, {NOW} AS created_at FROM sessions WHERE status = 'active'",
)
_add(
    "log_steps",
    lambda c: log_steps(
        c.t.execution_logs,
        c.command("responses").select("seq", "task_id", F.lit("assistant").alias("role"), F.col("response").alias("content")),
        AS_OF,
    ).select("log_id", "task_id", "step_number", "role", "content"),
    "execution_logs responses",
    "SELECT (SELECT max(log_id) FROM execution_logs) + row_number() OVER (ORDER BY seq) AS log_id, task_id, CAST(coalesce((SELECT "
    "max(step_number) FROM execution_logs e WHERE e.task_id = r.task_id), 0) + row_number() OVER (PARTITION BY task_id ORDER BY seq) AS INT) "
    "AS step_number, 'assistant' AS role, response AS content FROM responses r",
)


def _through_store(c: Context) -> DataFrame:
    """Tasks written as a snapshot, recovered into the next one, and read back."""
    store = scratch_path(c.spark, "store")
    streams.tables_to_store(Tables({"tasks": c.t.tasks}), c.spark, store)
    tables = read_snapshot(c.spark, store)
    after = lifecycle.recover_stale(c.t.replace(tasks=tables.tasks), OPERATOR, AS_OF).tables
    streams.write_snapshot(c.spark, store, {"tasks": after.tasks})
    return read_snapshot(c.spark, store).tasks.select("task_id", "status", "retry_count", "heartbeat_at", "updated_at")


def _stored(c: Context, tables: str, change: Callable[[Tables], Mapping], out: str) -> DataFrame:
    """A table of a store after a change that was computed from the store's tables and committed to it."""
    store = scratch_path(c.spark, "store")
    streams.tables_to_store(Tables({name: c.t[name] for name in tables.split()}), c.spark, store)
    before = read_snapshot(c.spark, store)
    changes = change(c.t.replace(**dict(before.items())))
    streams.write_snapshot(c.spark, store, {name: steps for name, steps in changes.items() if name in before}, base=before.version)
    return read_snapshot(c.spark, store)[out]


def _dropping(t: Tables) -> Mapping:
    return registry.drop_agents(t, t.agent_meta.where("NOT is_active").select("role_name"), OPERATOR).changes


def _add_stored(like: str, tables: str, change: Callable[[Tables], Mapping], out: str, *columns: str) -> None:
    """The query `like` once more, through the store: only what changes is written, and the result is what the store then holds."""
    CATALOG[f"{like}_stored"] = Query(lambda c: _stored(c, tables, change, out).select(*columns or "*"), CATALOG[like].oracle)


_add_stored("purge_events_kept", "agent_events", lambda t: retention.purge_events(t, OPERATOR, AS_OF_EVENTS, 10).changes, "agent_events")
_add_stored("purge_compressed_logs", "tasks execution_logs", lambda t: retention.purge_compressed(t, OPERATOR, t.tasks).changes, "execution_logs",
            "log_id", "task_id", "step_number")
_add_stored("drop_agents_tasks", "tasks", _dropping, "tasks", "task_id", "session_id", "agent_id")
_add_stored("drop_agents_messages", "agent_messages", _dropping, "agent_messages", "message_id", "session_id", "parent_task_id", "child_task_id")
_add("write_snapshot", _through_store, "tasks agent_profile_assignments agent_profiles agent_meta",
     CATALOG["recover_stale"].oracle and f"SELECT t.task_id, CASE WHEN {_STALE} THEN CASE WHEN t.retry_count + 1 > {_RETRY} THEN 'failed' ELSE "
     f"'pending' END ELSE t.status END AS status, CASE WHEN {_STALE} THEN t.retry_count + 1 ELSE t.retry_count END AS retry_count, "
     f"t.heartbeat_at, CASE WHEN {_STALE} THEN {NOW} ELSE t.updated_at END AS updated_at FROM tasks t")


def _loaded(c: Context) -> DataFrame:
    """Tool statistics over tables that went through the typed Parquet store."""
    store = scratch_path(c.spark, "tables")
    for name in ("tool_registry", "tool_executions"):
        typed(c.t[name], name).write.parquet(f"{store}/{name}")
    return views.tool_stats(load_tables(c.spark, store))


_add("load_tables", _loaded, "tool_registry tool_executions", _STATS)


def _all_loaded(c: Context) -> DataFrame:
    """Rows of each of the 20 tables after they went through the typed Parquet folders, with the columns that hold a value."""
    store = scratch_path(c.spark, "tables")
    for name in SCHEMAS:
        typed(c.t[name], name).write.parquet(f"{store}/{name}")
    loaded = load_tables(c.spark, store)
    counts = [
        loaded[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), *[F.count(k).alias(f"k{i}") for i, k in enumerate(KEYS[name][:1])])
        for name in SCHEMAS
    ]
    return reduce(DataFrame.unionByName, counts)


_add(
    "load_all_tables", _all_loaded, " ".join(SCHEMAS),
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n, count({KEYS[name][0]}) AS k0 FROM {name}" for name in SCHEMAS),
)

# ---------------------------------------------------------------- monitoring

_ALL = f"BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


def _level_sql(red: int, yellow: int | None = None) -> str:
    middle = f" WHEN value >= {yellow} THEN 'yellow'" if yellow else ""
    return f"CASE WHEN value >= {red} THEN 'red'{middle} ELSE 'green' END AS level"


def _count_sql(table: str, where: str) -> str:
    return f"SELECT {NOW} AS time, CAST(count(*) AS INT) AS value FROM {table} WHERE {where}"


_add("active_sessions_count", lambda c: monitoring.active_sessions_count(c.t, AS_OF), "sessions", _count_sql("sessions", "status = 'active'"))
_add("running_tasks_count", lambda c: monitoring.running_tasks_count(c.t, AS_OF), "tasks", _count_sql("tasks", "status = 'running'"))
_add("waiting_tasks_count", lambda c: monitoring.waiting_tasks_count(c.t, AS_OF), "tasks", _count_sql("tasks", "status IN ('waiting', 'pending')"))
_add("pending_approvals_count", lambda c: monitoring.pending_approvals_count(c.t, AS_OF), "human_approvals",
     _count_sql("human_approvals", "status = 'pending'"))
_add(
    "failed_recent", lambda c: monitoring.failed_recent(c.t, AS_OF), "tasks",
    f"SELECT time, value, {_level_sql(5, 1)} FROM ({_count_sql('tasks', f'''status = 'failed' AND updated_at > {NOW} - {DAY}''')})",
)
_add("stale_count", lambda c: monitoring.stale_count(c.t, AS_OF), "tasks",
     f"SELECT time, value, {_level_sql(1)} FROM ({_count_sql('tasks t', _STALE)})")
_add(
    "task_throughput", lambda c: monitoring.task_throughput(c.t, FROM, TO), "tasks",
    f"SELECT date_trunc('minute', created_at) AS time, status, CAST(count(*) AS INT) AS value FROM tasks WHERE created_at {_ALL} GROUP BY 1, 2",
)
_add(
    "tool_calls", lambda c: monitoring.tool_calls(c.t, FROM, TO), "tool_executions tool_registry",
    "SELECT date_trunc('minute', te.executed_at) AS time, t.name AS metric, CAST(count(*) AS INT) AS value FROM tool_executions te "
    f"JOIN tool_registry t ON t.tool_id = te.tool_id WHERE te.executed_at {_ALL} GROUP BY 1, 2",
)
_add(
    "active_sessions", lambda c: monitoring.active_sessions(c.t), "sessions agent_meta",
    "SELECT s.session_id, am.role_name AS agent, s.goal, s.status, s.started_at FROM sessions s JOIN agent_meta am ON am.agent_id = "
    "s.agent_id WHERE s.status = 'active' ORDER BY s.started_at DESC, s.session_id LIMIT 50",
)
_add(
    "tool_stats_top", lambda c: monitoring.tool_stats_top(c.t), "tool_registry tool_executions",
    f"SELECT name, tool_type, total_calls, error_count, avg_duration_ms, last_called_at FROM ({_STATS}) ORDER BY total_calls DESC NULLS LAST, "
    "name LIMIT 50",
)
_add(
    "recent_events", lambda c: monitoring.recent_events(c.t), "agent_events agent_meta",
    "SELECT e.created_at, am.role_name AS agent, e.event_type, e.session_id, e.task_id, e.payload FROM agent_events e LEFT JOIN "
    "agent_meta am ON am.agent_id = e.agent_id ORDER BY e.created_at DESC, e.event_id LIMIT 100",
)
_add("agent_names", lambda c: monitoring.agent_names(c.t), "agent_meta", "SELECT role_name FROM agent_meta WHERE is_active")
_add("agent_inventory", lambda c: monitoring.agent_inventory(c.t), _CONTEXT_NEEDS,
     f"SELECT am.role_name, am.display_name, ap.agent_role, lc.provider, lc.model_name, ap.max_steps, am.is_active {_CONTEXT}")
_DONE = (
    "FROM tasks t JOIN agent_meta am ON am.agent_id = t.agent_id {} WHERE t.status = 'completed' AND t.updated_at > "
    f"{NOW} - {DAY}"
)
_add("completed_recent", lambda c: monitoring.completed_recent(c.t, AS_OF), "tasks agent_meta",
     f"SELECT {NOW} AS time, CAST(count(*) AS INT) AS value {_DONE.format('')}")
_add(
    "avg_steps_per_task", lambda c: _rounded(monitoring.avg_steps_per_task(c.t, AS_OF), "value"), "tasks agent_meta execution_logs",
    f"SELECT {NOW} AS time, round(coalesce(avg(steps), 0), 6) AS value FROM (SELECT t.task_id, count(el.log_id) AS steps "
    + _DONE.format("LEFT JOIN execution_logs el ON el.task_id = t.task_id AND el.role = 'assistant'")
    + " GROUP BY t.task_id)",
)
_add(
    "tasks_per_agent", lambda c: monitoring.tasks_per_agent(c.t, FROM, TO), "tasks agent_meta",
    "SELECT date_trunc('hour', t.updated_at) AS time, am.role_name AS metric, CAST(count(*) AS INT) AS value FROM tasks t JOIN agent_meta am "
    f"ON am.agent_id = t.agent_id WHERE t.updated_at {_ALL} AND t.status = 'completed' GROUP BY 1, 2",
)
_add(
    "tool_grants", lambda c: monitoring.tool_grants(c.t), "agent_tool_permissions agent_meta tool_registry",
    "SELECT am.role_name AS agent, t.name AS tool, t.tool_type, p.granted_at FROM agent_tool_permissions p JOIN agent_meta am ON am.agent_id "
    "= p.agent_id JOIN tool_registry t ON t.tool_id = p.tool_id",
)
_add(
    "recent_failures", lambda c: monitoring.recent_failures(c.t, AS_OF), "tasks agent_meta",
    "SELECT t.task_id, am.role_name AS agent, t.input, t.output AS reason, t.updated_at FROM tasks t JOIN agent_meta am ON am.agent_id = "
    f"t.agent_id WHERE t.status = 'failed' AND t.updated_at > {NOW} - INTERVAL '7' DAY ORDER BY t.updated_at DESC, t.task_id LIMIT 50",
)

ROLES = ("agent_1", "agent_3")
_ROLES = "am.role_name IN ('agent_1', 'agent_3')"
_add("agent_inventory_of_roles", lambda c: monitoring.agent_inventory(c.t, ROLES), _CONTEXT_NEEDS,
     f"SELECT am.role_name, am.display_name, ap.agent_role, lc.provider, lc.model_name, ap.max_steps, am.is_active {_CONTEXT} WHERE {_ROLES}")
_add("completed_recent_of_roles", lambda c: monitoring.completed_recent(c.t, AS_OF, roles=ROLES), "tasks agent_meta",
     f"SELECT {NOW} AS time, CAST(count(*) AS INT) AS value {_DONE.format('')} AND {_ROLES}")
_add(
    "avg_steps_per_task_of_roles", lambda c: _rounded(monitoring.avg_steps_per_task(c.t, AS_OF, roles=ROLES), "value"),
    "tasks agent_meta execution_logs",
    f"SELECT {NOW} AS time, round(coalesce(avg(steps), 0), 6) AS value FROM (SELECT t.task_id, count(el.log_id) AS steps "
    + _DONE.format("LEFT JOIN execution_logs el ON el.task_id = t.task_id AND el.role = 'assistant'")
    + f" AND {_ROLES} GROUP BY t.task_id)",
)
_add(
    "tasks_per_agent_of_roles", lambda c: monitoring.tasks_per_agent(c.t, FROM, TO, ROLES), "tasks agent_meta",
    "SELECT date_trunc('hour', t.updated_at) AS time, am.role_name AS metric, CAST(count(*) AS INT) AS value FROM tasks t JOIN agent_meta am "
    f"ON am.agent_id = t.agent_id WHERE t.updated_at {_ALL} AND t.status = 'completed' AND {_ROLES} GROUP BY 1, 2",
)
_add(
    "tool_grants_of_roles", lambda c: monitoring.tool_grants(c.t, ROLES), "agent_tool_permissions agent_meta tool_registry",
    "SELECT am.role_name AS agent, t.name AS tool, t.tool_type, p.granted_at FROM agent_tool_permissions p JOIN agent_meta am ON am.agent_id "
    f"= p.agent_id JOIN tool_registry t ON t.tool_id = p.tool_id WHERE {_ROLES}",
)
_add(
    "recent_failures_of_roles", lambda c: monitoring.recent_failures(c.t, AS_OF, roles=ROLES), "tasks agent_meta",
    "SELECT t.task_id, am.role_name AS agent, t.input, t.output AS reason, t.updated_at FROM tasks t JOIN agent_meta am ON am.agent_id = "
    f"t.agent_id WHERE t.status = 'failed' AND t.updated_at > {NOW} - INTERVAL '7' DAY AND {_ROLES} ORDER BY t.updated_at DESC, t.task_id LIMIT 50",
)

# ---------------------------------------------------------------- streams

_CHANGES = "lag(status) OVER (PARTITION BY {} ORDER BY ts)"
Launch = Callable[[DataFrame, str], streams.StreamingQuery]


def _notices(c: Context, launch: Launch, changes: str) -> DataFrame:
    """Run a change stream over everything there is and read what it wrote."""
    store = scratch_path(c.spark, "changes")
    launch(c.command(changes, live=True), store).awaitTermination()
    return streams.emitted(c.spark, store)


_add(
    "stream_task_ready", lambda c: _notices(c, streams.task_ready, "task_changes"), "task_changes",
    f"SELECT task_id, session_id, agent_id, ts FROM (SELECT *, {_CHANGES.format('task_id')} AS previous FROM task_changes) "
    "WHERE status = 'pending' AND previous IS DISTINCT FROM 'pending'",
)
_add(
    "stream_session_done", lambda c: _notices(c, streams.session_done, "session_changes"), "session_changes",
    "SELECT session_id, status, agent_id, left(coalesce(final_answer, ''), 500) AS final_answer, ts FROM (SELECT *, "
    f"{_CHANGES.format('session_id')} AS previous FROM session_changes) WHERE status IN ('completed', 'failed') AND previous = 'active'",
)
_add(
    "stream_approval_needed", lambda c: streams.drain(streams.approval_needed(c.live().human_approvals)), "human_approvals",
    "SELECT approval_id, task_id, session_id FROM human_approvals WHERE status = 'pending'",
)
_add(
    "stream_event_log",
    lambda c: streams.drain(
        streams.event_log_stream(c.live().agent_events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy"))
    ),
    "agent_events",
    "SELECT * FROM agent_events",
)
_add(
    "stream_throughput",
    lambda c: streams.drain(streams.throughput_stream(c.live().agent_events, "created_at", "1 hour", F.col("event_type"))),
    "agent_events",
    "SELECT date_trunc('hour', created_at) AS time, event_type AS metric, count(*) AS value FROM agent_events GROUP BY 1, 2 "
    "HAVING date_trunc('hour', created_at) + INTERVAL '1' HOUR <= (SELECT max(created_at) - INTERVAL '10' MINUTE FROM agent_events)",
)
_add(
    "stream_task_throughput",
    lambda c: streams.drain(streams.throughput_stream(c.live().tasks, "created_at", "1 minute", F.col("status"))), "tasks",
    "SELECT date_trunc('minute', created_at) AS time, status AS metric, count(*) AS value FROM tasks GROUP BY 1, 2 "
    "HAVING date_trunc('minute', created_at) + INTERVAL '1' MINUTE <= (SELECT max(created_at) - INTERVAL '10' MINUTE FROM tasks)",
)


def _live_tasks_per_agent(c: Context) -> DataFrame:
    names = c.t.agent_meta.select("agent_id", "role_name")
    done = c.live().tasks.where("status = 'completed'").join(names, "agent_id")
    return streams.drain(streams.throughput_stream(done, "updated_at", "1 hour", F.col("role_name")))


_add(
    "stream_tasks_per_agent", _live_tasks_per_agent, "tasks agent_meta",
    "WITH done AS (SELECT t.updated_at, am.role_name FROM tasks t JOIN agent_meta am ON am.agent_id = t.agent_id WHERE t.status = 'completed') "
    "SELECT date_trunc('hour', updated_at) AS time, role_name AS metric, count(*) AS value FROM done GROUP BY 1, 2 "
    "HAVING date_trunc('hour', updated_at) + INTERVAL '1' HOUR <= (SELECT max(updated_at) - INTERVAL '10' MINUTE FROM done)",
)


def _live_tool_calls(c: Context) -> DataFrame:
    names = c.t.tool_registry.select("tool_id", "name")
    calls = live_tool_calls(c.spark, c.directory).join(names, "tool_id")
    return streams.drain(streams.throughput_stream(calls, "executed_at", "1 minute", F.col("name")))


_add(
    "stream_tool_calls", _live_tool_calls, "tool_executions tool_registry",
    "WITH calls AS (SELECT te.executed_at, t.name FROM tool_executions te JOIN tool_registry t ON t.tool_id = te.tool_id) "
    "SELECT date_trunc('minute', executed_at) AS time, name AS metric, count(*) AS value FROM calls GROUP BY 1, 2 "
    "HAVING date_trunc('minute', executed_at) + INTERVAL '1' MINUTE <= (SELECT max(executed_at) - INTERVAL '10' MINUTE FROM calls)",
)
_GAP = "ps = 'running' AND ts - p >= INTERVAL '300' SECOND"
_add(
    "stream_heartbeat_changes", lambda c: _notices(c, lambda beats, store: streams.heartbeat_changes(beats, store), "heartbeats"), "heartbeats",
    "WITH b AS (SELECT DISTINCT task_id, status, ts FROM heartbeats), "
    "l AS (SELECT *, lag(ts) OVER w AS p, lag(status) OVER w AS ps, lead(ts) OVER w AS nx FROM b WINDOW w AS (PARTITION BY task_id ORDER BY ts, status)) "
    f"SELECT task_id, 'silent' AS state, p AS ts FROM l WHERE {_GAP} UNION ALL SELECT task_id, 'back' AS state, ts FROM l WHERE {_GAP} "
    "UNION ALL SELECT task_id, 'silent' AS state, ts FROM l WHERE nx IS NULL AND status = 'running' "
    "AND ts <= (SELECT max(ts) FROM heartbeats) - INTERVAL '360' SECOND",
)
_add(
    "stream_heartbeat_monitor",
    lambda c: streams.drain(streams.heartbeat_monitor(c.command("heartbeats", live=True))), "heartbeats",
    "WITH b AS (SELECT *, lag(ts) OVER (PARTITION BY task_id ORDER BY ts) AS before FROM heartbeats), s AS (SELECT *, sum(CASE WHEN "
    "before IS NULL OR ts > before + INTERVAL '300' SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts) AS n FROM b) "
    "SELECT task_id, max(ts) AS last_seen FROM s GROUP BY task_id, n HAVING arg_max(status, ts) = 'running' "
    "AND max(ts) + INTERVAL '300' SECOND <= (SELECT max(ts) - INTERVAL '1' MINUTE FROM heartbeats)",
)


def _live_progress(c: Context) -> DataFrame:
    """The counts as the stream wrote them."""
    store = scratch_path(c.spark, "progress")
    streams.live_progress(c.command("task_changes", live=True), store).awaitTermination()
    return streams.progress(c.spark, store)


_add(
    "stream_session_progress", _live_progress, "tasks",
    "SELECT session_id, count(*) AS total_tasks, count(*) FILTER (WHERE status = 'completed') AS completed_tasks, "
    "count(*) FILTER (WHERE status = 'running') AS running_tasks, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) AS failed_tasks "
    "FROM tasks GROUP BY 1",
)


def _live_ingest(c: Context) -> Tables:
    store = scratch_path(c.spark, "live-store")
    streams.tables_to_store(c.t, c.spark, store)
    live = c.command("responses", live=True)
    streams.ingest_stream(live, store, lambda batch: AS_OF, f"{store}-state").awaitTermination()
    return read_snapshot(c.spark, store)


_add("stream_ingest", lambda c: _live_ingest(c).tasks.select(*_TASK_COLUMNS), _INGEST_NEEDS, _INGEST_TASKS)
_add("stream_ingest_logs", lambda c: _live_ingest(c).execution_logs.select(*_LOG_COLUMNS), _INGEST_NEEDS, _INGEST_LOGS)


def _live_reembed(c: Context) -> DataFrame:
    store = scratch_path(c.spark, "live-vectors")
    streams.tables_to_store(
        Tables({name: c.t[name] for name in ("memory", "tool_registry", "embedding_config")}), c.spark, store
    )
    ticks = c.live().agent_events
    streams.reembed_stream(ticks, store, _digest_vector, lambda batch: AS_OF, f"{store}-state").awaitTermination()
    return embed.embedding_coverage(read_snapshot(c.spark, store))


_add("stream_reembed", _live_reembed, "memory tool_registry", _COVERAGE.format(memory="TRUE", tools="TRUE"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(CATALOG)


def oracle_sql() -> dict[str, str]:
    return {name: query.oracle for name, query in CATALOG.items() if query.oracle}
