"""Data model: the 20 control-plane tables, their value domains and their constraints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names, order and types of the tables.
TABLE_DDL: dict[str, str] = {
    "embedding_config": "config_id int, model_name string, dimensions int, endpoint string, is_active boolean, "
    "activated_at timestamp",
    "llm_configs": "llm_config_id bigint, provider string, endpoint string, model_name string, api_key_ref string, "
    "temperature double, max_tokens int, request_options string, created_at timestamp",
    "agent_profiles": "profile_id bigint, name string, agent_role string, system_prompt string, max_steps int, "
    "max_retries int, created_at timestamp",
    "agent_meta": "agent_id bigint, role_name string, display_name string, is_active boolean, created_at timestamp",
    "agent_profile_assignments": "assignment_id bigint, role_name string, profile_id bigint, llm_config_id bigint, "
    "created_at timestamp",
    "sessions": "session_id bigint, agent_id bigint, status string, goal string, final_answer string, "
    "started_at timestamp, completed_at timestamp",
    "session_participants": "session_id bigint, agent_id bigint, joined_at timestamp",
    "tasks": "task_id bigint, session_id bigint, agent_id bigint, status string, input string, output string, "
    "retry_count bigint, heartbeat_at timestamp, created_at timestamp, updated_at timestamp",
    "task_dependencies": "dependency_id bigint, task_id bigint, depends_on_task_id bigint",
    "execution_logs": "log_id bigint, task_id bigint, step_number int, role string, content string, "
    "compressed_content string, compression_quality double, compressed_at timestamp, created_at timestamp",
    "memory": "memory_id bigint, agent_id bigint, session_id bigint, content string, embedding array<float>, "
    "embedding_dims int, created_at timestamp",
    "agent_messages": "message_id bigint, from_agent_id bigint, to_agent_id bigint, session_id bigint, "
    "parent_task_id bigint, child_task_id bigint, direction string, status string, content string, "
    "created_at timestamp",
    "human_approvals": "approval_id bigint, task_id bigint, session_id bigint, requested_by_agent_id bigint, "
    "reason string, status string, resolved_by string, resolved_at timestamp, resolution_note string, "
    "created_at timestamp",
    "tool_registry": "tool_id bigint, name string, description string, input_schema string, tool_type string, "
    "mcp_server_url string, mcp_server_name string, mcp_server_status string, mcp_last_health_check timestamp, "
    "http_endpoint string, http_method string, http_headers string, custom_code string, runtime string, "
    "description_embedding array<float>, embedding_dims int, is_active boolean, created_at timestamp, "
    "updated_at timestamp",
    "agent_tool_permissions": "agent_id bigint, tool_id bigint, granted_at timestamp",
    "tool_executions": "exec_id bigint, task_id bigint, tool_id bigint, input string, output string, error string, "
    "duration_ms int, executed_at timestamp",
    "flow_registry": "flow_id bigint, flow_name string, agent_id bigint, webhook_url string, is_active boolean, "
    "created_at timestamp",
    "agent_events": "event_id bigint, agent_id bigint, session_id bigint, task_id bigint, event_type string, "
    "payload string, created_at timestamp",
    "sql_sandbox_allowlist": "view_name string, description string, created_at timestamp",
    "system_agent_configs": "config_id int, agent_type string, is_enabled boolean, role_name string, "
    "run_interval_secs int, settings string, last_run_at timestamp, updated_at timestamp",
}

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(ddl: str) -> T.StructType:
    """The declared columns as a struct type; unlike the built-in DDL reader this needs no running session."""
    pairs = [column.split(" ") for column in ddl.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in TABLE_DDL.items()}

KEYS: dict[str, tuple[str, ...]] = {
    "embedding_config": ("config_id",),
    "llm_configs": ("llm_config_id",),
    "agent_profiles": ("profile_id",),
    "agent_meta": ("agent_id",),
    "agent_profile_assignments": ("assignment_id",),
    "sessions": ("session_id",),
    "session_participants": ("session_id", "agent_id"),
    "tasks": ("task_id",),
    "task_dependencies": ("dependency_id",),
    "execution_logs": ("log_id",),
    "memory": ("memory_id",),
    "agent_messages": ("message_id",),
    "human_approvals": ("approval_id",),
    "tool_registry": ("tool_id",),
    "agent_tool_permissions": ("agent_id", "tool_id"),
    "tool_executions": ("exec_id",),
    "flow_registry": ("flow_id",),
    "agent_events": ("event_id",),
    "sql_sandbox_allowlist": ("view_name",),
    "system_agent_configs": ("config_id",),
}

# Enumerations.
AGENT_ROLES = ("orchestrator", "executor", "evaluator")
TASK_STATUSES = ("pending", "waiting", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
PROVIDERS = ("anthropic", "openai", "ollama", "custom")
SESSION_STATUSES = ("active", "completed", "failed")
TOOL_TYPES = ("mcp", "sql", "http", "custom")
APPROVAL_STATUSES = ("pending", "approved", "rejected")
LOG_ROLES = ("system", "user", "assistant", "tool")
MESSAGE_DIRECTIONS = ("instruction", "result")
MESSAGE_STATUSES = ("pending", "delivered", "failed")
HEALTH_STATUSES = ("healthy", "unhealthy", "unknown")
SYSTEM_AGENTS = ("compressor", "embedder")
EVENT_TYPES = (
    "session_start",
    "session_end",
    "task_start",
    "task_end",
    "tool_call",
    "tool_result",
    "delegation",
    "approval_request",
    "approval_resolved",
    "embedding_rotated",
)

# Defaults.
DEFAULT_INPUT_SCHEMA = '{"type":"object","properties":{}}'
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 4096
DEFAULT_MAX_STEPS = 10
DEFAULT_MAX_RETRIES = 3
DEFAULT_COMPRESS_AFTER = 20
STALE_SECONDS = 300
KEEP_EVENT_DAYS = 30
PURGE_QUALITY = 0.9


@dataclass(frozen=True)
class Check:
    """A row-level rule; `violated` is a SQL predicate that is true on an offending row."""

    table: str
    rule: str
    violated: str


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str
    on_delete: str  # cascade | set null | restrict


def _not_null(table: str, *columns: str) -> list[Check]:
    return [Check(table, f"{c} not null", f"{c} IS NULL") for c in columns]


def _domain(table: str, column: str, values: tuple[str, ...]) -> Check:
    listed = ", ".join(f"'{v}'" for v in values)
    return Check(table, f"{column} domain", f"{column} NOT IN ({listed})")


CHECKS: list[Check] = [
    *_not_null("embedding_config", "model_name", "dimensions", "endpoint", "is_active", "activated_at"),
    Check("embedding_config", "dimensions positive", "dimensions <= 0"),
    *_not_null("llm_configs", "provider", "endpoint", "model_name", "temperature", "max_tokens", "created_at"),
    _domain("llm_configs", "provider", PROVIDERS),
    Check("llm_configs", "temperature range", "temperature < 0 OR temperature > 2"),
    Check("llm_configs", "max_tokens positive", "max_tokens <= 0"),
    *_not_null("agent_profiles", "name", "agent_role", "system_prompt", "max_steps", "max_retries", "created_at"),
    _domain("agent_profiles", "agent_role", AGENT_ROLES),
    Check("agent_profiles", "max_steps positive", "max_steps <= 0"),
    Check("agent_profiles", "max_retries range", "max_retries < 0"),
    *_not_null("agent_meta", "role_name", "display_name", "is_active", "created_at"),
    *_not_null("agent_profile_assignments", "role_name", "profile_id", "llm_config_id", "created_at"),
    *_not_null("sessions", "agent_id", "status", "goal", "started_at"),
    _domain("sessions", "status", SESSION_STATUSES),
    *_not_null("session_participants", "session_id", "agent_id", "joined_at"),
    *_not_null("tasks", "session_id", "agent_id", "status", "input", "retry_count", "created_at", "updated_at"),
    _domain("tasks", "status", TASK_STATUSES),
    Check("tasks", "retry_count range", "retry_count < 0"),
    *_not_null("task_dependencies", "task_id", "depends_on_task_id"),
    Check("task_dependencies", "no self edge", "task_id = depends_on_task_id"),
    *_not_null("execution_logs", "task_id", "step_number", "role", "content", "created_at"),
    _domain("execution_logs", "role", LOG_ROLES),
    Check("execution_logs", "compression_quality range", "compression_quality < 0 OR compression_quality > 1"),
    *_not_null("memory", "agent_id", "content", "created_at"),
    Check("memory", "declared dims", "size(embedding) <> embedding_dims"),
    *_not_null("agent_messages", "from_agent_id", "to_agent_id", "direction", "status", "content", "created_at"),
    _domain("agent_messages", "direction", MESSAGE_DIRECTIONS),
    _domain("agent_messages", "status", MESSAGE_STATUSES),
    *_not_null("human_approvals", "task_id", "session_id", "requested_by_agent_id", "reason", "status", "created_at"),
    _domain("human_approvals", "status", APPROVAL_STATUSES),
    *_not_null("tool_registry", "name", "description", "input_schema", "tool_type", "is_active", "created_at",
               "updated_at"),
    _domain("tool_registry", "tool_type", TOOL_TYPES),
    _domain("tool_registry", "mcp_server_status", HEALTH_STATUSES),
    Check(
        "tool_registry",
        "type needs its field",
        "(tool_type = 'mcp' AND mcp_server_url IS NULL) OR (tool_type = 'http' AND http_endpoint IS NULL) "
        "OR (tool_type = 'custom' AND custom_code IS NULL)",
    ),
    Check("tool_registry", "declared dims", "size(description_embedding) <> embedding_dims"),
    *_not_null("agent_tool_permissions", "agent_id", "tool_id", "granted_at"),
    *_not_null("tool_executions", "task_id", "tool_id", "executed_at"),
    *_not_null("flow_registry", "flow_name", "agent_id", "is_active", "created_at"),
    *_not_null("agent_events", "event_type", "created_at"),
    _domain("agent_events", "event_type", EVENT_TYPES),
    *_not_null("sql_sandbox_allowlist", "view_name", "created_at"),
    *_not_null("system_agent_configs", "agent_type", "is_enabled", "run_interval_secs", "settings", "updated_at"),
    _domain("system_agent_configs", "agent_type", SYSTEM_AGENTS),
    Check("system_agent_configs", "run_interval positive", "run_interval_secs <= 0"),
]

UNIQUES: list[Unique] = [
    *[Unique(table, key) for table, key in KEYS.items()],
    Unique("embedding_config", ("is_active",), "is_active"),
    Unique("agent_profiles", ("name",)),
    Unique("agent_meta", ("role_name",)),
    Unique("agent_profile_assignments", ("role_name",)),
    Unique("task_dependencies", ("task_id", "depends_on_task_id")),
    Unique("tool_registry", ("name",)),
    Unique("flow_registry", ("flow_name",)),
    Unique("system_agent_configs", ("agent_type",)),
]

FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("agent_profile_assignments", "role_name", "agent_meta", "role_name", "cascade"),
    ForeignKey("agent_profile_assignments", "profile_id", "agent_profiles", "profile_id", "restrict"),
    ForeignKey("agent_profile_assignments", "llm_config_id", "llm_configs", "llm_config_id", "restrict"),
    ForeignKey("sessions", "agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("session_participants", "session_id", "sessions", "session_id", "cascade"),
    ForeignKey("session_participants", "agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("tasks", "session_id", "sessions", "session_id", "cascade"),
    ForeignKey("tasks", "agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("task_dependencies", "task_id", "tasks", "task_id", "cascade"),
    ForeignKey("task_dependencies", "depends_on_task_id", "tasks", "task_id", "cascade"),
    ForeignKey("execution_logs", "task_id", "tasks", "task_id", "cascade"),
    ForeignKey("memory", "agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("memory", "session_id", "sessions", "session_id", "set null"),
    ForeignKey("agent_messages", "from_agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("agent_messages", "to_agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("agent_messages", "session_id", "sessions", "session_id", "set null"),
    ForeignKey("agent_messages", "parent_task_id", "tasks", "task_id", "set null"),
    ForeignKey("agent_messages", "child_task_id", "tasks", "task_id", "set null"),
    ForeignKey("human_approvals", "task_id", "tasks", "task_id", "cascade"),
    ForeignKey("human_approvals", "session_id", "sessions", "session_id", "cascade"),
    ForeignKey("human_approvals", "requested_by_agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("agent_tool_permissions", "agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("agent_tool_permissions", "tool_id", "tool_registry", "tool_id", "cascade"),
    ForeignKey("tool_executions", "task_id", "tasks", "task_id", "cascade"),
    ForeignKey("tool_executions", "tool_id", "tool_registry", "tool_id", "cascade"),
    ForeignKey("flow_registry", "agent_id", "agent_meta", "agent_id", "cascade"),
    ForeignKey("agent_events", "agent_id", "agent_meta", "agent_id", "set null"),
    ForeignKey("agent_events", "session_id", "sessions", "session_id", "set null"),
    ForeignKey("agent_events", "task_id", "tasks", "task_id", "set null"),
    ForeignKey("system_agent_configs", "role_name", "agent_meta", "role_name", "set null"),
]


@dataclass(frozen=True)
class Principal:
    """Who asks. The two flags stand for membership of the operator and worker roles."""

    name: str
    is_operator: bool = False
    is_worker: bool = False

    @property
    def privileged(self) -> bool:
        return self.is_operator or self.is_worker


OPERATOR = Principal("operator", is_operator=True)


class Tables(Mapping):
    """A bundle of the 20 frames. A frame is built on first use, so a query plans only what it reads."""

    def __init__(
        self, sources: Mapping[str, DataFrame | Callable[[], DataFrame]], last_ids: Mapping[str, int] | None = None, version: int | None = None
    ):
        self._sources = dict(sources)
        #: The version of a store that the bundle was read from.
        self.version = version
        #: Largest id of each table, where a store has kept count.
        self.last_ids = dict(last_ids or {})
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            source = self._sources[name]
            self._frames[name] = source() if callable(source) else source
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as missing:
            raise AttributeError(name) from missing

    def __iter__(self) -> Iterator[str]:
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)

    def replace(self, **frames: DataFrame | Callable[[], DataFrame]) -> Tables:
        """The same bundle with some frames exchanged."""
        merged: dict[str, DataFrame | Callable[[], DataFrame]] = {**self._sources, **self._frames, **frames}
        return Tables(merged, {name: last for name, last in self.last_ids.items() if name not in frames}, self.version)
