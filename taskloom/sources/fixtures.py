"""Control-plane tables and command inputs derived from the driver's star schema (FIXTURES.md).

The column expressions are plain SQL read by both engines; the row sources are built with the DataFrame API here and
written as SQL text for the oracle (`oracle_ctes`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import running
from ..model import SCHEMAS, Tables

# Fixed clocks of the fixtures.
AS_OF = "1998-06-15 00:05:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

# Schemas of the driver tables. Their timestamps are stored without a zone; reading them as `timestamp`
# (session zone UTC) keeps filters on them pushable to the scan, which a cast would not.
DRIVER_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_START = "TIMESTAMP '1995-01-01 00:00:00'"
_LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus"
)
_STEPS = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS step FROM lineitem) x"


@dataclass(frozen=True)
class Derived:
    """A derived table: oracle row source, column expressions, tables it needs first."""

    source: str
    columns: dict[str, str]
    needs: tuple[str, ...] = ()
    group_by: str = ""

    def sql(self) -> str:
        listed = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        tail = f" GROUP BY {self.group_by}" if self.group_by else ""
        return f"SELECT {listed} FROM {self.source}{tail}"


DERIVED: dict[str, Derived] = {
    "embedding_config": Derived(
        "(SELECT 1 AS id, 'model-old' AS m, 32 AS d, FALSE AS a UNION ALL SELECT 2, 'model-a', 64, TRUE) x",
        {
            "config_id": "id",
            "model_name": "m",
            "dimensions": "d",
            "endpoint": "'local'",
            "is_active": "a",
            "activated_at": _START,
        },
    ),
    "llm_configs": Derived(
        "region",
        {
            "llm_config_id": "r_regionkey + 1",
            "provider": "CASE r_regionkey % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'ollama' "
            "ELSE 'custom' END",
            "endpoint": "''",
            "model_name": "lower(r_name)",
            "api_key_ref": "CAST(NULL AS STRING)",
            "temperature": "CAST(0.7 AS DOUBLE)",
            "max_tokens": "4096",
            "request_options": "CAST(NULL AS STRING)",
            "created_at": _START,
        },
    ),
    "agent_profiles": Derived(
        "nation",
        {
            "profile_id": "n_nationkey + 1",
            "name": "n_name",
            "agent_role": "CASE n_regionkey % 3 WHEN 0 THEN 'orchestrator' WHEN 1 THEN 'executor' ELSE 'evaluator' END",
            "system_prompt": "CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('You are ', n_name) END",
            "max_steps": "1 + n_nationkey % 5",
            "max_retries": "n_nationkey % 3",
            "created_at": _START,
        },
    ),
    "agent_meta": Derived(
        "supplier",
        {
            "agent_id": "s_suppkey",
            "role_name": "concat('agent_', s_suppkey)",
            "display_name": "s_name",
            "is_active": "s_suppkey % 10 <> 9",
            "created_at": f"{_START} + s_suppkey * INTERVAL '1' SECOND",
        },
    ),
    "agent_profile_assignments": Derived(
        "supplier WHERE s_suppkey % 10 <> 8",
        {
            "assignment_id": "s_suppkey",
            "role_name": "concat('agent_', s_suppkey)",
            "profile_id": "s_nationkey + 1",
            "llm_config_id": "s_suppkey % 5 + 1",
            "created_at": _START,
        },
    ),
    "sessions": Derived(
        "orders",
        {
            "session_id": "o_custkey",
            "agent_id": "o_custkey % 10",
            "status": "CASE o_custkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'active' END",
            "goal": "concat('goal ', o_custkey)",
            "final_answer": "CASE WHEN o_custkey % 5 = 0 THEN concat('answer ', o_custkey) END",
            "started_at": "min(o_orderdate)",
            "completed_at": "CASE WHEN o_custkey % 5 < 2 THEN max(o_orderdate) END",
        },
        group_by="o_custkey",
    ),
    "session_participants": Derived(
        "orders",
        {"session_id": "o_custkey", "agent_id": "o_orderkey % 10", "joined_at": "min(o_orderdate)"},
        group_by="o_custkey, o_orderkey % 10",
    ),
    "tasks": Derived(
        "(SELECT *, CAST(floor(o_orderkey / 10) AS BIGINT) % 12 AS k FROM orders) x",
        {
            "task_id": "o_orderkey",
            "session_id": "o_custkey",
            "agent_id": "o_orderkey % 10",
            "status": "CASE WHEN k < 2 THEN 'pending' WHEN k < 4 THEN 'waiting' WHEN k < 6 THEN 'running' "
            "WHEN k < 10 THEN 'completed' WHEN k = 10 THEN 'failed' ELSE 'cancelled' END",
            "input": "concat('task ', o_orderkey, ' ', o_orderpriority)",
            "output": "CASE WHEN k >= 6 AND k < 10 AND o_orderkey % 7 <> 0 THEN concat('answer ', o_orderkey) "
            "WHEN k = 10 THEN 'rejected' END",
            "retry_count": "o_orderkey % 4",
            "heartbeat_at": "CASE WHEN k IN (4, 5) AND o_orderkey % 3 <> 0 "
            "THEN o_orderdate + (o_orderkey % 900) * INTERVAL '1' SECOND END",
            "created_at": "o_orderdate",
            "updated_at": "o_orderdate + (o_orderkey % 600) * INTERVAL '1' SECOND",
        },
    ),
    "task_dependencies": Derived(
        "(SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) x "
        "WHERE prev IS NOT NULL AND o_orderkey % 3 = 0",
        {"dependency_id": "o_orderkey", "task_id": "o_orderkey", "depends_on_task_id": "prev"},
    ),
    "execution_logs": Derived(
        _STEPS,
        {
            "log_id": "l_orderkey * 1000 + step",
            "task_id": "l_orderkey",
            "step_number": "CAST(step AS INT)",
            "role": "CASE WHEN step = 1 AND l_orderkey % 2 = 0 THEN 'user' WHEN step % 3 = 0 THEN 'tool' "
            "ELSE 'assistant' END",
            "content": "concat('step ', step, ' part ', l_partkey)",
            "compressed_content": "CAST(NULL AS STRING)",
            "compression_quality": "CASE WHEN l_orderkey % 3 = 0 OR l_linenumber % 2 = 0 "
            "THEN round(1 - l_discount - l_tax / 4, 4) END",
            "compressed_at": "CASE WHEN l_orderkey % 3 = 0 OR l_linenumber % 2 = 0 THEN l_shipdate END",
            "created_at": "l_shipdate",
        },
    ),
    "memory": Derived(
        "embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id",
        {
            "memory_id": "vec_id",
            "agent_id": "label",
            "session_id": "vec_id % 100",
            "content": "coalesce(text, '')",
            "embedding": "CASE WHEN vec_id % 13 <> 0 THEN embedding END",
            "embedding_dims": "CASE WHEN vec_id % 13 = 0 THEN NULL WHEN vec_id % 17 = 0 THEN 32 ELSE 64 END",
            "created_at": "TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL '1' MINUTE",
        },
    ),
    "agent_messages": Derived(
        "task_dependencies td JOIN tasks pt ON pt.task_id = td.task_id "
        "JOIN tasks ct ON ct.task_id = td.depends_on_task_id "
        "CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1) k "
        "WHERE kind = 0 OR (ct.status = 'completed' AND ct.output IS NOT NULL)",
        {
            "message_id": "td.dependency_id * 2 + kind",
            "from_agent_id": "CASE kind WHEN 0 THEN pt.agent_id ELSE ct.agent_id END",
            "to_agent_id": "CASE kind WHEN 0 THEN ct.agent_id ELSE pt.agent_id END",
            "session_id": "pt.session_id",
            "parent_task_id": "pt.task_id",
            "child_task_id": "ct.task_id",
            "direction": "CASE kind WHEN 0 THEN 'instruction' ELSE 'result' END",
            "status": "CASE WHEN td.dependency_id % 11 = 0 THEN 'pending' ELSE 'delivered' END",
            "content": "CASE kind WHEN 0 THEN ct.input ELSE ct.output END",
            "created_at": "ct.updated_at + kind * INTERVAL '1' SECOND",
        },
        needs=("tasks", "task_dependencies"),
    ),
    "human_approvals": Derived(
        "tasks WHERE status IN ('waiting', 'failed') AND task_id % 2 = 0",
        {
            "approval_id": "task_id",
            "task_id": "task_id",
            "session_id": "session_id",
            "requested_by_agent_id": "agent_id",
            "reason": "concat('approve ', task_id)",
            "status": "CASE WHEN status = 'waiting' THEN 'pending' ELSE 'rejected' END",
            "resolved_by": "CASE WHEN status = 'failed' THEN 'operator' END",
            "resolved_at": "CASE WHEN status = 'failed' THEN updated_at END",
            "resolution_note": "CAST(NULL AS STRING)",
            "created_at": "created_at",
        },
        needs=("tasks",),
    ),
    "tool_registry": Derived(
        "part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey % 500",
        {
            "tool_id": "p_partkey",
            "name": "concat('tool_', p_partkey)",
            "description": "concat(p_name, ' ', p_brand, ' ', p_type)",
            "input_schema": "'{\"type\":\"object\",\"properties\":{}}'",
            "tool_type": "CASE p_size % 4 WHEN 0 THEN 'mcp' WHEN 1 THEN 'sql' WHEN 2 THEN 'http' ELSE 'custom' END",
            "mcp_server_url": "CASE WHEN p_size % 4 = 0 THEN 'http://mcp' END",
            "mcp_server_name": "CASE WHEN p_size % 4 = 0 THEN 'mcp' END",
            "mcp_server_status": "CAST(NULL AS STRING)",
            "mcp_last_health_check": "CAST(NULL AS TIMESTAMP)",
            "http_endpoint": "CASE WHEN p_size % 4 = 2 AND p_partkey % 50 <> 0 THEN 'http://api' END",
            "http_method": "'POST'",
            "http_headers": "CAST(NULL AS STRING)",
            "custom_code": "CASE WHEN p_size % 4 = 3 THEN 'pass' END",
            "runtime": "CASE WHEN p_size % 4 = 3 THEN 'python' END",
            "description_embedding": "CASE WHEN p_partkey % 7 <> 0 THEN embedding END",
            "embedding_dims": "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 32 ELSE 64 END",
            "is_active": "p_partkey % 10 <> 0",
            "created_at": _START,
            "updated_at": _START,
        },
    ),
    "agent_tool_permissions": Derived(
        "lineitem",
        {"agent_id": "l_suppkey", "tool_id": "l_partkey", "granted_at": "min(l_shipdate)"},
        group_by="l_suppkey, l_partkey",
    ),
    "tool_executions": Derived(
        f"{_STEPS} WHERE l_partkey % 23 <> 1",
        {
            "exec_id": "l_orderkey * 1000 + step",
            "task_id": "l_orderkey",
            "tool_id": "l_partkey",
            "input": "concat('{\"q\":', l_linenumber, '}')",
            "output": "CASE WHEN l_returnflag <> 'R' THEN 'ok' END",
            "error": "CASE WHEN l_returnflag = 'R' THEN 'failed' END",
            "duration_ms": "CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity * 10 AS INT) END",
            "executed_at": "l_shipdate + (l_partkey % 1440) * INTERVAL '1' MINUTE",
        },
    ),
    "flow_registry": Derived(
        "supplier",
        {
            "flow_id": "s_suppkey",
            "flow_name": "concat('flow_', s_suppkey)",
            "agent_id": "s_suppkey",
            "webhook_url": "CAST(NULL AS STRING)",
            "is_active": "TRUE",
            "created_at": _START,
        },
    ),
    "agent_events": Derived(
        "events",
        {
            "event_id": "event_id",
            "agent_id": "CASE WHEN user_id % 12 < 10 THEN user_id % 12 END",
            "session_id": "user_id",
            "task_id": "CASE WHEN event_type <> 'signup' THEN event_id % 1000 END",
            "event_type": "CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'task_start' "
            "WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'tool_result' ELSE 'task_end' END",
            "payload": "props",
            "created_at": "ts",
        },
    ),
    "sql_sandbox_allowlist": Derived(
        "(SELECT 'public.v_my_tasks' AS v UNION ALL SELECT 'public.v_my_memory' UNION ALL SELECT 'public.v_my_tools' "
        "UNION ALL SELECT 'public.v_session_progress' UNION ALL SELECT 'public.v_ready_tasks') x",
        {"view_name": "v", "description": "v", "created_at": _START},
    ),
    "system_agent_configs": Derived(
        "(SELECT 1 AS id, 'compressor' AS a, 3600 AS s, '{\"compress_after_steps\":5}' AS j "
        "UNION ALL SELECT 2, 'embedder', 600, '{\"batch_size\":20}') x",
        {
            "config_id": "id",
            "agent_type": "a",
            "is_enabled": "FALSE",
            "role_name": "CASE WHEN id = 1 THEN 'agent_0' END",
            "run_interval_secs": "s",
            "settings": "j",
            "last_run_at": "CASE WHEN id = 2 THEN TIMESTAMP '1998-06-15 00:00:00' END",
            "updated_at": _START,
        },
    ),
}

COMMANDS: dict[str, Derived] = {
    "responses": Derived(
        "(SELECT *, (conv_id + turn) % 8 AS k FROM conversations WHERE role = 'assistant') x",
        {
            "seq": "conv_id * 100000 + turn",
            "task_id": "conv_id",
            "response": "CASE k WHEN 0 THEN '{\"action\":\"finish\",\"final_answer\":\"done\"}' "
            "WHEN 1 THEN concat('{\"action\":\"call_tool\",\"tool_name\":\"tool_', (conv_id * 7 + turn) % 200, "
            "'\",\"args\":{\"q\":1}}') "
            "WHEN 2 THEN concat('{\"action\":\"delegate\",\"to_agent\":\"agent_', conv_id % 12, "
            "'\",\"task\":\"sub\"}') "
            "WHEN 3 THEN '{\"action\":\"request_approval\",\"reason\":\"check\"}' "
            "WHEN 4 THEN '{\"action\":\"ponder\"}' WHEN 5 THEN 'plain words' WHEN 6 THEN '42' "
            "ELSE '{\"action\":\"finish\"} trailing' END",
            "is_final": "conv_id % 25 = 0",
        },
    ),
    # One query per agent, the mean of its vectors: it reads the whole table and the number of queries stays small.
    "search_queries": Derived(
        "(SELECT label, list(v ORDER BY pos) AS centre FROM (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM "
        "(SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) "
        "GROUP BY label, pos) GROUP BY label) x",
        {"query_id": "CAST(label AS BIGINT)", "agent_id": "CAST(label AS BIGINT)", "query_vec": "centre"},
    ),
    "enqueue_requests": Derived(
        "customer",
        {
            "request_id": "c_custkey",
            "agent_role": "concat('agent_', c_custkey % 13)",
            "task": "CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_mktsegment END",
            "session_id": "CASE WHEN c_custkey % 4 = 0 THEN c_custkey END",
        },
    ),
    "approval_decisions": Derived(
        "human_approvals",
        {
            "approval_id": "approval_id",
            "status": "CASE WHEN approval_id % 3 = 0 THEN 'approved' WHEN approval_id % 3 = 1 THEN 'rejected' "
            "ELSE 'maybe' END",
            "note": "CASE WHEN approval_id % 4 = 0 THEN 'note' END",
        },
        needs=("human_approvals",),
    ),
    "sql_requests": Derived(
        "events",
        {
            "request_id": "event_id",
            "sql_text": "CASE event_id % 7 WHEN 0 THEN 'SELECT * FROM public.v_my_tasks' "
            "WHEN 1 THEN 'SELECT 1 FROM public.secret' WHEN 2 THEN 'DELETE FROM public.v_my_tasks' "
            "WHEN 3 THEN 'SELECT 1 FROM public.v_my_tasks; SELECT 2' WHEN 4 THEN '-- only a comment' "
            "WHEN 5 THEN 'SELECT 1' ELSE 'select /* c */ x from PUBLIC.V_MY_TOOLS' END",
        },
    ),
    "task_changes": Derived(
        "tasks CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) x",
        {
            "task_id": "task_id",
            "session_id": "session_id",
            "agent_id": "agent_id",
            "status": "CASE n WHEN 0 THEN 'pending' ELSE status END",
            "ts": "CASE n WHEN 0 THEN created_at ELSE updated_at + INTERVAL '1' SECOND END",
        },
        needs=("tasks",),
    ),
    "heartbeats": Derived(
        "events",
        {
            "task_id": "user_id",
            "status": "CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'running' END",
            "ts": "ts",
        },
    ),
    # Status changes of sessions, one per order, on distinct instants.
    "session_changes": Derived(
        "orders",
        {
            "session_id": "o_custkey",
            "agent_id": "o_custkey % 10",
            "status": "CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'active' END",
            "final_answer": "CASE WHEN o_orderkey % 3 <> 0 THEN concat('answer ', o_orderkey) END",
            "ts": "o_orderdate + o_orderkey * INTERVAL '1' MICROSECOND",
        },
    ),
    # Tool configurations, valid and not, with names that repeat.
    "tool_configs": Derived(
        "part",
        {
            "seq": "p_partkey",
            "config": "CASE p_partkey % 6 WHEN 0 THEN concat('{\"name\":\"new_', p_partkey % 90, "
            "'\",\"description\":\"d\",\"tool_type\":\"sql\"}') "
            "WHEN 1 THEN concat('{\"name\":\"web_', p_partkey, "
            "'\",\"description\":\"d\",\"tool_type\":\"http\",\"http_endpoint\":\"x\",\"http_method\":\"GET\"}') "
            "WHEN 2 THEN concat('{\"name\":\"mcp_', p_partkey, '\",\"description\":\"d\",\"tool_type\":\"mcp\"}') "
            "WHEN 3 THEN concat('{\"name\":\"tool_', p_partkey, '\",\"description\":\"d\",\"tool_type\":\"sql\"}') "
            "WHEN 4 THEN '{\"name\":\"nameless\"' "
            "ELSE concat('{\"name\":\"odd_', p_partkey, '\",\"description\":\"d\",\"tool_type\":\"magic\"}') END",
        },
    ),
    # Agent configurations, valid and not; role and profile name repeat together.
    "agent_configs": Derived(
        "customer",
        {
            "seq": "c_custkey",
            "role_name": "concat('new_', c_custkey % 400)",
            "config": "concat('{\"name\":\"Name ', c_custkey % 400, '\",\"agent_role\":\"', "
            "CASE c_custkey % 7 WHEN 0 THEN 'boss' ELSE 'executor' END, '\",\"provider\":\"ollama\"', "
            "CASE c_custkey % 7 WHEN 1 THEN '' ELSE ',\"model_name\":\"m\"' END, "
            "CASE c_custkey % 7 WHEN 2 THEN ',\"max_steps\":\"zz\"' WHEN 3 THEN ',\"temperature\":5' "
            "WHEN 4 THEN ',\"max_steps\":8,\"temperature\":0.3' ELSE '' END, "
            "',\"tool_ids\":[', c_custkey % 100, ',', c_custkey % 100, ']}')",
        },
    ),
    # Flow registrations that repeat names.
    "flow_requests": Derived(
        "customer",
        {
            "seq": "c_custkey",
            "flow_name": "concat('flow_', c_custkey % 150)",
            "agent_id": "c_custkey % 10",
            "webhook_url": "concat('http://hook/', c_custkey)",
        },
    ),
    # Embedding payloads in the accepted notations and in unusable ones.
    "vector_payloads": Derived(
        "embeddings",
        {
            "item_id": "vec_id",
            "payload": "CASE vec_id % 6 WHEN 0 THEN concat('[', array_to_string(embedding, ','), ']') "
            "WHEN 1 THEN concat('{\"vector\":[', array_to_string(embedding, ','), ']}') "
            "WHEN 2 THEN concat('{\"embedding\":[],\"data\":[', array_to_string(embedding, ','), ']}') "
            "WHEN 3 THEN '[]' WHEN 4 THEN '[\"a\",1]' ELSE concat('{\"other\":[', vec_id, ']}') END",
        },
    ),
}


def oracle_ctes(*names: str) -> str:
    """`WITH a AS (…), b AS (…)` for the named derived tables and whatever they need, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        spec = DERIVED.get(name) or COMMANDS[name]
        for needed in spec.needs:
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({(DERIVED.get(name) or COMMANDS[name]).sql()})" for name in ordered]
    return "WITH " + ", ".join(parts)


class _Driver:
    """Typed scans of the driver tables, as tables or as file streams."""

    def __init__(self, spark: SparkSession, directory: str, live: bool = False):
        self.spark = spark
        self.directory = directory
        self.live = live

    def scan(self, name: str) -> DataFrame:
        if self.live:
            source = self.spark.readStream.schema(DRIVER_DDL[name]).option("pathGlobFilter", f"{name}.parquet")
            return source.parquet(self.directory)
        return self.spark.read.schema(DRIVER_DDL[name]).parquet(f"{self.directory}/{name}.parquet")

    def constant(self, source: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {source}")

    def steps(self) -> DataFrame:
        """lineitem with a step number per order; an order of very many lines is cut every 1,024 line numbers."""
        counted = running(
            self.scan("lineitem"),
            ["l_orderkey"],
            _LINE_ORDER.split(", "),
            {"step": ("sum", F.lit(1).cast("long"))},
            bucket=[F.shiftright("l_linenumber", 10)],
        )
        return counted.withColumn("step", F.col("step") + 1)

    def numbered_orders(self) -> DataFrame:
        """orders with the previous order of the same customer."""
        return running(
            self.scan("orders").select("o_orderkey", "o_custkey"),
            ["o_custkey"],
            ["o_orderkey"],
            {"prev": ("max", F.col("o_orderkey"))},
        )


def _centres(embeddings: DataFrame) -> DataFrame:
    """Mean vector per label. The collected list has one entry per vector component."""
    parts = embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("label").agg(F.transform(listed, lambda x: x["v"]).alias("centre"))


def _row_source(driver: _Driver, tables: Tables, name: str) -> DataFrame:
    scan = driver.scan
    if name in ("embedding_config", "sql_sandbox_allowlist", "system_agent_configs"):
        return driver.constant(DERIVED[name].source)
    if name == "llm_configs":
        return scan("region")
    if name == "agent_profiles":
        return scan("nation")
    if name in ("agent_meta", "flow_registry"):
        return scan("supplier")
    if name == "agent_profile_assignments":
        return scan("supplier").where("s_suppkey % 10 <> 8")
    if name == "tasks":
        return scan("orders").withColumn("k", F.expr("CAST(floor(o_orderkey / 10) AS BIGINT) % 12"))
    if name == "task_dependencies":
        return driver.numbered_orders().where("prev IS NOT NULL AND o_orderkey % 3 = 0")
    if name == "execution_logs":
        return driver.steps()
    if name == "memory":
        documents = scan("documents").select("doc_id", "text")
        return scan("embeddings").join(documents, F.col("doc_id") == F.col("vec_id"), "left")
    if name == "agent_messages":
        td, tasks = tables.task_dependencies, tables.tasks
        joined = (
            td.alias("td")
            .join(tasks.alias("pt"), F.expr("pt.task_id = td.task_id"))
            .join(tasks.alias("ct"), F.expr("ct.task_id = td.depends_on_task_id"))
            .withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1))))
        )
        return joined.where("kind = 0 OR (ct.status = 'completed' AND ct.output IS NOT NULL)")
    if name == "human_approvals":
        return tables.tasks.where("status IN ('waiting', 'failed') AND task_id % 2 = 0")
    if name == "tool_registry":
        vectors = scan("embeddings").select("vec_id", "embedding")
        return scan("part").join(vectors, F.expr("vec_id = p_partkey % 500"), "left")
    if name == "tool_executions":
        return driver.steps().where("l_partkey % 23 <> 1")
    if name == "agent_events":
        return scan("events")
    raise KeyError(name)


def _build(driver: _Driver, tables: Tables, name: str) -> DataFrame:
    spec = DERIVED[name]
    selected = [F.expr(e).alias(c) for c, e in spec.columns.items()]
    if spec.group_by:
        keys = [F.expr(k) for k in spec.group_by.split(", ")]
        return _typed(driver.scan(spec.source).groupBy(*keys).agg(*selected), name)
    return _typed(_row_source(driver, tables, name).select(*selected), name)


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def _bundle(driver: _Driver) -> Tables:
    tables = Tables({name: (lambda name=name: _build(driver, tables, name)) for name in SCHEMAS})
    return tables


def from_driver_tables(spark: SparkSession, directory: str) -> Tables:
    """The 20 control-plane tables over the driver's Parquet files."""
    return _bundle(_Driver(spark, directory))


def live_tables(spark: SparkSession, directory: str) -> Tables:
    """The same tables as file streams, for those derived row by row (tasks, approvals, events)."""
    return _bundle(_Driver(spark, directory, live=True))


def live_tool_calls(spark: SparkSession, directory: str) -> DataFrame:
    """(task_id, tool_id, executed_at) of tool executions as a file stream; their ids need an order and have no stream."""
    columns = DERIVED["tool_executions"].columns
    rows = _Driver(spark, directory, live=True).scan("lineitem").where("l_partkey % 23 <> 1")
    return rows.select(*[F.expr(columns[c]).alias(c) for c in ("task_id", "tool_id")], F.expr(columns["executed_at"]).cast("timestamp").alias("executed_at"))


def command(spark: SparkSession, directory: str, name: str, live: bool = False) -> DataFrame:
    """A command input of FIXTURES.md, as a table or as a file stream."""
    driver = _Driver(spark, directory, live)
    tables = _bundle(driver)
    columns = dict(COMMANDS[name].columns)
    if name == "responses":
        source = driver.scan("conversations").where("role = 'assistant'")
        source = source.withColumn("k", F.expr("(conv_id + turn) % 8"))
    elif name == "search_queries":
        source = _centres(driver.scan("embeddings"))
    elif name in ("enqueue_requests", "agent_configs", "flow_requests"):
        source = driver.scan("customer")
    elif name == "tool_configs":
        source = driver.scan("part")
    elif name == "session_changes":
        source = driver.scan("orders")
    elif name == "approval_decisions":
        source = tables.human_approvals
    elif name in ("sql_requests", "heartbeats"):
        source = driver.scan("events")
    elif name == "task_changes":
        source = tables.tasks.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    elif name == "vector_payloads":
        source = driver.scan("embeddings")
        columns["payload"] = columns["payload"].replace("array_to_string", "array_join")
    else:
        raise KeyError(name)
    return source.select(*[F.expr(e).alias(c) for c, e in columns.items()])
