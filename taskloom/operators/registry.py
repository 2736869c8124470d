"""Bulk maintenance of tools, agents, grants and flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import json_of, parsed, text_of
from ..model import (
    AGENT_ROLES,
    DEFAULT_INPUT_SCHEMA,
    DEFAULT_MAX_RETRIES,
    DEFAULT_MAX_STEPS,
    DEFAULT_MAX_TOKENS,
    DEFAULT_TEMPERATURE,
    FOREIGN_KEYS,
    KEYS,
    PROVIDERS,
    TOOL_TYPES,
    Principal,
    Tables,
)
from ..session import stage
from .delta import Delete, Upsert, apply_delta, assign_ids, instant, patch, typed
from .lifecycle import Outcome, require

#: Conflicting rows up to which the driver decides the rest.
DRIVER_CONFLICTS = 10_000

# Children before the tables that only lose a reference; a table stands after every table it points to.
_DROP_ORDER = (
    "agent_profile_assignments", "sessions", "session_participants", "tasks", "task_dependencies", "execution_logs",
    "memory", "agent_messages", "human_approvals", "agent_tool_permissions", "tool_executions", "flow_registry",
    "agent_events", "system_agent_configs",
)


def register_tools(t: Tables, configs: DataFrame, p: Principal, as_of: str | Column) -> Outcome:
    """Add tools from JSON configs (seq, config). Of several valid configs with one name the first is taken."""
    require(p.is_operator, "register_tools")
    now = instant(as_of)
    read = configs.withColumn("_v", parsed(F.col("config")))
    v = F.col("_v")
    fields = [
        *[text_of(v, c).alias(c) for c in ("name", "description", "tool_type", "mcp_server_url", "mcp_server_name",
                                           "http_endpoint", "custom_code", "runtime")],
        F.coalesce(json_of(v, "input_schema"), F.lit(DEFAULT_INPUT_SCHEMA)).alias("input_schema"),
        F.coalesce(text_of(v, "http_method"), F.lit("POST")).alias("http_method"),
        json_of(v, "http_headers").alias("http_headers"),
    ]
    kind = F.col("tool_type")
    missing_field = (
        ((kind == "mcp") & F.col("mcp_server_url").isNull())
        | ((kind == "http") & F.col("http_endpoint").isNull())
        | ((kind == "custom") & F.col("custom_code").isNull())
    )
    taken = t.tool_registry.select("name", F.lit(True).alias("_taken"))
    judged = read.select("seq", v.isNotNull().alias("_json"), *fields).join(taken, "name", "left")
    judged = judged.withColumn(
        "reason",
        F.when(~F.col("_json"), "bad_json")
        .when(F.col("name").isNull() | F.col("description").isNull() | kind.isNull(), "missing_field")
        .when(~kind.isin(*TOOL_TYPES), "bad_tool_type")
        .when(missing_field, "missing_type_field")
        .when(F.col("_taken"), "duplicate_name"),
    )
    valid = judged.where(F.col("reason").isNull())
    first = valid.groupBy("name").agg(F.min("seq").alias("_first"))
    ranked = valid.join(first, "name")
    accepted = assign_ids(ranked.where("seq = _first"), t.tool_registry, "tool_id", "seq")
    rejects = judged.where(F.col("reason").isNotNull()).select("seq", "reason").unionByName(
        ranked.where("seq <> _first").select("seq", F.lit("duplicate_name").alias("reason"))
    )
    rows = accepted.withColumns(
        {"mcp_server_status": F.lit("unknown"), "is_active": F.lit(True), "created_at": now, "updated_at": now}
    )
    tables = t.replace(tool_registry=t.tool_registry.unionByName(typed(rows, "tool_registry")))
    return Outcome(accepted.select("seq", "tool_id", "name"), rejects, tables)


def _number(v: Column, key: str, kind: str, default: float) -> tuple[Column, Column]:
    """(value or default, whether a given value cannot be read)."""
    given = text_of(v, key)
    value = F.try_variant_get(v, f"$.{key}", kind)
    return F.when(given.isNull(), F.lit(default).cast(kind)).otherwise(value), given.isNotNull() & value.isNull()


def _first_come(valid: DataFrame) -> DataFrame:
    """Rows that survive when conflicting rows (same role or same name) are admitted in `seq` order.

    Rows without a conflict are admitted at once. Of the others, a row that is first for both its role and its name is admitted in
    every round, and rows in conflict with an admitted row are out. A chain of n conflicts, each with the next, takes n / 2
    rounds; once no more than `DRIVER_CONFLICTS` rows are left, they are decided in one pass on the driver.
    """
    rows = stage(valid.select("seq", "role_name", "name"))
    free = rows
    for column in ("role_name", "name"):
        free = free.join(rows.groupBy(column).count().where("count = 1").select(column), column, "left_semi")
    free = stage(free.select("seq", "role_name", "name"))
    undecided = stage(rows.join(free.select("seq"), "seq", "left_anti").select("seq", "role_name", "name"))
    admitted: list[DataFrame] = [free]
    while undecided.limit(DRIVER_CONFLICTS + 1).count() > DRIVER_CONFLICTS:
        by_role = undecided.groupBy("role_name").agg(F.min("seq").alias("seq"))
        by_name = undecided.groupBy("name").agg(F.min("seq").alias("seq"))
        winners = stage(undecided.join(by_role, ["role_name", "seq"], "left_semi").join(by_name, ["name", "seq"], "left_semi"))
        admitted.append(winners)
        undecided = stage(
            undecided.join(winners.select("role_name"), "role_name", "left_anti").join(
                winners.select("name"), "name", "left_anti"
            )
        )
    roles, names, last = set(), set(), []
    for row in sorted(undecided.collect(), key=lambda r: r["seq"]):  # at most DRIVER_CONFLICTS small rows
        if row["role_name"] not in roles and row["name"] not in names:
            roles.add(row["role_name"])
            names.add(row["name"])
            last.append((row["seq"],))
    decided = rows.sparkSession.createDataFrame(last, rows.select("seq").schema)
    return reduce(DataFrame.unionByName, [a.select("seq") for a in admitted], decided)


def provision_agents(t: Tables, configs: DataFrame, p: Principal, as_of: str | Column) -> Outcome:
    """Add agents from JSON configs (seq, role_name, config): model settings, profile, identity, assignment and grants."""
    require(p.is_operator, "provision_agents")
    now = instant(as_of)
    read = configs.withColumn("_v", parsed(F.col("config")))
    v = F.col("_v")
    numbers = {
        "temperature": _number(v, "temperature", "double", DEFAULT_TEMPERATURE),
        "max_tokens": _number(v, "max_tokens", "int", DEFAULT_MAX_TOKENS),
        "max_steps": _number(v, "max_steps", "int", DEFAULT_MAX_STEPS),
        "max_retries": _number(v, "max_retries", "int", DEFAULT_MAX_RETRIES),
    }
    listed = F.try_variant_get(v, "$.tool_ids", "variant")
    tools = F.try_variant_get(v, "$.tool_ids", "array<bigint>")
    unreadable = [bad for _, bad in numbers.values()] + [
        listed.isNotNull() & (tools.isNull() | F.exists(tools, lambda x: x.isNull()))
    ]
    fields = read.select(
        "seq", "role_name",
        *[text_of(v, c).alias(c) for c in ("name", "agent_role", "provider", "model_name", "api_key_ref")],
        F.coalesce(text_of(v, "endpoint"), F.lit("")).alias("endpoint"),
        F.coalesce(text_of(v, "system_prompt"), F.lit("")).alias("system_prompt"),
        json_of(v, "request_options").alias("request_options"),
        *[value.alias(c) for c, (value, _) in numbers.items()],
        F.array_distinct(tools).alias("tool_ids"),
        reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for bad in unreadable]).alias("_bad"),
        v.isNotNull().alias("_json"),
    )
    wanted = fields.select("seq", F.explode("tool_ids").alias("tool_id"))
    unknown = wanted.join(t.tool_registry.select("tool_id"), "tool_id", "left_anti").select("seq").distinct()
    roles = t.agent_meta.select("role_name", F.lit(True).alias("_role"))
    names = t.agent_profiles.select("name", F.lit(True).alias("_name"))
    joined = (
        fields.join(unknown.withColumn("_unknown", F.lit(True)), "seq", "left")
        .join(roles, "role_name", "left")
        .join(names, "name", "left")
    )
    required = [F.col(c).isNull() for c in ("name", "agent_role", "provider", "model_name")]
    out_of_range = (
        ~F.col("temperature").between(0, 2) | (F.col("max_tokens") <= 0) | (F.col("max_steps") <= 0) | (F.col("max_retries") < 0)
    )
    judged = stage(
        joined.withColumn(
            "reason",
            F.when(~F.col("_json"), "bad_json")
            .when(F.col("role_name").isNull() | reduce(lambda a, b: a | b, required), "missing_field")
            .when(~F.col("agent_role").isin(*AGENT_ROLES) | ~F.col("provider").isin(*PROVIDERS), "bad_domain")
            .when(F.col("_bad"), "bad_value")
            .when(out_of_range, "out_of_range")
            .when(F.col("_role") | F.col("_name"), "duplicate")
            .when(F.col("_unknown"), "unknown_tool"),
        )
    )
    valid = judged.where(F.col("reason").isNull())
    admitted = _first_come(valid)
    rejects = judged.where(F.col("reason").isNotNull()).select("seq", "reason").unionByName(
        valid.join(admitted, "seq", "left_anti").select("seq", F.lit("duplicate").alias("reason"))
    )
    new = valid.join(admitted, "seq", "left_semi")
    for table, key in (("llm_configs", "llm_config_id"), ("agent_profiles", "profile_id"), ("agent_meta", "agent_id"),
                       ("agent_profile_assignments", "assignment_id")):
        new = assign_ids(new, t[table], key, "seq")
    new = new.withColumns({"display_name": F.col("name"), "is_active": F.lit(True), "created_at": now})
    grants = new.select("agent_id", F.explode("tool_ids").alias("tool_id"), now.alias("granted_at"))
    added = {table: t[table].unionByName(typed(new, table))
             for table in ("llm_configs", "agent_profiles", "agent_meta", "agent_profile_assignments")}
    tables = t.replace(
        **added,
        agent_tool_permissions=t.agent_tool_permissions.unionByName(typed(grants, "agent_tool_permissions")),
    )
    return Outcome(new.select("seq", "agent_id", "role_name"), rejects, tables)


def drop_agents(t: Tables, roles: DataFrame, p: Principal) -> Outcome:
    """Remove agents with everything that hangs on them; mere references to what is gone become null."""
    require(p.is_operator, "drop_agents")
    named = roles.select("role_name").distinct()
    known = t.agent_meta.select("agent_id", "role_name")
    gone: dict[str, DataFrame] = {"agent_meta": known.join(named, "role_name", "left_semi")}
    rejects = named.join(known, "role_name", "left_anti").select("role_name", F.lit("not_found").alias("reason"))
    frames = {"agent_meta": t.agent_meta.join(named, "role_name", "left_anti").select(*t.agent_meta.columns)}
    changes: dict[str, list[Delete | Upsert]] = {"agent_meta": [Delete(gone["agent_meta"].select("agent_id"), ("agent_id",))]}
    for table in _DROP_ORDER:
        rows = t[table]
        references = [fk for fk in FOREIGN_KEYS if fk.table == table and fk.parent in gone]
        lost: list[DataFrame] = []
        touched: list[Column] = []
        for fk in references:
            keys = gone[fk.parent].select(F.col(fk.parent_column).alias(fk.column)).distinct()
            if fk.on_delete == "cascade":
                lost.append(t[table].join(keys, fk.column, "left_semi").select(*KEYS[table]))
                rows = rows.join(keys, fk.column, "left_anti")
            elif fk.on_delete == "set null":
                mark = f"_gone_{fk.column}"
                touched.append(F.coalesce(F.col(mark), F.lit(False)))
                rows = rows.join(keys.withColumn(mark, F.lit(True)), fk.column, "left")
                rows = rows.withColumn(fk.column, F.when(F.col(mark).isNull(), F.col(fk.column)))
        frames[table] = rows.select(*t[table].columns)
        changes[table] = [Delete(reduce(DataFrame.unionByName, lost).distinct(), KEYS[table])] if lost else []
        if touched:
            changes[table].append(Upsert(rows.where(reduce(Column.__or__, touched)).select(*t[table].columns), KEYS[table]))
        if table in ("sessions", "tasks"):
            gone[table] = reduce(DataFrame.unionByName, lost).distinct()
    return Outcome(gone["agent_meta"], rejects, t.replace(**frames), {name: steps for name, steps in changes.items() if steps})


def grant_tools(t: Tables, pairs: DataFrame, p: Principal, as_of: str | Column) -> Tables:
    """Grant (agent_id, tool_id); existing grants stay as they are."""
    require(p.is_operator, "grant_tools")
    wanted = pairs.select("agent_id", "tool_id").distinct().withColumn("granted_at", instant(as_of))
    delta = typed(wanted, "agent_tool_permissions")
    return t.replace(
        agent_tool_permissions=apply_delta(t.agent_tool_permissions, delta, ["agent_id", "tool_id"], "ignore").select(
            *t.agent_tool_permissions.columns
        )
    )


def revoke_tools(t: Tables, pairs: DataFrame, p: Principal) -> Tables:
    require(p.is_operator, "revoke_tools")
    left = apply_delta(t.agent_tool_permissions, pairs, ["agent_id", "tool_id"], "delete")
    return t.replace(agent_tool_permissions=left.select(*t.agent_tool_permissions.columns))


def register_flows(t: Tables, flows: DataFrame, p: Principal, as_of: str | Column) -> Tables:
    """Upsert flows (seq, flow_name, agent_id, webhook_url) by name; an update changes agent and webhook only."""
    require(p.is_operator, "register_flows")
    last = flows.groupBy("flow_name").agg(
        F.min("seq").alias("seq"), F.max(F.struct("seq", "agent_id", "webhook_url")).alias("_last")
    ).select("seq", "flow_name", "_last.agent_id", "_last.webhook_url")
    updates = last.select("flow_name", "agent_id", "webhook_url")
    new = assign_ids(last.join(t.flow_registry.select("flow_name"), "flow_name", "left_anti"), t.flow_registry, "flow_id", "seq")
    rows = new.withColumns({"is_active": F.lit(True), "created_at": instant(as_of)})
    patched = patch(t.flow_registry, updates, "flow_name")
    return t.replace(flow_registry=patched.unionByName(typed(rows, "flow_registry")))
