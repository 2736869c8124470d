"""Small hand-made table bundles."""

from datetime import datetime

from pyspark.sql import functions as F

from taskloom.model import SCHEMAS, Tables

NOW = "2024-05-01 12:00:00"
T0 = datetime(2024, 5, 1, 11, 0, 0)


def frame(spark, table, rows):
    """Rows given as dicts; columns left out are null."""
    schema = SCHEMAS[table]
    data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


def bundle(spark, **rows):
    return Tables({name: frame(spark, name, rows.get(name, [])) for name in SCHEMAS})


def agents(n, max_steps=3, max_retries=1):
    """n agents with a profile and a model each."""
    return {
        "agent_meta": [
            {"agent_id": i, "role_name": f"a{i}", "display_name": f"Agent {i}", "is_active": True, "created_at": T0}
            for i in range(1, n + 1)
        ],
        "agent_profiles": [
            {"profile_id": 1, "name": "p", "agent_role": "executor", "system_prompt": "be kind",
             "max_steps": max_steps, "max_retries": max_retries, "created_at": T0}
        ],
        "llm_configs": [
            {"llm_config_id": 1, "provider": "custom", "endpoint": "", "model_name": "m", "temperature": 0.7,
             "max_tokens": 10, "created_at": T0}
        ],
        "agent_profile_assignments": [
            {"assignment_id": i, "role_name": f"a{i}", "profile_id": 1, "llm_config_id": 1, "created_at": T0}
            for i in range(1, n + 1)
        ],
    }


def task(task_id, session_id=1, agent_id=1, status="pending", **more):
    row = {
        "task_id": task_id, "session_id": session_id, "agent_id": agent_id, "status": status, "input": f"in {task_id}",
        "retry_count": 0, "created_at": T0, "updated_at": T0,
    }
    return {**row, **more}


def session(session_id, agent_id=1, status="active"):
    return {"session_id": session_id, "agent_id": agent_id, "status": status, "goal": f"g{session_id}", "started_at": T0}


def rows(df, *columns, order=None):
    """Sorted tuples of the named columns."""
    found = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, (dict, list)) else str(v)) for v in r))


def commands(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("_", F.lit(0)).drop("_")
