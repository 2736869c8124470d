"""Deletion of compressed logs and of old events."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEEP_EVENT_DAYS, PURGE_QUALITY, Principal, Tables
from .delta import Delete, DeleteBefore, instant
from .lifecycle import require


@dataclass(frozen=True)
class Purged:
    """The tables without the purged rows, and the deletion as a change for a store."""

    tables: Tables
    report: DataFrame
    changes: Mapping[str, Delete | DeleteBefore]


def purge_report(t: Tables, task_ids: DataFrame, min_quality: float = PURGE_QUALITY) -> DataFrame:
    """Per asked task: log rows, and whether a row that is uncompressed or of low quality blocks the purge.

    A row without a quality does not block.
    """
    bad = F.col("compressed_at").isNull() | F.coalesce(F.col("compression_quality") < min_quality, F.lit(False))
    wanted = task_ids.select("task_id").distinct()
    logs = t.execution_logs.join(wanted, "task_id", "left_semi")
    state = logs.groupBy("task_id").agg(F.count(F.lit(1)).alias("_rows"), F.bool_or(bad).alias("_bad"))
    asked = wanted.join(state, "task_id", "left")
    blocked = F.coalesce("_bad", F.lit(False))
    rows = F.coalesce("_rows", F.lit(0).cast("long"))
    return asked.select(
        "task_id", blocked.alias("blocked"), F.when(blocked, F.lit(0).cast("long")).otherwise(rows).alias("deleted")
    )


def purge_compressed(t: Tables, p: Principal, task_ids: DataFrame, min_quality: float = PURGE_QUALITY) -> Purged:
    """Delete the logs of the asked tasks that nothing blocks."""
    require(p.privileged, "purge_compressed")
    report = purge_report(t, task_ids, min_quality)
    free = report.where(~F.col("blocked")).select("task_id")
    kept = t.execution_logs.join(free, "task_id", "left_anti").select(*t.execution_logs.columns)
    lost = t.execution_logs.join(free, "task_id", "left_semi").select("log_id")
    return Purged(t.replace(execution_logs=kept), report, {"execution_logs": Delete(lost, ("log_id",))})


def purge_events(t: Tables, p: Principal, as_of: str | Column, keep_days: int = KEEP_EVENT_DAYS) -> Purged:
    """Delete events older than `keep_days`. The condition reaches the scan, where row groups without old events are skipped."""
    require(p.privileged, "purge_events")
    limit = instant(as_of) - F.make_dt_interval(days=F.lit(keep_days))
    limit = t.agent_events.sparkSession.range(1).select(limit.cast("string")).first()[0]
    old = F.col("created_at") < F.lit(limit).cast("timestamp")
    kept = t.agent_events.where(~old)
    report = t.agent_events.where(old).agg(F.count(F.lit(1)).alias("deleted"))
    return Purged(t.replace(agent_events=kept), report, {"agent_events": DeleteBefore("created_at", limit)})
