"""The mutation primitives: every change is a (base, delta) pair that yields a new frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import numbered, placed, running
from ..model import SCHEMAS

MODES = ("upsert", "ignore", "delete")


def instant(as_of: str | Column) -> Column:
    """The explicit clock of a time-dependent operator."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def apply_delta(base: DataFrame, delta: DataFrame, key: Sequence[str], mode: str = "upsert") -> DataFrame:
    """New state of `base`. `delta` has the columns of `base` (only the key is needed to delete) and a unique key.

    upsert replaces or adds rows, ignore adds only rows whose key is new, delete removes rows.
    """
    key = list(key)
    if mode == "upsert":
        return base.join(delta.select(*key), key, "left_anti").unionByName(delta)
    if mode == "ignore":
        return base.unionByName(delta.join(base.select(*key), key, "left_anti"))
    if mode == "delete":
        return base.join(delta.select(*key), key, "left_anti")
    raise ValueError(f"mode must be one of {MODES}")


def patch(base: DataFrame, changes: DataFrame, key: str, touch: str | Column | None = None) -> DataFrame:
    """Overwrite the columns `changes` carries on the rows whose key it names; with `touch` also set updated_at."""
    return _patched(base, changes, key, touch, "left")


def patched(base: DataFrame, changes: DataFrame, key: str, touch: str | Column | None = None) -> DataFrame:
    """Only the rows that `patch` changes."""
    return _patched(base, changes, key, touch, "inner")


def _patched(base: DataFrame, changes: DataFrame, key: str, touch: str | Column | None, how: str) -> DataFrame:
    news = [c for c in changes.columns if c != key]
    delta = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in news])
    hit = F.col("_hit")

    def value(column: str) -> Column:
        if column in news:
            return F.when(hit, F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column)
        if touch is not None and column == "updated_at":
            return F.when(hit, instant(touch)).otherwise(F.col(column)).alias(column)
        return F.col(column)

    return base.join(delta, key, how).select(*[value(c) for c in base.columns])


def touch_updated_at(delta: DataFrame, as_of: str | Column) -> DataFrame:
    """What any update of tasks, tools or system-agent settings does to its row."""
    return delta.withColumn("updated_at", instant(as_of))


@dataclass(frozen=True)
class Append:
    """New rows of a table that only grows."""

    rows: DataFrame

    def after(self, base: DataFrame) -> DataFrame:
        return base.unionByName(self.rows)


@dataclass(frozen=True)
class Upsert:
    """Rows that replace those of their key, or are new."""

    rows: DataFrame
    key: tuple[str, ...]

    def after(self, base: DataFrame) -> DataFrame:
        return apply_delta(base, self.rows, self.key)


@dataclass(frozen=True)
class Delete:
    """Keys whose rows go."""

    rows: DataFrame
    key: tuple[str, ...]

    def after(self, base: DataFrame) -> DataFrame:
        return apply_delta(base, self.rows, self.key, "delete")


@dataclass(frozen=True)
class DeleteBefore:
    """Rows go whose time lies before a limit; rows without a time stay."""

    column: str
    limit: datetime | str

    def gone(self) -> Column:
        return F.col(self.column) < F.lit(self.limit).cast("timestamp")

    def after(self, base: DataFrame) -> DataFrame:
        return base.where(~F.coalesce(self.gone(), F.lit(False)))


def first_free(base: DataFrame, key: str, last: int | None = None) -> Column:
    """The first id not taken: after `last` where the caller knows it, else after the largest in `base`."""
    if last is not None:
        return F.lit(last + 1).cast("long")
    return F.coalesce(base.agg(F.max(F.col(key).cast("long"))).scalar(), F.lit(0).cast("long")) + 1


def assign_ids(
    delta: DataFrame, base: DataFrame, key: str, order: str, out: str | None = None, last: int | None = None
) -> DataFrame:
    """Number new rows max(key)+1, max(key)+2 … in the order of a unique integer column, in column `out` (or `key`).

    `last` is the largest key where the caller knows it (a store does), else it is read from `base`. The numbers come from
    per-bucket ranks plus prefix sums of the bucket sizes over the order column alone, so no task sorts the delta and a recomputed
    task gets the same ids again.
    """
    start = first_free(base, key, last)
    return numbered(delta, [order], "_rank").withColumn(out or key, start + F.col("_rank") - 1).drop("_rank")


def typed(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in declared order and type; columns the frame lacks are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table].fields
        ]
    )


def log_events(events: DataFrame, commands: DataFrame, as_of: str | Column, last: int | None = None) -> DataFrame:
    """Event rows to append for commands (seq, agent_id, session_id, task_id, event_type, payload)."""
    rows = assign_ids(commands, events, "event_id", "seq", last=last).withColumn("created_at", instant(as_of))
    return typed(rows, "agent_events")


def log_steps(logs: DataFrame, new_steps: DataFrame, as_of: str | Column, last: int | None = None) -> DataFrame:
    """Log rows to append for (seq, task_id, role, content): steps continue after the task's largest step.

    Only the logs of the tasks addressed are aggregated.
    """
    narrow = placed(new_steps.select("task_id", "seq"), "seq")
    latest = logs.join(narrow.select("task_id").distinct(), "task_id", "left_semi").groupBy("task_id").agg(F.max("step_number").alias("_last"))
    own = running(narrow, ["task_id"], ["seq"], {"_own": ("sum", F.lit(1))})
    every = running(narrow.drop("task_id"), [], ["seq"], {"_before": ("sum", F.lit(1).cast("long"))})
    start = first_free(logs, "log_id", last)
    steps = own.join(latest, "task_id", "left").join(every, "seq").select(
        "seq", (F.coalesce("_last", F.lit(0)) + F.col("_own") + 1).alias("step_number"), (start + F.col("_before")).alias("log_id")
    )
    return typed(new_steps.join(steps, "seq").withColumn("created_at", instant(as_of)), "execution_logs")
