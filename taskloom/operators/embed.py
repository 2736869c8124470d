"""Embedding lifecycle: model rotation, re-embedding, write-back and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import json_object
from ..model import Principal, Tables
from ..session import stage
from .delta import Upsert, assign_ids, instant, log_events, patch, patched, typed
from .lifecycle import require
from .views import active_dims, reembedding_targets

# Takes texts, returns one vector per text; an exception fails the texts one by one.
EmbedFunction = Callable[[list[str]], list[list[float]]]
TEXTS_PER_CALL = 64
#: On whose behalf re-embedding writes.
WORKER = Principal("embedder", is_worker=True)


@dataclass(frozen=True)
class Rotation:
    tables: Tables
    targets: DataFrame


@dataclass(frozen=True)
class Reembedded:
    """`report` is one row (processed, attempted); `errors` one row per target that could not be embedded; `changes` the rows that got
    a vector, for a store."""

    tables: Tables
    changes: dict[str, Upsert]
    report: DataFrame
    errors: DataFrame


def plan_rotation(t: Tables, p: Principal, model: str, dims: int, endpoint: str, as_of: str | Column) -> Rotation:
    """Make another model the active one. Stored vectors stay; those of another width drop out of the search."""
    require(p.privileged, "plan_rotation")
    spark = t.embedding_config.sparkSession
    now = instant(as_of)
    new = spark.createDataFrame(
        [(1, model, dims, endpoint, True)], "seq long, model_name string, dimensions int, endpoint string, is_active boolean"
    )
    row = assign_ids(new, t.embedding_config, "config_id", "seq").withColumn("activated_at", now)
    config = t.embedding_config.withColumn("is_active", F.lit(False)).unionByName(typed(row, "embedding_config"))
    none = F.lit(None).cast("long")
    command = new.select(
        "seq", none.alias("agent_id"), none.alias("session_id"), none.alias("task_id"),
        F.lit("embedding_rotated").alias("event_type"),
        json_object(model=F.col("model_name"), dims=F.col("dimensions")).alias("payload"),
    )
    events = t.agent_events.unionByName(log_events(t.agent_events, command, as_of))
    tables = t.replace(embedding_config=config, agent_events=events)
    return Rotation(tables, reembedding_targets(tables))


def _embedder(embed: EmbedFunction, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            answer = embed([text])
            if answer is None or len(answer) != 1:
                return None, f"{0 if answer is None else len(answer)} vectors for one text"
            return _checked(answer[0])
        except Exception as failure:  # noqa: BLE001 - any failure of user code becomes an error row
            return None, str(failure)

    def _checked(vector: list[float] | None) -> tuple[list[float] | None, str | None]:
        try:
            if vector is None:
                return None, "no vector"
            if len(vector) != width:
                return None, f"dim mismatch: got {len(vector)} expected {width}"
            return [float(x) for x in vector], None
        except (TypeError, ValueError) as failure:  # an answer that is no list of numbers
            return None, str(failure)

    def many(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = embed(texts)
        except Exception:  # noqa: BLE001 - find out which texts fail
            return [one(text) for text in texts]
        if vectors is None or len(vectors) != len(texts):  # no telling which vector is whose
            return [one(text) for text in texts]
        return [_checked(vector) for vector in vectors]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), TEXTS_PER_CALL):
                part = batch.iloc[start : start + TEXTS_PER_CALL]
                results = many([text or "" for text in part["content"]])
                yield pd.DataFrame(
                    {
                        "source": part["source"].to_numpy(),
                        "row_id": part["row_id"].to_numpy(),
                        "embedding": [vector for vector, _ in results],
                        "error": [error for _, error in results],
                    }
                )

    return run


def reembed(t: Tables, embed: EmbedFunction, as_of: str | Column, batch: int | None = None) -> Reembedded:
    """Embed the rows the active model has no vector for, all of them or the first `batch`, and write the vectors back."""
    width = active_dims(t).first()["dimensions"]
    targets = reembedding_targets(t).select("source", "row_id", "content")
    if batch is not None:
        targets = targets.orderBy("source", F.col("row_id").cast("long")).limit(batch)
    schema = "source string, row_id string, embedding array<float>, error string"
    # The user function is costly and may answer differently when asked again, so its results are kept.
    done = stage(targets.mapInPandas(_embedder(embed, width or 0), schema))
    ok = done.where(F.col("error").isNull())

    def vectors(source: str, key: str) -> DataFrame:
        return ok.where(F.col("source") == source).select(
            F.col("row_id").cast("long").alias(key), "embedding", F.lit(width).cast("int").alias("embedding_dims")
        )

    tables = set_memory_embeddings(t, WORKER, vectors("memory", "memory_id"))
    tables = set_tool_embeddings(tables, WORKER, vectors("tool_registry", "tool_id"), as_of)
    memory = vectors("memory", "memory_id")
    tools = vectors("tool_registry", "tool_id").withColumnRenamed("embedding", "description_embedding")
    changes = {
        "memory": Upsert(patched(t.memory, memory, "memory_id"), ("memory_id",)),
        "tool_registry": Upsert(patched(t.tool_registry, tools, "tool_id", as_of), ("tool_id",)),
    }
    report = done.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count(F.lit(1)).alias("attempted"))
    errors = done.where(F.col("error").isNotNull()).select("source", "row_id", "error")
    return Reembedded(tables, changes, report, errors)


def set_tool_embeddings(t: Tables, p: Principal, vectors: DataFrame, as_of: str | Column) -> Tables:
    """Overwrite vector and width of tools (tool_id, embedding, embedding_dims)."""
    require(p.privileged, "set_tool_embeddings")
    changes = vectors.select("tool_id", F.col("embedding").alias("description_embedding"), "embedding_dims")
    return t.replace(tool_registry=patch(t.tool_registry, changes, "tool_id", touch=as_of))


def set_memory_embeddings(t: Tables, p: Principal, vectors: DataFrame) -> Tables:
    """Overwrite vector and width of memories (memory_id, embedding, embedding_dims)."""
    require(p.privileged, "set_memory_embeddings")
    return t.replace(memory=patch(t.memory, vectors.select("memory_id", "embedding", "embedding_dims"), "memory_id"))


def insert_memories(t: Tables, p: Principal, rows: DataFrame, as_of: str | Column) -> Tables:
    """Append memories (seq, agent_id, session_id, content, embedding, embedding_dims)."""
    require(p.privileged, "insert_memories")
    new = assign_ids(rows, t.memory, "memory_id", "seq").withColumn("created_at", instant(as_of))
    return t.replace(memory=t.memory.unionByName(typed(new, "memory")))


def embedding_coverage(t: Tables) -> DataFrame:
    """Rows the search can and cannot see, per source and agent (tools belong to no single agent)."""
    width = active_dims(t).scalar()

    def seen(df: DataFrame, source: str, agent: Column, vector: str) -> DataFrame:
        visible = F.coalesce(F.col(vector).isNotNull() & (F.col("embedding_dims") == width), F.lit(False))
        return df.select(F.lit(source).alias("source"), agent.cast("long").alias("agent_id"), visible.alias("_seen"))

    memory = seen(t.memory, "memory", F.col("agent_id"), "embedding")
    tools = seen(t.tool_registry.where("is_active"), "tool_registry", F.lit(None), "description_embedding")
    counted = memory.unionByName(tools).groupBy("source", "agent_id").agg(
        F.count_if("_seen").alias("searchable"), F.count_if(~F.col("_seen")).alias("excluded")
    )
    total = F.col("searchable") + F.col("excluded")
    return counted.withColumn("share", F.round(F.col("searchable") / total, 6))
