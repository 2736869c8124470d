"""Typed scans of the control-plane tables; the store of `store.py` by its old names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import SCHEMAS, Tables
from .store import (
    VersionTaken,
    changed_rows,
    committed_batch,
    compact,
    manifest,
    read_snapshot,
    rows_near,
    seen_version,
    vacuum,
    write_snapshot,
)

__all__ = [
    "VersionTaken",
    "changed_rows",
    "committed_batch",
    "compact",
    "load_tables",
    "manifest",
    "read_snapshot",
    "rows_near",
    "seen_version",
    "vacuum",
    "write_snapshot",
]


def load_tables(spark: SparkSession, directory: str) -> Tables:
    """One Parquet folder per table below `directory`; the declared schemas spare inference and type the columns."""

    def scan(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}")

    return Tables({name: lambda name=name: scan(name) for name in SCHEMAS})
