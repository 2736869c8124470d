"""Session settings the operators rely on, and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be applied to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time, also where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Session windows of one key are merged where the rows arrive, before they are exchanged.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Duplicate object keys are legal JSON: the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster pass the cluster's own session to `configure`."""
    builder = (
        SparkSession.builder.master(master)
        .appName("taskloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder, since there driver and executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), f"taskloom-{os.getpid()}")
    os.makedirs(fallback, exist_ok=True)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders staged inside the innermost `staging()`, to be removed when it ends.
_staged: list[list[str]] = []


@contextmanager
def staging() -> Iterator[None]:
    """Remove what is staged inside once the block ends: for work whose results are written by then."""
    _staged.append([])
    try:
        yield
    finally:
        spark = SparkSession.getActiveSession()
        for path in _staged.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def passing(path: str) -> None:
    """Let a folder go at the end of the innermost `staging()`, if there is one."""
    if _staged:
        _staged[-1].append(path)


def stage(df: DataFrame) -> DataFrame:
    """Materialise a frame that many branches read: Parquet in the shared folder, read back.

    A lost executor then costs a re-read of files instead of the whole upstream plan, and branches read only the columns they use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    passing(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(tables, *names: str):
    """The bundle with the named tables (all by default) materialised.

    Operators chain lazily, and each reads its input tables several times: settle, or write a snapshot, between the steps of a
    longer chain.
    """
    return tables.replace(**{name: stage(tables[name]) for name in names or tables})
