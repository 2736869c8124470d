"""What several operators of this folder need: staged files, tables in a total order, labels of connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import passing, scratch_path

#: Rows of one Arrow batch. With texts of a few thousand characters a batch then takes some megabytes in a Python worker.
BATCH_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that one Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def staged(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """The frame written as Parquet into the shared folder and read back: cuts lineage, keeps column pruning, survives executors.

    Inside `staging()` the folder goes when the block ends, unless it is to last.
    """
    path = scratch_path(df.sparkSession, label)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    if not lasting:
        passing(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go once it is written: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the integer as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most `parts` values of an integer column that cut it into ranges of about equal counts; the least value comes first.

    One narrow aggregate; only the bounds reach the driver. Nulls are left out.
    """
    shares = [i / parts for i in range(parts)]
    row = df.agg(
        F.min(column).alias("low"),
        F.percentile_approx(column, F.array(*[F.lit(s) for s in shares]), F.lit(20 * parts)).alias("cuts"),
    ).first()
    if row["low"] is None:
        return []
    return sorted({int(row["low"]), *map(int, row["cuts"])})


def range_of(column: str, bounds: Sequence[int]) -> Column:
    """Number of the range a value falls into: 0 for values below the second bound, and for nulls."""
    if len(bounds) < 2:
        return F.lit(0)
    inner = F.array(*[F.lit(b).cast("long") for b in bounds[1:]])
    return F.coalesce(F.size(F.filter(inner, lambda b: b <= F.col(column))), F.lit(0))


def connected(edges: DataFrame, node: str, root: str) -> DataFrame | None:
    """Smallest reachable node of every node that has an edge; None if there is none.

    `edges` has two long columns, `a` > `b`. Each round hooks every node that has a smaller neighbour onto the least one, jumps
    along the hooks by doubling, and contracts. Every round removes each node that has a smaller neighbour, so that few rounds
    do. All steps are joins and aggregates that are combined before the exchange; one staged frame a round cuts the lineage.
    """
    live = staged(edges.distinct(), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        hook = staged(live.groupBy("a").agg(F.min("b").alias("b")), "hooks")
        while True:
            nxt = hook.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = staged(hook.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "jumps")
            hook = jumped.select("a", "b")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(hook)
        to_a, to_b = hook.select("a", F.col("b").alias("ra")), hook.select(F.col("a").alias("b"), F.col("b").alias("rb"))
        ends = live.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        live = staged(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return None
    label = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("a").alias("b"), F.col("b").alias("c"))
        old = label.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        label = old.unionByName(later.join(label.select("a"), "a", "left_anti"))
    # Roots of the last round are labels only; give them a row of their own.
    label = staged(label, "labels")
    label = label.unionByName(label.select(F.col("b").alias("a"), "b").distinct()).distinct()
    return label.select(F.col("a").alias(node), F.col("b").alias(root))


def in_ranges(df: DataFrame, column: str, bounds: Sequence[int]) -> DataFrame:
    """The rows with `part`, dealt so that every part is whole in one task and the tasks' parts follow the order of the column."""
    parted = df.withColumn("part", range_of(column, bounds))
    return parted.repartitionById(max(1, len(bounds)), F.col("part"))
