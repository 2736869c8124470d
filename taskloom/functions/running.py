"""Running aggregates and dense numbering that stay distributed when one group holds most of the rows.

A plain window over a hot key sorts the whole group in one task. Rows are therefore always cut into buckets that are monotone in the
order: each bucket is scanned on its own, the bucket totals (combined before the exchange) are scanned on the next level, and the two
are added. The plan is the same for every size; there is no count beforehand.

`placed` cuts rows into ranges of about equal counts, by the bounds that Spark samples for a range partitioning, and writes them with the
number of their range: whatever the ids look like, no bucket holds more than a task's share, and the last level has one row a range.
Where rows aren't written anyway, buckets are the upper bits of a unique integer order key: at most 2**BUCKET_BITS rows each, which suits
ids that are about dense.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BUCKET_BITS = 16


def id_bucket(order: str, bits: int | None = None) -> Column:
    """Bucket of a unique integer key: bounded by 2**bits rows whatever the distribution."""
    return F.shiftright(F.col(order).cast("long"), BUCKET_BITS if bits is None else bits)


#: Column with the number of a row's range.
PLACE = "_placed"


def placed(df: DataFrame, *order: str) -> DataFrame:
    """The rows written in ranges of the order, of about equal counts, with the number of the range; it rises with the order."""
    return stage(df.repartitionByRange(*order).withColumn(PLACE, F.spark_partition_id()))


def _combine(kind: str, local: Column, before: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
    return F.greatest(local, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    bucket: Sequence[Column] | None = None,
    levels: int = 2,
) -> DataFrame:
    """Add, per key and in `order`, the aggregate of each measure over the rows strictly before the current one.

    `measures` maps an output column to ("sum" | "max", expression). `keys` must not be null and `order` must be unique
    within a key. By default rows of `placed` go by their range, and otherwise the (single, integer) order key is bucketed, and the
    buckets again: with two levels the last one has at most 2**16 rows a key for ids below 2**48. Or `bucket` lists expressions
    monotone in `order`. The input is read `levels` + 1 times (twice with ranges or own buckets).
    """
    keys = list(keys)
    if bucket is None and PLACE in df.columns:
        bucket = [F.col(PLACE)]
    buckets = list(bucket) if bucket is not None else [id_bucket(order[0])]
    names = [f"_bucket{levels}_{i}" for i in range(len(buckets))]
    kinds = {out: kind for out, (kind, _) in measures.items()}
    inputs = {out: f"_m{levels}_{out}" for out in kinds}
    carried = {out: f"_b{levels}_{out}" for out in kinds}
    agg = {"sum": F.sum, "max": F.max}
    before = Window.unboundedPreceding, -1
    rows = df.withColumns({**dict(zip(names, buckets)), **{inputs[out]: expr for out, (_, expr) in measures.items()}})

    totals = rows.groupBy(*keys, *names).agg(*[agg[k](inputs[out]).alias(carried[out]) for out, k in kinds.items()])
    if levels > 1 and bucket is None:
        again = {f"_o{carried[out]}": (k, F.col(carried[out])) for out, k in kinds.items()}
        coarse = running(totals, keys, names, again, levels=levels - 1)
        offsets = coarse.select(*keys, *names, *[F.col(f"_o{c}").alias(c) for c in carried.values()])
    else:
        across = Window.partitionBy(*keys).orderBy(*names).rowsBetween(*before)
        offsets = totals.select(*keys, *names, *[agg[k](carried[out]).over(across).alias(carried[out]) for out, k in kinds.items()])

    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(*before)
    scanned = rows.withColumns({f"_l{levels}_{out}": agg[k](inputs[out]).over(inside) for out, k in kinds.items()})
    # An outer join, so that Catalyst drops the branch where the result is not used.
    joined = scanned.join(offsets, [*keys, *names], "left")
    return joined.select(
        *df.columns, *[_combine(k, F.col(f"_l{levels}_{out}"), F.col(carried[out])).alias(out) for out, k in kinds.items()]
    )


def numbered(
    df: DataFrame, order: Sequence[str], out: str, keys: Sequence[str] = (), bucket: Sequence[Column] | None = None
) -> DataFrame:
    """Add 1, 2, 3 … per key in `order`, without sorting a whole key in one task.

    Only keys and order are staged and sorted; the numbers are joined back to the rows. Without own buckets they are placed in ranges.
    """
    unique = [*keys, *order]
    narrow = placed(df.select(*unique), *order) if bucket is None else stage(df.select(*unique))
    ranked = running(narrow, keys, order, {out: ("sum", F.lit(1))}, [F.col(PLACE)] if bucket is None else bucket)
    return df.join(ranked.select(*unique, (F.col(out) + 1).cast("long").alias(out)), unique)
