"""Running aggregates against brute force, over one and several levels of buckets."""

import random

import pytest
from pyspark.sql import functions as F

import taskloom.functions.running as running_module
from taskloom.functions.running import PLACE, id_bucket, numbered, placed, running


@pytest.mark.parametrize("levels,bits", [(2, 3), (1, 4), (3, 2), (2, 16)])
def test_running_equals_brute_force(spark, monkeypatch, levels, bits):
    monkeypatch.setattr(running_module, "BUCKET_BITS", bits)
    rng = random.Random(bits + levels)
    ids = rng.sample(range(3000), 300) + rng.sample(range(2**40, 2**40 + 300), 50)
    data = [(rng.choice("aaabc"), i, rng.randint(0, 5)) for i in ids]
    df = spark.createDataFrame(data, "k string, i long, v int")
    found = running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.struct("i", "v"))}, levels=levels)
    got = {(r.k, r.i): (r.s, tuple(r.m) if r.m else None) for r in found.collect()}
    expected = {}
    for key in "abc":
        total, last = 0, None
        for _, i, v in sorted((d for d in data if d[0] == key), key=lambda d: d[1]):
            expected[key, i] = (total, last)
            total, last = total + v, (i, v)
    assert got == expected


def test_numbers_are_dense_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(running_module, "BUCKET_BITS", 3)
    ids = random.Random(1).sample(range(10**6), 500)
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    assert [r.n for r in numbered(df, ["i"], "n").orderBy("i").collect()] == list(range(1, 501))


def test_own_buckets(spark):
    df = spark.createDataFrame([(1, i // 7, i) for i in range(60)], "k long, a int, b int")
    out = numbered(df, ["a", "b"], "n", keys=["k"], bucket=[F.col("a"), id_bucket("b", 1)])
    assert [r.n for r in out.orderBy("a", "b").collect()] == list(range(1, 61))


def test_numbering_sorts_only_the_order_column(spark):
    """No window, and so no single task, holds the rows themselves."""
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) AS text")
    out = numbered(df, ["id"], "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("text" in line for line in windows)
    assert out.where("n <> id + 1").isEmpty() and out.count() == 1000


def test_sparse_ids_fall_into_even_ranges(spark):
    """Time-stamped ids near 2**62: no window holds more than a few times its share, and the totals have one row a range."""
    rng = random.Random(7)
    ids = [rng.randrange(2**61, 2**62) for _ in range(4000)]
    df = spark.createDataFrame([(i, rng.choice("aab")) for i in ids], "i long, k string").repartition(6)
    ranges = placed(df.repartition(8), "i").groupBy(PLACE).agg(F.count("i").alias("n"), F.min("i").alias("low"), F.max("i").alias("high")).orderBy(PLACE).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(ranges) <= parts and max(r.n for r in ranges) < 3 * 4000 / min(parts, len(ranges))
    assert all(a.high < b.low for a, b in zip(ranges, ranges[1:]))
    got = numbered(df, ["i"], "n").orderBy("i").collect()
    assert [r.n for r in got] == list(range(1, 4001))
    by_key = numbered(df, ["i"], "n", keys=["k"]).orderBy("k", "i").collect()
    assert [r.n for r in by_key] == [n for key in "ab" for n in range(1, 1 + sum(r.k == key for r in got))]
