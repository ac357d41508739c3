"""Parallel next-fit against the fold that defines it."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import packing


def folded(rows, capacity, reserve):
    """Volumes of (key, order, size), one row after the other."""
    out, state = {}, {}
    for key, order, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        volume, used, some = state.get(key, (0, reserve, False))
        size = size or 0
        if used + size > capacity and (some or used):
            volume, used = volume + 1, 0
        state[key] = volume, used + size, True
        out[key, order] = volume
    return out


def packed(spark, rows, capacity, reserve, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, i long, s long").repartition(3)
        found = packing.volumes(df, capacity, "k", "s", ["i"], reserve)
        return {(r["k"], r["i"]): r["volume"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(seed, n=900):
    rnd = random.Random(seed)
    size = lambda: rnd.choice([0, 0, 1, 2, 3, 5, 9, 20, 45, None])
    key = lambda: rnd.choice(["hot", "hot", "hot", "hot", "a", "b", None, f"k{rnd.randint(0, 40)}"])
    return [(key(), i, size()) for i in range(n)]


@pytest.mark.parametrize(("seed", "capacity", "reserve", "parts"), [(1, 20, 0, 9), (2, 20, 7, 9), (3, 20, 25, 6), (4, 700, 3, 12), (5, 0, 0, 5), (6, 100_000, 1, 4)])
def test_equals_the_fold(spark, seed, capacity, reserve, parts):
    rows = made(seed)
    assert packed(spark, rows, capacity, reserve, parts) == folded(rows, capacity, reserve)


def test_small_cases(spark):
    rows = [("a", i, s) for i, s in enumerate((5, 4, 3, 6))]
    assert packed(spark, rows, 8, 0, 2) == {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("a", 3): 2}
    assert packed(spark, [], 8, 0, 2) == {}
    with pytest.raises(ValueError):
        packing.volumes(spark.createDataFrame(rows, "k string, i long, s long"), -1, "k", "s", ["i"])


def test_one_key_stands_in_many_tasks(spark):
    """A key of all rows is packed in as many tasks as there are range partitions, and equals running the fold."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(200_000).select(F.lit("one").alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 97).alias("s"))
    found = packing.volumes(rows, 1000, "k", "s", ["i"], 10)
    parts = found.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    got = [r["volume"] for r in found.orderBy("i").select("volume").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = folded([("one", i, i * 7919 % 97) for i in range(200_000)], 1000, 10)
    assert len(parts) >= 3 and max(p["count"] for p in parts) < 120_000
    assert got == [want["one", i] for i in range(200_000)]
