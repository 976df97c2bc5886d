"""Ordered operators against plain windows and brute force, with keys cut into small chunks."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ordering

SCHEMA = "key string, a double, b int, s string, t timestamp_ntz, v string"


def skewed_rows(spark, seed=1, n=400):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        key = pick.choice(["hot"] * 4 + [None, None, "x", "y", "z"])
        number = pick.choice([None, float("nan"), float("inf"), -1e308, 1e308, *[pick.gauss(0, 100) for _ in range(12)]])
        instant = pick.choice(["2024-03-10 02:30:00", "2024-03-10 02:30:00.5", f"2024-03-{pick.randint(1, 28):02d} 0{pick.randint(0, 9)}:10:00"])
        rows.append((key, number, i, pick.choice([None, "", "ä", "zz", f"s{pick.randint(0, 99)}"]), instant, pick.choice([None, f"v{i}"])))
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "string")).withColumn("t", F.col("t").cast("timestamp_ntz"))


@pytest.mark.parametrize(
    "order, ranges",
    [(["b"], 60), (["b"], 1), (["b"], None), (["a", "b"], 40), (["s", "b"], 40), (["t", "b"], 40), (["yes", "b"], 20), (["raw", "b"], 20), (["pair"], 20)],
)
def test_running_equals_plain_windows(spark, order, ranges):
    rows = skewed_rows(spark).withColumns({"yes": F.col("b") % 3 == 0, "raw": F.col("s").cast("binary"), "pair": F.struct("s", "b")})
    got = ordering.running(rows, ["key"], order, row_number="n", previous={"last": "v"}, count_before={"seen": "v"}, ranges=ranges)
    plain = Window.partitionBy("key").orderBy(*order)
    want = rows.select(
        "*",
        F.row_number().over(plain).cast("bigint").alias("n"),
        F.lag("v").over(plain).alias("last"),
        F.count("v").over(plain.rowsBetween(Window.unboundedPreceding, -1)).alias("seen"),
    )
    picked = ["b", "n", "last", "seen"]
    assert sorted(map(tuple, got.select(picked).collect())) == sorted(map(tuple, want.select(picked).collect()))


@pytest.mark.parametrize("ranges", [30, 1])
def test_without_keys_the_frame_is_one_sequence(spark, ranges):
    rows = skewed_rows(spark)
    got = ordering.running(rows, [], ["s", "b"], row_number="n", previous={"last": "v"}, ranges=ranges)
    plain = Window.orderBy("s", "b")
    want = rows.select("*", F.row_number().over(plain).cast("bigint").alias("n"), F.lag("v").over(plain).alias("last"))
    assert got.columns == want.columns
    picked = ["b", "n", "last"]
    assert sorted(map(tuple, got.select(picked).collect())) == sorted(map(tuple, want.select(picked).collect()))


def largest(rows, keys, order, ranges):
    return ordering.cut_into_ranges(rows, keys, order, ranges).groupBy("_range").count().agg(F.max("count")).first()[0]


def test_ranges_are_even_whatever_the_order(spark):
    paths = spark.range(6_000_000).select(F.format_string("s3://b/%012d", "id").alias("path"), F.lit("k").alias("key"))
    assert largest(paths, [], ["path"], 12) <= 2 * 500_000
    assert largest(paths, ["key"], ["path"], 12) <= 2 * 500_000
    stamps = spark.range(1000).select(F.when(F.col("id") == 0, 0).otherwise(1.7e9 + F.col("id")).cast("timestamp").alias("at"))
    assert largest(stamps, [], ["at"], 10) <= 2 * 100


def test_many_keys_across_few_cuts(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("key"), "id").withColumn("key", F.when(F.col("key") < 5, 0).otherwise(F.col("key")))
    got = ordering.running(rows, ["key"], ["id"], row_number="n", ranges=25)
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")).cast("bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_cut_rows_are_shuffled_once_more_for_the_window(spark):
    rows = spark.range(100).withColumn("key", F.col("id") % 3)
    plan = ordering.running(rows, ["key"], ["id"], row_number="n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def names_by_hand(arrivals, taken):
    blocked = set(arrivals) | set(taken)
    seen, given, out = Counter(), set(), []
    for name in arrivals:
        first = seen[name] == 0 and name not in taken
        seen[name] += 1
        if first:
            out.append(name)
            continue
        stem, dot, ext = name.rpartition(".")
        k = 1
        while f"{stem}_{k}.{ext}" in blocked or f"{stem}_{k}.{ext}" in given:
            k += 1
        given.add(f"{stem}_{k}.{ext}")
        out.append(f"{stem}_{k}.{ext}")
    return out


@pytest.mark.parametrize("seed, ranges", [(0, 15), (1, 15), (2, None), (3, 15)])
def test_unique_names(spark, seed, ranges):
    pick = random.Random(seed)
    pool = ["a.json"] * 6 + ["a_1.json", "a_2.json", "a_1_1.json", "b.x.txt", "b.x_3.txt", "c_0.json", "c_01.json"]
    arrivals = [pick.choice(pool) for _ in range(80)]
    taken = [pick.choice([*pool, "a_9.json", "a_12.json", "b.x_1.txt"]) for _ in range(pick.randint(0, 9))]
    files = spark.createDataFrame(list(enumerate(arrivals)), "i int, name string")
    existing = spark.createDataFrame([(t,) for t in taken], "name string") if taken or seed % 2 else None
    named = ordering.unique_names(files, "name", ["i"], existing, ranges=ranges)
    got = [r["unique_name"] for r in named.orderBy("i").collect()]
    assert got == names_by_hand(arrivals, taken)
    assert len(set(got)) == len(got) and not set(got) & set(taken)


def test_same_name_four_times(spark):
    files = spark.createDataFrame([(i, "a.json") for i in range(4)], "i int, name string")
    named = ordering.unique_names(files, "name", ["i"]).orderBy("i")
    assert [r["unique_name"] for r in named.collect()] == ["a.json", "a_1.json", "a_2.json", "a_3.json"]


def test_tail(spark):
    rows = spark.range(20)

    def ids(*size):
        return [r.id for r in ordering.tail(rows, ["id"], *size).collect()]

    assert ids(1, 0) == [19]
    assert ids(3, 2) == [15, 16, 17]
    assert ids(5, 18) == [0, 1]
    assert ids(5, 25) == []


def test_long_limit_and_tail_are_in_order(spark):
    rows = spark.range(150_000).select((F.lit(149_999) - F.col("id")).alias("id"))
    assert [r.id for r in ordering.limit(rows, 120_000, ["id"]).collect()] == list(range(120_000))
    assert [r.id for r in ordering.tail(rows, ["id"], 110_000, 5).collect()] == list(range(39_995, 149_995))
