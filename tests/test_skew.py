"""Skew-safe building blocks against plain computations, with one key holding most rows."""

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from nearwell.operators import skew


def hot_rows(n=4000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", i,
             round(rng.choice([12.5, rng.uniform(8, 30)]), 5), rng.randrange(2000))
            for i in range(n)]


def test_exact_median(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, i int, v double, o int").withColumn("w", -F.col("v"))
    got = {r.k: (r.v, r.w, r.n) for r in skew.exact_median(df, ["k"], ["v", "w"]).collect()}
    groups = defaultdict(list)
    for k, _, v, _ in rows:
        groups[k].append(v)
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert abs(got[k][0] - median(vs)) < 1e-9 and abs(got[k][1] + median(vs)) < 1e-9
        assert got[k][2] == len(vs)


def test_latest_row_puts_null_last_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", "2020", "y"), ("a", "2020", "z"),
                                ("b", None, "w")], "k string, r string, v string")
    got = {r.k: (r.r, r.v) for r in skew.latest_row(df, ["k"], [F.col("r")]).collect()}
    assert got == {"a": ("2020", "z"), "b": (None, "w")}


def test_running_number_and_previous_value(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, i int, v double, o int")
    bucket = F.floor(F.col("o") / 100)
    got = defaultdict(dict)
    for r in skew.running_number(df, "k", [F.col("o"), F.col("i")], "n").collect():
        got[r.k][r.i] = r.n
    want, last = defaultdict(list), {}
    for k, i, _, o in sorted(rows, key=lambda r: (r[3], r[1])):
        want[k].append(i)
    for k, order in want.items():
        assert [i for i, _ in sorted(got[k].items(), key=lambda x: x[1])] == order
        assert sorted(got[k].values()) == list(range(1, len(order) + 1))

    seq = df.withColumn("s", F.col("o") * 10000 + F.col("i"))
    value = F.when(F.col("i") % 7 == 0, F.col("i"))
    out = skew.previous_value(seq, "k", F.col("s"), bucket, value, "p").collect()
    for r in sorted(out, key=lambda r: (r.k, r.s)):
        assert r.p == last.get(r.k)
        if r.i % 7 == 0:
            last[r.k] = r.i


def largest_task(df):
    """Rows of the largest partition of a plan that ends in work on hot groups."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture
def apart(spark):
    """No broadcasts and no coalescing, as on tables of any size."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def test_one_busy_hour_is_many_tasks(spark, apart):
    df = spark.range(40_000).select(F.when(F.col("id") % 5 > 0, "hot").alias("k"), "id",
                                    F.lit("2024-01-01 10:00:00").cast("timestamp").alias("at"))
    out = skew.running_number(df, "k", [F.col("at"), F.col("id")], "n")
    assert largest_task(out) < 12_000  # 32,000 rows are hot, 8,000 have a null key
    assert out.where("k IS NOT NULL AND n <> id - id div 5").count() == 0
    assert out.where("k IS NULL AND n <> id div 5 + 1").count() == 0


def test_split_groups_bounds_and_keeps_rows(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), "id")
    parts = skew.split_groups(df, "k", F.col("id"), 500)
    sizes = [r["count"] for r in parts.groupBy("k", "part").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) < 700
    wide = skew.split_groups(df, "k", F.col("id"), 50_000, F.lit(1000), 1_000_000)
    assert {r["parts"] for r in wide.select("parts").distinct().collect()} == {5}


def test_a_hot_group_is_cut_before_any_join(spark, apart):
    df = spark.range(40_000).select(F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 10 == 0, "cool")
                                    .alias("k"), "id").repartition(8)
    out = skew.split_groups(df, "k", F.col("id"), 500)
    assert largest_task(out) < 9_000  # 32,000 rows are hot
    got = {r["k"]: (r["n"], r["p"]) for r in out.groupBy("k").agg(
        F.count("*").alias("n"), F.max("parts").alias("p")).collect()}
    assert got == {"hot": (32_000, 64), "cool": (4_000, 8), None: (4_000, 8)}
