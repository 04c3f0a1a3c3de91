"""Skew-safe helpers against plain windows and NumPy, with segments small enough to cross many borders."""

import numpy as np
from pyspark.sql import Window, functions as F

from packetloom.functions.ordered import as_of, global_row_number, segmented_lag, segmented_running
from packetloom.functions.quantiles import group_entropy, group_gini, group_quantiles
from packetloom.operators.graph import connected_components


def skewed(spark, n=3000):
    """One key holds most rows; the rest are spread."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
                                 ((F.col("id") * 7919) % 1009).cast("double").alias("v")).withColumn("seg", F.floor(F.col("id") / 17))


def test_lag_matches_plain_window(spark):
    df = skewed(spark)
    got = segmented_lag(df, ["key"], "seg", ["id"], {"p": "v"}).select("id", "p")
    want = df.select("id", F.lag("v").over(Window.partitionBy("key").orderBy("id")).alias("p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()), key=lambda t: t[0]) or dict(map(tuple, got.collect())) == dict(map(tuple, want.collect()))


def test_running_matches_plain_window(spark):
    df = skewed(spark)
    got = segmented_running(df, ["key"], "seg", ["id"], {"m": ("max", "v"), "s": ("sum", "v"), "n": ("min", "v")}).select("id", "m", "s", "n")
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("id", F.max("v").over(w), F.sum("v").over(w), F.min("v").over(w))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {r[0]: tuple(r[1:]) for r in want.collect()}


def test_quantiles_and_gini_match_numpy(spark):
    df = skewed(spark).withColumn("v", F.col("v") / 7 - 20)
    q = {r["key"]: r for r in group_quantiles(df, ["key"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()}
    g = {r["key"]: r["gini"] for r in group_gini(df, ["key"], "v").collect()}
    rows = df.toPandas()
    for key, part in rows.groupby("key"):
        x = part["v"].to_numpy()
        for name, p in (("a", 50), ("b", 95), ("c", 0), ("d", 100)):
            assert abs(q[key][name] - np.percentile(x, p)) < 1e-9
        y = np.sort(np.abs(x))
        n = len(y)
        want = (2 * np.sum(np.arange(1, n + 1) * y) - (n + 1) * y.sum()) / (n * y.sum() + 1e-9)
        assert abs(g[key] - want) < 1e-9


def test_entropy_of_even_split_is_one_bit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, x int")
    assert {r["k"]: round(r["entropy"], 9) for r in group_entropy(df, ["k"], "x").collect()} == {"a": 1.0, "b": 0.0}


def test_global_row_number_is_total_order(spark):
    df = skewed(spark, 500)
    got = global_row_number(df, [F.desc("v"), F.asc("id")], "rn").orderBy("rn").collect()
    want = df.orderBy(F.desc("v"), F.asc("id")).collect()
    assert [r["rn"] for r in got] == list(range(1, 501))
    assert [r["id"] for r in got] == [r["id"] for r in want]


def test_as_of_takes_latest_at_or_before(spark):
    left = spark.createDataFrame([("k", 5.0, 1), ("k", 10.0, 2), ("k", 100.0, 3), ("z", 1.0, 4)], "key string, t double, id int")
    right = spark.createDataFrame([("k", 4.0, "a"), ("k", 10.0, "b"), ("k", 11.0, "c")], "key string, t2 double, v string")
    got = {r["id"]: r["v"] for r in as_of(left, right, ["key"], "t", "t2", ["v"], 3).collect()}
    assert got == {1: "a", 2: "b", 3: "c", 4: None}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(40)]
    df = spark.createDataFrame(path + star + [("solo", "solo")], "src_ip string, dst_ip string")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert {got[f"p{i:03d}"] for i in range(61)} == {"p000"}
    assert {got[n] for n in ["hub"] + [f"leaf{i}" for i in range(40)]} == {"hub"}
    assert got["solo"] == "solo"
