"""Flows that several branches of a query read are made once, and all intervals are judged from one array a key where it is short."""

import random

from pyspark.sql import functions as F

from packetloom.operators import behavior as bh, patterns as pt
from packetloom.plans import e_behavior, i_forecast

SF = "/root/testdata/sf0.001"
SHAPE = ["interval_count", "mean_interval", "std_interval", "jitter", "median_interval", "mad_interval", "interval_entropy", "bowley_skewness"]


def leaves(df):
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return {found.apply(i).nodeName().split(" ")[0] for i in range(found.size())}


def test_all_branches_of_the_vector_read_kept_flows(spark):
    assert leaves(e_behavior.beh13(spark, SF)) == {"InMemoryRelation"}


def test_steps_of_a_fit_read_kept_flows(spark):
    assert "InMemoryRelation" in leaves(i_forecast.ev14(spark, SF))


def test_intervals_read_kept_flows(spark):
    df = e_behavior._shape(spark, SF)
    assert leaves(df) == {"InMemoryRelation"}
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_short_and_busy_keys_have_the_same_shape(spark):
    rng = random.Random(8)
    rows = [(f"k{i % 5}", float(rng.randrange(400000))) for i in range(600)] + [("one", 1.0), ("two", 1.0), ("two", 9.0), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, t double")
    got = []
    for limit in (1 << 16, 100, 0):
        got.append({r.k: [None if r[n] is None else round(r[n], 6) for n in SHAPE] for r in bh.interval_shapes(df, ["k"], "t", 86400, limit).collect()})
    assert got[0] == got[1] == got[2] and set(got[0]) == {"k0", "k1", "k2", "k3", "k4", "two"}


def test_fingerprints_from_given_members(spark):
    rows = [(f"i{i % 3}", i % 3, f"s{i % 4}", f"d{i % 5}", i % 7, ("TCP", "UDP")[i % 2], ("REJECTED", "CLOSED")[i % 3 > 0]) for i in range(90)]
    s = spark.createDataFrame(rows, "incident string, bucket long, src_ip string, dst_ip string, dst_port int, protocol string, state string")
    atk = F.col("state") == "REJECTED"
    m = pt.incident_members(s, "incident", atk).persist()
    a, b = pt.incident_fingerprint(s, "incident", atk, atk), pt.incident_fingerprint(s, "incident", atk, atk, m)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
