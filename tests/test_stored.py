"""Tables that are made from each other end plans at files, keep their layout, and leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.operators import behavior as bh, entities as en
from packetloom.session import stored
from test_layout import flows, plan, same

D = "/root/testdata/sf0.001"


def test_tables_of_a_query_do_not_nest_in_its_plan(spark):
    df = entry.queries()["ent18_relationships"](spark, D)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in tree and len(tree) < 100_000


def test_stored_flows_keep_their_layout(spark):
    laid = stored(en.with_window(flows(spark), 3600), ["src_ip", "bucket"])
    met = en.endpoint_rows(laid, 3600).filter("out").select("entity", "bucket", "peer").distinct()
    for df in (met, bh.entity_windows(laid, 3600)):
        assert "ENSURE_REQUIREMENTS" not in plan(df)
    same(bh.entity_windows(flows(spark), 3600), bh.entity_windows(laid, 3600))


def test_stored_rows_are_the_same(spark):
    df = spark.createDataFrame([("a", None, [1, None]), (None, 2, None), ("a", None, [1, None]), ("", 3, [])], "k string, v long, x array<int>")
    for by in ([], ["k"], ["k", "v"]):
        same(df, stored(df, by))
        assert stored(df.filter("false"), by).count() == 0 and stored(df, by).schema == df.schema


def test_shuffles_that_made_a_table_leave_the_disk(spark):
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    stored(spark.range(1).toDF("k"))
    time.sleep(2)
    before = kept()
    stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s"))
    end = time.time() + 60
    while kept() > before and time.time() < end:
        time.sleep(1)
        stored(spark.range(1).toDF("k"))  # as the next table of a query
    assert kept() <= before


def test_nodes_of_a_snapshot_are_counted_from_written_edges(spark):
    df = entry.queries()["gra1_graph_snapshot"](spark, D)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in tree and "l_orderkey" not in tree
    assert df.count() == df.select("bucket", "ip").distinct().count() > 100
