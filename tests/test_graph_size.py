"""Session nodes and edges, most of the graph, are made where they are read: nothing about them is merged or written."""

from pyspark.sql import functions as F

from packetloom.operators import knowledge as kg


def graph(spark):
    e = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    sessions = e("src_ip string, dst_ip string, dst_port int", ("a", "x", 1), ("a", "x", 1), ("b", "x", 2), ("b", "y", 1))
    findings = e("entity string, bucket long, attack_category string, severity string, finding_id string", ("a", 1, "port_scan", "high", "f1"))
    beacons = e("src_ip string, dst_ip string, dst_port int, protocol string, is_beaconing boolean", ("a", "x", 1, "TCP", True))
    episodes = e("episode_id string, categories string, entity string, start_window long, end_window long", ("e1", "port_scan", "a", 1, 1))
    changes = e("entity string, bucket long, change_type string", ("b", 1, "PORT"), ("gone", 1, "PORT"))
    campaigns = e("campaign_id string, entity string, start_window long, end_window long", ("c1", "a", 1, 1))
    patterns = e("pattern_id string, pattern_type string, entity string, start_window long", ("p1", "SCAN", "a", 1))
    transitions = e("entity string, from_state string, to_state string", ("a", "BENIGN", "IMPACT"), ("a", "BENIGN", "IMPACT"))
    return kg.build_graph(sessions, findings, beacons, episodes, changes, campaigns, patterns, transitions, e("horizon int", (1,), (2,)))


def test_session_edges_are_neither_merged_nor_written(spark):
    nodes, edges = graph(spark)
    plan = edges.filter("edge_type = 'USES_PORT'")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and "Join" not in plan and "Aggregate" not in plan.split("InMemoryRelation")[0]
    assert edges.filter("edge_type = 'USES_PORT'").count() == 3 and nodes.filter("node_type = 'TCP_SESSION'").count() == 3


def test_ends_are_nodes_and_equal_things_merge(spark):
    nodes, edges = graph(spark)
    assert nodes.count() == nodes.select("id").distinct().count()
    for end in ("source_id", "target_id"):
        assert edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").count() == 0
    assert edges.count() == edges.select("source_id", "target_id", "edge_type").distinct().count()
    kinds = {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert kinds == {"COMMUNICATES_WITH": 3, "TARGETS": 3, "USES_PORT": 3, "MAPS_TO_TECHNIQUE": 1, "INDICATES": 1, "PART_OF_EPISODE": 1, "MANIFESTS_CHANGE": 1,
                     "PART_OF_CAMPAIGN": 1, "PARTICIPATES_IN_PATTERN": 1, "TRANSITIONS_TO": 1, "EXHIBITS_STATE": 1, "TEMPORALLY_PRECEDES": 2}


def test_other_kinds_of_edge_still_count_and_trace(spark):
    nodes, edges = graph(spark)
    ids = {r.node_type: r.id for r in nodes.collect()}
    more = spark.createDataFrame([(ids["PATTERN"], ids["FINDING"], "SUPPORTS")], "source_id string, target_id string, edge_type string")
    got = {r.node_type: (r.predecessors, r.predecessor_types) for r in kg.evidence_chains(nodes, edges.unionByName(more, allowMissingColumns=True)).collect()}
    assert got["FINDING"] == (2, "BEHAVIOR_SIGNAL,PATTERN")
    own = spark.createDataFrame([("u", "v", "INDICATES"), ("v", "w", "SUPPORTS")], "source_id string, target_id string, edge_type string")
    assert kg.backward_trace(own, spark.createDataFrame([("w",)], "id string")).count() == 3
