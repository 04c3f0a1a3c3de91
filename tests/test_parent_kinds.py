"""Parents are looked up among the kinds of node that a chain from the starts can come to."""

import pytest

from packetloom.operators import knowledge as kg
from test_graph_size import graph


def roots(parents, starts):
    return sorted(map(tuple, kg.trace_roots(parents, starts).collect()))


@pytest.mark.parametrize("kinds", ["'FINDING', 'BEHAVIOR_SIGNAL'", "'CHANGE_SIGNAL', 'ATTACK_STATE'", "'IP', 'FINDING'", "'TCP_SESSION'"])
def test_chains_are_those_over_all_edges(spark, kinds):
    nodes, edges = graph(spark)
    starts = nodes.filter(f"node_type IN ({kinds})").select("id")
    assert roots(kg.parent_pointers(edges, starts=starts), starts) == roots(kg.parent_pointers(edges), starts) != []


def test_edges_of_sessions_are_not_read_for_findings(spark):
    nodes, edges = graph(spark)
    plan = kg.parent_pointers(edges, starts=nodes.filter("node_type = 'FINDING'").select("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "tcp_session" not in plan
    assert "InMemoryRelation" in kg.parent_pointers(edges, starts=nodes.filter("node_type = 'IP'").select("id"))._jdf.queryExecution().optimizedPlan().toString()


def test_other_kinds_and_ids_leave_all_edges(spark):
    nodes, edges = graph(spark)
    ids = {r.node_type: r.id for r in nodes.collect()}
    more = edges.unionByName(spark.createDataFrame([(ids["CAMPAIGN"], ids["IP"], "SUPPORTS")], "source_id string, target_id string, edge_type string"), allowMissingColumns=True)
    start = nodes.filter("node_type = 'FINDING'").select("id")
    got = roots(kg.parent_pointers(more, starts=start), start)
    assert got == roots(kg.parent_pointers(more), start) != roots(kg.parent_pointers(edges), start)
    plain = spark.createDataFrame([("f", "e", "INDICATES"), ("e", "c", "MAPS_TO_TECHNIQUE")], "source_id string, target_id string, edge_type string")
    named = spark.createDataFrame([("f",)], "id string")
    assert roots(kg.parent_pointers(plain, starts=named), named) == [("f", "c", 2, False)]
