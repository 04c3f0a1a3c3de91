"""Graph queries: GRA1-GRA11."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.columns import r
from packetloom.operators import graph as gr
from packetloom.plans import base
from packetloom.plans.a_views import DAY
from packetloom.plans.e_behavior import MONTH
from packetloom.plans.registry import cte, query
from packetloom.session import stored

cte("mf_v", f"SELECT *, CAST(floor(start_ts / {MONTH}) AS BIGINT) AS bucket FROM flows_v")
cte("ge_v", """
SELECT *, packet_count + byte_count / 1024.0::DOUBLE AS weight FROM (
 SELECT bucket, src_ip, dst_ip, protocol, dst_port, count(*) AS flow_count, CAST(sum(CASE WHEN fwd_packets = 0 THEN 1 ELSE fwd_packets END + rev_packets) AS BIGINT) AS packet_count,
  CAST(sum(fwd_bytes + rev_bytes) AS BIGINT) AS byte_count, max(end_ts - start_ts) AS max_duration FROM mf_v GROUP BY 1, 2, 3, 4, 5)""")
cte("gn_half", """
SELECT bucket, src_ip AS ip, dst_ip AS peer, true AS o, dst_port, packet_count AS p, byte_count AS b FROM ge_v UNION ALL
SELECT bucket, dst_ip, src_ip, false, dst_port, packet_count, byte_count FROM ge_v""")
cte("gn_v", """
SELECT *, least(1.0, (packets_sent + packets_recv) / greatest(max(packets_sent + packets_recv) OVER (PARTITION BY bucket), 1) * 0.7::DOUBLE + (fan_out + fan_in) / 10.0 * 0.3::DOUBLE) AS activity_score FROM (
 SELECT bucket, ip, count(DISTINCT peer) FILTER (WHERE o) AS fan_out, count(DISTINCT peer) FILTER (WHERE NOT o) AS fan_in, count(DISTINCT dst_port) AS port_diversity,
  CAST(coalesce(sum(b) FILTER (WHERE o), 0) AS BIGINT) AS bytes_sent, CAST(coalesce(sum(b) FILTER (WHERE NOT o), 0) AS BIGINT) AS bytes_recv,
  CAST(coalesce(sum(p) FILTER (WHERE o), 0) AS BIGINT) AS packets_sent, CAST(coalesce(sum(p) FILTER (WHERE NOT o), 0) AS BIGINT) AS packets_recv FROM gn_half GROUP BY 1, 2)""")
cte("gidx_v", "SELECT bucket, row_number() OVER (ORDER BY bucket) AS idx FROM (SELECT DISTINCT bucket FROM ge_v)")
cte("gnp_v", """
SELECT n.*, i.idx, p.fan_out AS pf, p.bytes_sent + p.bytes_recv AS pv, n.bytes_sent + n.bytes_recv AS vol FROM gn_v n JOIN gidx_v i USING (bucket)
LEFT JOIN (SELECT n.*, i.idx FROM gn_v n JOIN gidx_v i USING (bucket)) p ON p.ip = n.ip AND p.idx = i.idx - 1""")
cte("gc_v", """
SELECT *, CASE WHEN idx = 1 THEN 0.0 WHEN new_node THEN 0.8 ELSE least(1.0, CASE WHEN surge THEN 0.5 ELSE 0 END + CASE WHEN spike THEN 0.4 ELSE 0 END) END AS structural_change FROM (
 SELECT *, idx > 1 AND pf IS NULL AS new_node, coalesce(idx > 1 AND fan_out - pf >= 4, false) AS surge,
  coalesce(idx > 1 AND (vol + 1) / (pv + 1) > 3 AND vol > 50000, false) AS spike FROM gnp_v)""")
cte("gm_v", """
SELECT *, CASE WHEN node_count > 1 THEN edge_count / (node_count * (node_count - 1)) ELSE edge_count END AS density FROM (
 SELECT bucket, count(*) AS node_count, max(fan_out) AS max_fan_out, max(fan_in) AS max_fan_in, avg(fan_out + fan_in) AS mean_degree FROM gn_v GROUP BY 1)
 JOIN (SELECT bucket, count(*) AS edge_count, CAST(sum(byte_count) AS BIGINT) AS total_bytes, CAST(sum(packet_count) AS BIGINT) AS total_packets FROM ge_v GROUP BY 1) USING (bucket)""")


def edges(spark, d, seconds=MONTH):
    return gr.graph_edges(base.flows(spark, d), seconds)


def changed(spark, d):
    e = edges(spark, d)
    return gr.graph_changes(e, gr.graph_nodes(e))


@query("gra1_graph_snapshot", """
SELECT bucket, ip, fan_out, fan_in, fan_out + fan_in AS total_degree, port_diversity, bytes_sent, bytes_recv, packets_sent, packets_recv, round(activity_score, 5) AS activity_score FROM gn_v""")
def gra1(spark, d):
    # written once in between: what made the edges leaves the disk before the nodes are counted
    return gr.graph_nodes(stored(edges(spark, d).select("bucket", "src_ip", "dst_ip", "dst_port", "packet_count", "byte_count"))).drop("is_external").withColumn(
        "activity_score", r(F.col("activity_score"), 5))


@query("gra1_graph_edges", "SELECT bucket, src_ip, dst_ip, protocol, dst_port, flow_count, packet_count, byte_count, round(max_duration, 3) AS max_duration, round(weight, 4) AS weight FROM ge_v")
def gra1_edges(spark, d):
    return edges(spark, d).drop("syn_count", "rst_count").withColumns({"max_duration": r(F.col("max_duration"), 3), "weight": r(F.col("weight"), 4)})


@query("gra2_graph_metrics", "SELECT bucket, node_count, edge_count, total_bytes, total_packets, max_fan_out, max_fan_in, round(mean_degree, 6) AS mean_degree, round(density, 6) AS density, 1::BIGINT AS unique_subnets FROM gm_v")
def gra2(spark, d):
    e = edges(spark, d)
    return gr.graph_metrics(e, gr.graph_nodes(e)).withColumns({"mean_degree": r(F.col("mean_degree")), "density": r(F.col("density"))})


@query("gra3_graph_changes", """
SELECT bucket, ip AS entity, 'NEW_NODE' AS change_type, CASE WHEN fan_out < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, round(fan_out, 4) AS metric_delta FROM gc_v WHERE new_node UNION ALL
SELECT bucket, ip, 'SUDDEN_FAN_OUT', 'HIGH', round(fan_out - pf, 4) FROM gc_v WHERE surge UNION ALL
SELECT bucket, ip, 'VOLUME_SPIKE', 'MEDIUM', round((vol + 1) / (pv + 1), 4) FROM gc_v WHERE spike""")
def gra3(spark, d):
    return gr.change_signals(changed(spark, d)[1]).withColumn("metric_delta", r(F.col("metric_delta"), 4))


@query("gra3_new_edges", """
SELECT e.bucket, count(*) FILTER (WHERE p.idx IS NULL) AS new_edges, count(*) AS edges FROM ge_v e JOIN gidx_v i ON e.bucket = i.bucket
LEFT JOIN (SELECT g.*, idx FROM ge_v g JOIN gidx_v USING (bucket)) p ON p.idx = i.idx - 1 AND p.src_ip = e.src_ip AND p.dst_ip = e.dst_ip AND p.protocol = e.protocol AND p.dst_port = e.dst_port GROUP BY 1""")
def gra3_edges(spark, d):
    return changed(spark, d)[0].groupBy("bucket").agg(F.count_if("is_new").alias("new_edges"), F.count("*").alias("edges"))


@query("gra4_graph_sequence_top10", """
SELECT ip, ranking, round(activity_score, 5) AS activity_score, round(structural_change, 3) AS structural_change, fan_out FROM (
 (SELECT *, 'activity' AS ranking FROM gc_v WHERE bucket = (SELECT max(bucket) FROM gc_v) ORDER BY activity_score DESC, fan_out + fan_in DESC, ip LIMIT 10) UNION ALL
 (SELECT *, 'change' FROM gc_v WHERE bucket = (SELECT max(bucket) FROM gc_v) ORDER BY structural_change DESC, fan_out DESC, ip LIMIT 10))""")
def gra4(spark, d):
    return gr.top_nodes(changed(spark, d)[1], 10).select(
        "ip", "ranking", r(F.col("activity_score"), 5).alias("activity_score"), r(F.col("structural_change"), 3).alias("structural_change"), "fan_out")


@query("gra4_graph_vector", """
WITH c AS (SELECT * FROM gc_v WHERE bucket = (SELECT max(bucket) FROM gc_v)), m AS (SELECT * FROM gm_v WHERE bucket = (SELECT max(bucket) FROM gm_v)),
ne AS (SELECT count(*) AS n FROM ge_v e JOIN gidx_v i ON e.bucket = i.bucket LEFT JOIN (SELECT g.*, idx FROM ge_v g JOIN gidx_v USING (bucket)) p
  ON p.idx = i.idx - 1 AND p.src_ip = e.src_ip AND p.dst_ip = e.dst_ip AND p.protocol = e.protocol AND p.dst_port = e.dst_port WHERE p.idx IS NULL AND e.bucket = (SELECT max(bucket) FROM ge_v)),
v AS (SELECT [node_count, edge_count, density, max_fan_out, max_fan_in, mean_degree, 1.0::DOUBLE,
 (SELECT sum(CAST(new_node AS INT) + CAST(surge AS INT) + CAST(spike AS INT)) FROM c), (SELECT count(*) FROM c WHERE fan_out >= 5), (SELECT count(*) FROM c WHERE structural_change >= 0.4),
 (SELECT n FROM ne), total_bytes / 1e6::DOUBLE, total_packets / 1e3::DOUBLE, (SELECT count(*) FROM gm_v), (SELECT max(activity_score) FROM c), (SELECT max(structural_change) FROM c)] AS a FROM m)
SELECT i AS dimension, round(CAST(a[i] AS DOUBLE), 4) AS value FROM v, (SELECT unnest(range(1, 17)) AS i)""")
def gra4_vector(spark, d):
    e, n = changed(spark, d)
    m = gr.graph_metrics(e, n)
    return gr.graph_vector(e, n, m).select(F.posexplode("vector").alias("p", "value")).select(
        (F.col("p") + 1).cast("bigint").alias("dimension"), r(F.col("value"), 4).alias("value"))


@query("gra5_graph_projection", """
WITH c AS (SELECT * FROM gc_v WHERE bucket = (SELECT max(bucket) FROM gc_v)),
m AS (SELECT *, greatest(0.8, least(2.5, edge_count / lag(edge_count) OVER (ORDER BY bucket))) AS rate FROM gm_v),
x AS (SELECT m.*, k, (SELECT count(*) FROM c WHERE fan_out >= 5) AS threat_nodes, node_count + (SELECT count(*) FROM c WHERE structural_change > 0.3) * least(k, 2) AS pn,
 CAST(floor(edge_count * (1 + (rate - 1) * pow(0.6, k))) AS BIGINT) AS pe FROM m, (SELECT unnest(range(1, 6)) AS k) WHERE bucket = (SELECT max(bucket) FROM gm_v))
SELECT CAST(k AS INT) AS horizon_step, pn AS predicted_node_count, pe AS predicted_edge_count, threat_nodes, round(least(1.0, pe / (pn * (pn - 1))), 6) AS predicted_density,
 round(max_fan_out * CASE WHEN threat_nodes > 0 THEN 1 + 0.15 * k ELSE 1 END, 2) AS predicted_fanout_expansion,
 round(greatest(0.35, least(0.92, 0.88 * exp(-0.12 * k))), 3) AS propagation_confidence FROM x""")
def gra5(spark, d):
    e, n = changed(spark, d)
    return gr.graph_projection(gr.graph_metrics(e, n), n).withColumn("predicted_density", r(F.col("predicted_density")))


@query("gra5_propagation_targets", """
WITH l AS (SELECT * FROM gn_half WHERE bucket = (SELECT max(bucket) FROM gn_half)), t AS (SELECT ip FROM gn_v WHERE bucket = (SELECT max(bucket) FROM gn_v) AND fan_out >= 5)
SELECT DISTINCT bucket, peer AS ip FROM l WHERE ip IN (SELECT ip FROM t) AND peer NOT IN (SELECT ip FROM t)""")
def gra5_targets(spark, d):
    e, n = changed(spark, d)
    return gr.propagation_targets(e, n)


@query("gra6_graph_evolution", """
WITH k AS (SELECT e.bucket, count(p.idx) AS ke FROM ge_v e JOIN gidx_v i ON e.bucket = i.bucket LEFT JOIN (SELECT g.*, idx FROM ge_v g JOIN gidx_v USING (bucket)) p
  ON p.idx = i.idx - 1 AND p.src_ip = e.src_ip AND p.dst_ip = e.dst_ip AND p.protocol = e.protocol AND p.dst_port = e.dst_port GROUP BY 1),
n AS (SELECT bucket, count(pf) AS kn, max(fan_out + fan_in) AS max_degree FROM gnp_v GROUP BY 1),
m AS (SELECT *, lag(edge_count) OVER (ORDER BY bucket) AS pe, lag(node_count) OVER (ORDER BY bucket) AS pv FROM gm_v JOIN k USING (bucket) JOIN n USING (bucket))
SELECT bucket, node_count, edge_count, round(mean_degree, 5) AS mean_degree, max_degree, round(2.0 * edge_count / (node_count * (node_count - 1)), 6) AS graph_density,
 round(CASE WHEN pe IS NULL THEN 0 ELSE (edge_count + pe - 2 * ke) / (edge_count + pe) END, 6) AS edge_churn_rate,
 round(CASE WHEN pv IS NULL THEN 0 ELSE (node_count + pv - 2 * kn) / (node_count + pv) END, 6) AS node_churn_rate,
 round(CASE WHEN pv IS NULL THEN 0 ELSE (node_count - kn) / node_count END, 6) AS peer_novelty_rate,
 round(least(1.0, node_count / 256.0), 6) AS graph_observability_score, node_count < 128 OR node_count <= 2 AS is_partial_capture FROM m""")
def gra6(spark, d):
    e = edges(spark, d)
    g = gr.graph_evolution(e, gr.graph_nodes(e)).drop("max_betweenness_approx")
    return g.withColumns({n: r(F.col(n)) for n in ("graph_density", "edge_churn_rate", "node_churn_rate", "peer_novelty_rate",
                                                   "graph_observability_score")} | {"mean_degree": r(F.col("mean_degree"), 5)})


def day_pairs(spark, d):
    return base.flows(spark, d).select(F.floor(F.col("start_ts") / DAY).cast("bigint").alias("bucket"), "src_ip", "dst_ip").distinct()


@query("gra7_connected_components", f"""
WITH RECURSIVE e AS (SELECT DISTINCT CAST(floor(start_ts / {DAY}) AS BIGINT) AS bucket, src_ip, dst_ip FROM flows_v),
b AS (SELECT bucket, src_ip AS x, dst_ip AS y FROM e UNION SELECT bucket, dst_ip, src_ip FROM e),
reach AS (SELECT bucket, x, x AS y FROM b UNION SELECT r.bucket, r.x, b.y FROM reach r JOIN b ON r.bucket = b.bucket AND r.y = b.x)
SELECT bucket, x AS node, min(y) AS component FROM reach GROUP BY 1, 2""")
def gra7(spark, d):
    return gr.connected_components(day_pairs(spark, d), ["bucket"])


IP = "(10 + (user_id % 3) * 81) || '.' || (user_id % 40) || '.' || (event_id % 4) || '.' || (event_id % 200)"
IP2 = "CASE WHEN event_id % 3 = 0 THEN '192.168.1.' || (user_id % 90) ELSE '172.' || (event_id % 40) || '.0.' || (user_id % 9) END"


@query("gra8_ip_class", f"""
WITH p AS (SELECT {IP} AS s, {IP2} AS t FROM events),
c AS (SELECT *, s LIKE '10.%' OR (s LIKE '172.%' AND CAST(split_part(s, '.', 2) AS INT) BETWEEN 16 AND 31) AS sp,
 t LIKE '192.168.%' OR (t LIKE '172.%' AND CAST(split_part(t, '.', 2) AS INT) BETWEEN 16 AND 31) AS tp FROM p)
SELECT CASE WHEN sp AND tp THEN 'INTERNAL' WHEN sp THEN 'OUTBOUND' WHEN tp THEN 'INBOUND' ELSE 'EXTERNAL' END AS direction,
 split_part(s, '.', 1) || '.' || split_part(s, '.', 2) || '.' || split_part(s, '.', 3) || '.0/24' AS src_subnet, count(*) AS n FROM c GROUP BY 1, 2""")
def gra8(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    s = F.concat_ws(".", 10 + (u % 3) * 81, u % 40, e % 4, e % 200)
    t = F.when(e % 3 == 0, F.concat(F.lit("192.168.1."), u % 90)).otherwise(F.concat(F.lit("172."), e % 40, F.lit(".0."), u % 9))
    p = base.views.table(spark, d, "events").select(s.alias("src_ip"), t.alias("dst_ip"))
    return gr.ip_class(p).groupBy("direction", "src_subnet").agg(F.count("*").alias("n"))


# --- world state --------------------------------------------------------------------------------
ZEEK = {"ESTABLISHED": "S1", "REJECTED": "REJ", "ATTEMPTED": "S0", "RESET": "RSTR", "CLOSED": "SF", "INCOMPLETE": "OTH"}
cte("ent_v", """
SELECT g.*, coalesce(s.f / s.n, 0) AS failure_ratio, CASE WHEN bucket = (SELECT max(bucket) FROM gn_half) THEN 'LAST_OBSERVED_AT_CAPTURE_BOUNDARY'
  WHEN bucket = min(bucket) OVER (PARTITION BY entity) THEN 'NEWLY_EMERGED' ELSE 'ACTIVE' END AS presence,
 CASE WHEN entity LIKE 's1%' AND bucket % 2 = 0 THEN 'RECONNAISSANCE' ELSE 'BENIGN' END AS attack_state FROM (
 SELECT bucket, ip AS entity, count(DISTINCT peer) AS fanout, count(DISTINCT dst_port) FILTER (WHERE o) AS port_diversity, CAST(coalesce(sum(b) FILTER (WHERE o), 0) AS BIGINT) AS bytes_sent,
  CAST(coalesce(sum(b) FILTER (WHERE NOT o), 0) AS BIGINT) AS bytes_recv, CAST(sum(p) AS BIGINT) AS packets FROM gn_half GROUP BY 1, 2) g
LEFT JOIN (SELECT bucket, entity, count(*) AS n, count(*) FILTER (WHERE state IN ('REJECTED', 'RESET', 'INCOMPLETE')) AS f FROM (
 SELECT bucket, src_ip AS entity, state FROM mf_v UNION ALL SELECT bucket, dst_ip, state FROM mf_v) GROUP BY 1, 2) s USING (bucket, entity)""")
cte("rel_v", """
SELECT *, CASE WHEN bucket = (SELECT max(bucket) FROM ge_v) THEN 'LAST_OBSERVED_AT_CAPTURE_BOUNDARY' WHEN bucket = min(bucket) OVER (PARTITION BY relationship_id) THEN 'NEW' ELSE 'PERSISTED' END AS presence FROM (
 SELECT bucket, src_ip || '->' || dst_ip || ':' || dst_port || '/' || protocol AS relationship_id, flow_count AS connection_count, packet_count, byte_count FROM ge_v)""")


def ents(spark, d):
    f = base.flows(spark, d).withColumn("bucket", F.floor(F.col("start_ts") / MONTH).cast("bigint"))
    z = F.create_map(*[F.lit(x) for kv in ZEEK.items() for x in kv])
    e = gr.entity_state(edges(spark, d), f.withColumn("zeek_state", z[F.col("state")]))
    # a per-window attack state, so that a diff has transitions to show
    return e.withColumn("attack_state", F.when(F.col("entity").startswith("s1") & (F.col("bucket") % 2 == 0), "RECONNAISSANCE").otherwise("BENIGN"))


@query("gra9_world_state", "SELECT bucket, entity, fanout, port_diversity, bytes_sent, bytes_recv, packets, presence, round(failure_ratio, 6) AS failure_ratio FROM ent_v")
def gra9(spark, d):
    return ents(spark, d).select("bucket", "entity", "fanout", "port_diversity", "bytes_sent", "bytes_recv", "packets", "presence",
                                 r(F.col("failure_ratio")).alias("failure_ratio"))


@query("gra9_relationship_state", "SELECT bucket, relationship_id, connection_count, packet_count, byte_count, presence FROM rel_v")
def gra9_rel(spark, d):
    return gr.relationship_state(edges(spark, d)).select("bucket", "relationship_id", "connection_count", "packet_count", "byte_count", "presence")


@query("gra10_world_diff", """
WITH a AS (SELECT * FROM ent_v WHERE bucket = (SELECT max(bucket) FROM ent_v) - 1), b AS (SELECT * FROM ent_v WHERE bucket = (SELECT max(bucket) FROM ent_v)),
j AS (SELECT coalesce(a.entity, b.entity) AS item, a.entity AS ea, b.entity AS eb, a.attack_state AS sa, b.attack_state AS sb, a.fanout AS fa, b.fanout AS fb, a.packets AS pa, b.packets AS pb,
 a.bytes_sent + a.bytes_recv AS va, b.bytes_sent + b.bytes_recv AS vb FROM a FULL JOIN b ON a.entity = b.entity),
ra AS (SELECT relationship_id FROM rel_v WHERE bucket = (SELECT max(bucket) FROM ent_v) - 1), rb AS (SELECT relationship_id FROM rel_v WHERE bucket = (SELECT max(bucket) FROM ent_v))
SELECT item, 'ENTITY_ADDED' AS change, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM j WHERE ea IS NULL UNION ALL
SELECT item, 'ENTITY_PERSISTED', NULL, NULL FROM j WHERE ea IS NOT NULL AND eb IS NOT NULL UNION ALL
SELECT item, 'ENTITY_NOT_OBSERVED', NULL, NULL FROM j WHERE eb IS NULL UNION ALL
SELECT item, 'ATTACK_STATE_TRANSITION', sa, sb FROM j WHERE sa <> sb UNION ALL
SELECT item, 'FANOUT_SURGE', CAST(fa AS VARCHAR), CAST(fb AS VARCHAR) FROM j WHERE fb > fa AND (fb - fa >= 3 OR (fa > 0 AND fb / fa >= 2)) UNION ALL
SELECT item, 'VOLUME_DELTA', CAST(pb - pa AS VARCHAR), CAST(vb - va AS VARCHAR) FROM j WHERE ea IS NOT NULL AND eb IS NOT NULL AND (pa <> pb OR va <> vb) UNION ALL
(SELECT relationship_id, 'RELATIONSHIP_ADDED', NULL, NULL FROM (FROM rb EXCEPT FROM ra)) UNION ALL
(SELECT relationship_id, 'RELATIONSHIP_NOT_OBSERVED', NULL, NULL FROM (FROM ra EXCEPT FROM rb))""")
def gra10(spark, d):
    e = ents(spark, d)
    last = e.agg(F.max("bucket").alias("b")).scalar()
    return gr.world_diff(e, gr.relationship_state(edges(spark, d)), last - 1, last)


@query("gra11_entity_window_timeline", """
WITH g AS (SELECT entity, bucket FROM (SELECT DISTINCT entity FROM ent_v), (SELECT DISTINCT bucket FROM ent_v))
SELECT bucket, entity, coalesce(presence, 'NOT_OBSERVED') AS presence, fanout, packets FROM g LEFT JOIN ent_v USING (entity, bucket)""")
def gra11(spark, d):
    return gr.entity_timeline_grid(ents(spark, d))


@query("gra11_presence_intervals", """
WITH w AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS i FROM (SELECT DISTINCT bucket FROM ent_v)),
g AS (SELECT entity, i, w.bucket, coalesce(presence, 'NOT_OBSERVED') AS presence FROM (SELECT DISTINCT entity FROM ent_v) CROSS JOIN w LEFT JOIN ent_v USING (entity, bucket)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY entity, presence ORDER BY i) AS run FROM g)
SELECT entity, presence, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS windows FROM r GROUP BY entity, presence, run""")
def gra11_intervals(spark, d):
    return gr.presence_intervals(ents(spark, d))


@query("ent3_host_profile", """
WITH pr AS (SELECT bucket, src_ip AS ip, count(DISTINCT dst_port) AS ports FROM ge_v WHERE dst_port > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(ports, 0) AS probed_ports, CASE WHEN pf IS NULL THEN 0.0 ELSE least(1.0, abs(fan_out - pf) * 0.1::DOUBLE + least(0.5, abs(vol - pv) / greatest(1.0, pv) * 0.1::DOUBLE)) END AS tc
 FROM gnp_v n LEFT JOIN pr USING (bucket, ip)),
y AS (SELECT *, probed_ports >= 10 OR fan_out >= 15 AS scanner FROM x)
SELECT bucket, ip, bytes_sent, bytes_recv, fan_out AS outbound_peers, fan_in AS inbound_peers, probed_ports, round(tc, 5) AS temporal_change_score,
 round(least(0.99, 0.05 + CASE WHEN scanner THEN 0.45 ELSE 0 END + CASE WHEN bytes_sent > 10000000 THEN 0.2 ELSE 0 END + CASE WHEN tc > 0.3 THEN 0.15 ELSE 0 END), 5) AS risk_score,
 round(tc * 0.8::DOUBLE + CASE WHEN scanner THEN 0.5 ELSE 0 END, 5) AS anomaly_score, round(greatest(0.05, 1 / (1 + ln(1 + packets_sent + packets_recv))), 5) AS uncertainty FROM y""")
def ent3(spark, d):
    e = edges(spark, d)
    h = gr.host_profile(e, gr.graph_nodes(e)).drop("is_external")
    return h.withColumns({n: r(F.col(n), 5) for n in ("temporal_change_score", "risk_score", "anomaly_score", "uncertainty")})
