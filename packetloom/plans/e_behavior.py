"""Behaviour queries: BEH3-BEH21, FLW10, STR-free parts of the baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.columns import r
from packetloom.functions.quantiles import group_entropy, group_gini
from packetloom.operators import behavior as bh, flows as fl
from packetloom.plans import base
from packetloom.plans.a_views import DAY
from packetloom.plans.registry import cte, query

MONTH = 30 * DAY
QUARTER = 90 * DAY

cte("beacon_iv", """
SELECT src_ip, dst_ip, dst_port, protocol, start_ts, start_ts - lag(start_ts) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY start_ts) AS g FROM flows_v""")
cte("beacon_v", """
SELECT *, least(greatest(1 - cv / 0.70, 0), 1) AS score, cv <= 0.35 AND least(greatest(1 - cv / 0.70, 0), 1) >= 0.5 AS is_beaconing FROM (
 SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS n, avg(g) AS mu, stddev_pop(g) AS sd, stddev_pop(g) / greatest(avg(g), 1e-6) AS cv
 FROM beacon_iv GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4 AND avg(g) >= 0.1)""")


def beacons(spark, d):
    return bh.beaconing(base.flows(spark, d))


@query("beh3_beaconing", """
SELECT src_ip, dst_ip, dst_port, protocol, n AS connection_count, round(mu, 2) AS mean_interval_seconds, round(sd, 2) AS std_interval_seconds,
 round(cv, 4) AS coefficient_of_variation, round(score, 4) AS score, round(least(1.0, n / 10.0), 2) AS confidence, is_beaconing FROM beacon_v""")
def beh3(spark, d):
    return beacons(spark, d).withColumns({
        "mean_interval_seconds": r(F.col("mean_interval_seconds"), 2), "std_interval_seconds": r(F.col("std_interval_seconds"), 2),
        "coefficient_of_variation": r(F.col("coefficient_of_variation"), 4), "score": r(F.col("score"), 4),
        "confidence": r(F.col("confidence"), 2)})


cte("per_iv", """
SELECT *, lag(g) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY start_ts) AS pg FROM (
 SELECT *, start_ts - lag(start_ts) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY start_ts) AS g FROM (
  SELECT DISTINCT src_ip, dst_ip, dst_port, protocol, start_ts FROM flows_v))""")
cte("per_sorted", """
SELECT src_ip, dst_ip, dst_port, protocol, list_sort(list(g)) AS gs, count(*) AS n, avg(g) AS mu, stddev_pop(g) AS sd, avg(abs(g - pg)) AS jitter
FROM per_iv WHERE g IS NOT NULL GROUP BY 1, 2, 3, 4""")
cte("per_stat", """
SELECT *, list_aggregate(gs, 'quantile_cont', 0.5) AS med,
 list_aggregate(list_transform(gs, lambda x: abs(x - list_aggregate(gs, 'quantile_cont', 0.5))), 'quantile_cont', 0.5) AS mad,
 list_aggregate(gs[1:n // 2], 'quantile_cont', 0.5) AS q1, list_aggregate(gs[n - n // 2 + 1:n], 'quantile_cont', 0.5) AS q3 FROM per_sorted""")
cte("per_bins", """
SELECT src_ip, dst_ip, dst_port, protocol, -sum(c / t * log2(c / t)) AS h FROM (
 SELECT *, sum(c) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol) AS t FROM (
  SELECT i.src_ip, i.dst_ip, i.dst_port, i.protocol, least(floor((g - gs[1]) / ((gs[-1] - gs[1]) / 10)), 9) AS b, count(*) AS c
  FROM per_iv i JOIN per_sorted s USING (src_ip, dst_ip, dst_port, protocol) WHERE g IS NOT NULL AND gs[-1] - gs[1] >= 1e-6 GROUP BY ALL)) GROUP BY ALL""")
cte("per_v", """
SELECT e.*, s.n, s.mu, s.sd, s.sd / greatest(s.mu, 1e-6) AS cv, s.med, s.mad, coalesce(s.jitter, 0) AS jitter, coalesce(b.h, 0) AS h,
 CASE WHEN s.n < 4 THEN NULL WHEN q3 - q1 < 1e-6 THEN 0 ELSE least(greatest((q3 + q1 - 2 * med) / (q3 - q1), -1), 1) END AS skew,
 e.event_count >= 4 AND coalesce(s.n, 0) >= 3 AS enough, sum(event_count) OVER (PARTITION BY e.src_ip) AS src_total
FROM (SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS event_count, max(start_ts) - min(start_ts) AS dur FROM flows_v GROUP BY 1, 2, 3, 4) e
LEFT JOIN per_stat s USING (src_ip, dst_ip, dst_port, protocol) LEFT JOIN per_bins b USING (src_ip, dst_ip, dst_port, protocol)""")
cte("per_r", """
SELECT *, CASE WHEN enough THEN round(0.4::DOUBLE * greatest(0, 1 - cv / 0.70) + 0.35::DOUBLE * greatest(0, 1 - mad / greatest(med, 1e-6))
 + 0.25::DOUBLE * coalesce(greatest(0, 1 - abs(skew)), greatest(0, 1 - mad / greatest(med, 1e-6))), 4) ELSE 0 END AS reg FROM per_v""")


@query("beh4_periodicity", """
SELECT src_ip, dst_ip, dst_port, protocol, event_count, round(dur, 2) AS observation_duration_seconds,
 CASE WHEN event_count < 4 THEN event_count - 1 ELSE coalesce(n, 0) END AS interval_count,
 round(CASE WHEN enough THEN med END, 3) AS median_interval, round(CASE WHEN enough THEN mad END, 3) AS mad_interval,
 round(CASE WHEN enough THEN jitter END, 3) AS jitter, round(CASE WHEN enough THEN skew END, 4) AS bowley_skewness,
 round(CASE WHEN enough THEN h END, 4) AS interval_entropy, round(reg, 4) AS regularity_score,
 round(event_count / greatest(1, src_total), 4) AS destination_consistency,
 CASE WHEN NOT enough THEN 'INSUFFICIENT_OBSERVATIONS' WHEN reg >= 0.85 AND cv <= 0.15 THEN 'HIGHLY_PERIODIC' WHEN reg >= 0.65 AND cv <= 0.35 THEN 'PERIODIC'
  WHEN reg >= 0.4 AND cv <= 0.6 THEN 'WEAKLY_PERIODIC' ELSE 'IRREGULAR' END AS classification FROM per_r""")
def beh4(spark, d):
    p = bh.periodicity(base.flows(spark, d))
    k = {"observation_duration_seconds": 2, "median_interval": 3, "mad_interval": 3, "jitter": 3, "bowley_skewness": 4,
         "interval_entropy": 4, "regularity_score": 4}
    return p.drop("mean_interval", "std_interval", "coefficient_of_variation").withColumns({n: r(F.col(n), x) for n, x in k.items()})


SRC_IV = """SELECT src_ip, start_ts - lag(start_ts) OVER (PARTITION BY src_ip ORDER BY start_ts) AS g FROM (SELECT DISTINCT src_ip, start_ts FROM flows_v)"""
cte("src_sorted", f"SELECT src_ip, list_sort(list(g)) AS gs, count(*) AS n FROM ({SRC_IV}) WHERE g IS NOT NULL GROUP BY 1")


def _shape(spark, d):
    return bh.interval_shapes(base.flows(spark, d), ["src_ip"], "start_ts", DAY)


@query("beh5_mad", """
SELECT src_ip, round(list_aggregate(gs, 'quantile_cont', 0.5), 3) AS median_interval,
 round(list_aggregate(list_transform(gs, lambda x: abs(x - list_aggregate(gs, 'quantile_cont', 0.5))), 'quantile_cont', 0.5), 3) AS mad_interval FROM src_sorted""")
def beh5(spark, d):
    return _shape(spark, d).select("src_ip", r(F.col("median_interval"), 3).alias("median_interval"), r(F.col("mad_interval"), 3).alias("mad_interval"))


@query("beh6_bowley", """
SELECT src_ip, round(CASE WHEN n < 4 THEN NULL WHEN q3 - q1 < 1e-6 THEN 0 ELSE least(greatest((q3 + q1 - 2 * med) / (q3 - q1), -1), 1) END, 4) AS bowley_skewness FROM (
 SELECT src_ip, n, list_aggregate(gs, 'quantile_cont', 0.5) AS med, list_aggregate(gs[1:n // 2], 'quantile_cont', 0.5) AS q1,
  list_aggregate(gs[n - n // 2 + 1:n], 'quantile_cont', 0.5) AS q3 FROM src_sorted)""")
def beh6(spark, d):
    return _shape(spark, d).select("src_ip", r(F.col("bowley_skewness"), 4).alias("bowley_skewness"))


@query("beh7_interval_entropy", """
SELECT src_ip, round(-sum(c / t * log2(c / t)), 4) AS interval_entropy FROM (SELECT *, sum(c) OVER (PARTITION BY src_ip) AS t FROM (
 SELECT src_ip, least(floor((g - gs[1]) / ((gs[-1] - gs[1]) / 10)), 9) AS b, count(*) AS c FROM (SELECT src_ip, gs, unnest(gs) AS g FROM src_sorted) GROUP BY ALL)) GROUP BY 1""")
def beh7(spark, d):
    return _shape(spark, d).select("src_ip", r(F.col("interval_entropy"), 4).alias("interval_entropy"))


@query("beh8_string_entropy", """
SELECT doc_id, round(-sum(c / t * log2(c / t)), 4) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS t FROM (
 SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY 1, 2)) GROUP BY 1""")
def beh8(spark, d):
    return bh.string_entropy(base.views.table(spark, d, "documents"), "doc_id", "text").withColumn("entropy", r(F.col("entropy"), 4))


@query("beh8_dns_tunnel_signals", """
WITH n AS (SELECT DISTINCT 'c' || (page_id % 20) AS src_ip, url AS q FROM pages),
e AS (SELECT src_ip, q, round(-sum(c / t * log2(c / t)), 4) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY src_ip, q) AS t FROM (
 SELECT src_ip, q, ch, count(*) AS c FROM (SELECT src_ip, q, unnest(regexp_extract_all(q, '(?s).')) AS ch FROM n) GROUP BY 1, 2, 3)) GROUP BY 1, 2)
SELECT src_ip, count(*) AS names, round(avg(h), 6) AS mean_entropy, round(avg(length(q)), 6) AS mean_length, avg(h) >= 3.6 OR avg(length(q)) >= 24 AS is_suspicious FROM e GROUP BY 1""")
def beh8_dns(spark, d):
    q = base.views.table(spark, d, "pages").select(F.concat(F.lit("c"), F.col("page_id") % 20).alias("src_ip"), F.col("url").alias("query"))
    return bh.dns_tunnel_signals(q).withColumns({"mean_entropy": r(F.col("mean_entropy")), "mean_length": r(F.col("mean_length"))})


@query("beh9_behaviour_risk_score", """
SELECT b AS high_risk_beacons, l AS long_lived_flow_count, 0 AS dns_signals, round(least(100, least(60, 25.0 * b) + least(20, 5.0 * l)), 2) AS summary_score FROM (
 SELECT (SELECT count(*) FROM beacon_v WHERE is_beaconing AND score >= 0.7) AS b, (SELECT count(*) FROM flows_v WHERE end_ts - start_ts >= 300) AS l)""")
def beh9(spark, d):
    return bh.behaviour_risk_score(beacons(spark, d), base.flows(spark, d))


cte("ew_v", f"""
SELECT src_ip AS entity, CAST(floor(start_ts / {MONTH}) AS BIGINT) AS bucket, count(*) AS sessions, CAST(sum(fwd_packets + rev_packets) AS BIGINT) AS packets,
 CAST(sum(fwd_bytes + rev_bytes) AS BIGINT) AS bytes, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS peers,
 count(*) FILTER (WHERE state IN ('REJECTED', 'RESET')) AS failed_sessions FROM flows_v GROUP BY 1, 2""")


def ew(spark, d, seconds=MONTH):
    return bh.entity_windows(base.flows(spark, d), seconds)


cte("bl_v", """
SELECT e.entity, count(*) AS window_count, max(e.bucket) AS evaluation_window, """ + ", ".join(
    f"avg({m}) FILTER (WHERE e.bucket < l) AS {m}_mean, stddev_pop({m}) FILTER (WHERE e.bucket < l) AS {m}_std, CAST(max({m}) FILTER (WHERE e.bucket = l) AS DOUBLE) AS {m}_now"
    for m in bh.BASELINE_METRICS) + """
FROM ew_v e JOIN (SELECT entity, max(bucket) AS l FROM ew_v GROUP BY 1) x USING (entity) GROUP BY 1""")
cte("bl_z", """
SELECT *, (ports_now - ports_mean) / nullif(ports_std, 0) AS ports_z, (peers_now - peers_mean) / nullif(peers_std, 0) AS peers_z,
 (packets_now - packets_mean) / nullif(packets_std, 0) AS packets_z FROM bl_v""")


@query("beh10_entity_baseline", """
SELECT entity, window_count, evaluation_window, """ + ", ".join(f"round({m}_mean, 4) AS {m}_mean, round({m}_std, 3) AS {m}_std" for m in bh.BASELINE_METRICS) + """,
 round(ports_z, 4) AS ports_z, round(peers_z, 4) AS peers_z, round(packets_z, 4) AS packets_z,
 CASE WHEN window_count < 3 THEN 'INSUFFICIENT_HISTORY' WHEN coalesce(ports_z >= 2.5, false) OR coalesce(peers_z >= 2.5, false) OR coalesce(packets_z >= 3, false)
  THEN 'BASELINE_SHIFT' ELSE 'BASELINE_STABLE' END AS status FROM bl_z""")
def beh10(spark, d):
    b = bh.entity_baseline(ew(spark, d))
    return b.select("entity", "window_count", "evaluation_window",
                    *[r(F.col(f"{m}_mean"), 4).alias(f"{m}_mean") for m in bh.BASELINE_METRICS],
                    *[r(F.col(f"{m}_std"), 3).alias(f"{m}_std") for m in bh.BASELINE_METRICS],
                    *[r(F.col(f"{m}_z"), 4).alias(f"{m}_z") for m in ("ports", "peers", "packets")], "status")


@query("beh10_deviations", """
SELECT entity, evaluation_window AS bucket, t AS deviation_type, m AS metric_name, round(z, 4) AS z_score,
 'dev_' || (sha256(entity || ':' || evaluation_window || ':' || t)) AS deviation_id FROM (
 SELECT entity, evaluation_window, window_count, 'PORT_EXPANSION' AS t, 'ports' AS m, ports_z AS z, 2.5 AS lim FROM bl_z UNION ALL
 SELECT entity, evaluation_window, window_count, 'PEER_EXPANSION', 'peers', peers_z, 2.5 FROM bl_z UNION ALL
 SELECT entity, evaluation_window, window_count, 'VOLUME_SHIFT', 'packets', packets_z, 3.0 FROM bl_z) WHERE z >= lim AND window_count >= 3""")
def beh10_dev(spark, d):
    return bh.entity_deviations(bh.entity_baseline(ew(spark, d))).select(
        "entity", "bucket", "deviation_type", "metric_name", r(F.col("z_score"), 4).alias("z_score"), "deviation_id")


@query("beh11_regime_memory", """
WITH o AS (SELECT src_ip AS entity, dst_ip AS peer, dst_port AS port, row_number() OVER (PARTITION BY src_ip ORDER BY ts, packet_index) AS i FROM packets_v),
f AS (SELECT *, i > 1 AND (row_number() OVER (PARTITION BY entity, peer ORDER BY i) = 1 OR row_number() OVER (PARTITION BY entity, port ORDER BY i) = 1) AS novel FROM o),
l AS (SELECT entity, count(*) AS observations, list(CASE WHEN novel THEN 0.15::DOUBLE ELSE -0.02::DOUBLE END ORDER BY i) AS steps FROM f GROUP BY 1),
s AS (SELECT entity, observations, list_reduce(list_prepend(0.0::DOUBLE, steps), lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + x))) AS sc FROM l)
SELECT entity, observations, round(sc, 4) AS divergence_score, CASE WHEN sc >= 0.70 - 1e-9 THEN 'SEVERE_REGIME_DEPARTURE' WHEN sc >= 0.35 - 1e-9 THEN 'ELEVATED_NOVELTY'
 ELSE 'BENIGN_EQUILIBRIUM' END AS active_regime FROM s""")
def beh11(spark, d):
    o = base.packets(spark, d).select(F.col("src_ip").alias("entity"), F.col("dst_ip").alias("peer"), F.col("dst_port").alias("port"),
                                      "ts", "packet_index")
    m = bh.regime_memory(o, ["ts", "packet_index"], "ts")
    s = F.col("divergence_score")
    return m.select("entity", F.col("observations").cast("bigint").alias("observations"), r(s, 4).alias("divergence_score"),
                    F.when(s >= 0.70 - 1e-9, "SEVERE_REGIME_DEPARTURE").when(s >= 0.35 - 1e-9, "ELEVATED_NOVELTY")
                    .otherwise("BENIGN_EQUILIBRIUM").alias("active_regime"))


cte("ew_prev", """
SELECT e.*, i.idx, coalesce(p.ports, 0) AS pp, coalesce(p.sessions, 0) AS ps, coalesce(p.failed_sessions, 0) AS pf FROM ew_v e
JOIN (SELECT bucket, row_number() OVER (ORDER BY bucket) AS idx FROM (SELECT DISTINCT bucket FROM ew_v)) i USING (bucket)
LEFT JOIN (SELECT e.*, i.idx FROM ew_v e JOIN (SELECT bucket, row_number() OVER (ORDER BY bucket) AS idx FROM (SELECT DISTINCT bucket FROM ew_v)) i USING (bucket)) p
 ON p.entity = e.entity AND p.idx = i.idx - 1""")
cte("chg_v", """
SELECT entity, bucket, t AS change_type, CAST(c - p AS DOUBLE) AS magnitude, CAST(p AS DOUBLE) AS baseline_value, CAST(c AS DOUBLE) AS current_value FROM (
 SELECT entity, bucket, 'PORT_FANOUT_SURGE' AS t, ports AS c, pp AS p FROM ew_prev WHERE idx > 1 AND ports >= 5 AND ports - pp >= 4 UNION ALL
 SELECT entity, bucket, 'CONNECTION_ATTEMPT_SURGE', sessions, ps FROM ew_prev WHERE idx > 1 AND sessions >= 10 AND sessions >= 3 * greatest(1, ps) UNION ALL
 SELECT entity, bucket, 'FAILED_SESSION_SPIKE', failed_sessions, pf FROM ew_prev WHERE idx > 1 AND failed_sessions >= 5 AND failed_sessions >= 2 * greatest(1, pf))""")


@query("beh12_change_detection", "SELECT * FROM chg_v")
def beh12(spark, d):
    return bh.change_detection(ew(spark, d))


cte("qf_v", f"SELECT *, CAST(floor(start_ts / {QUARTER}) AS BIGINT) AS bucket FROM flows_v")
cte("qe_v", "SELECT DISTINCT bucket, src_ip, dst_ip, dst_port FROM qf_v")
cte("qidx_v", "SELECT bucket, row_number() OVER (ORDER BY bucket) AS idx FROM (SELECT DISTINCT bucket FROM qf_v)")
cte("qip_v", "SELECT DISTINCT bucket, ip FROM (SELECT bucket, src_ip AS ip FROM qf_v UNION ALL SELECT bucket, dst_ip FROM qf_v)")
cte("bvec_v", """
SELECT bucket, n AS flow_count, peers / n AS peer_diversity, CASE WHEN idx = 1 THEN 0 ELSE coalesce(fresh, 0) / greatest(1.0, peers) END AS new_peer_rate,
 dsts / n AS dest_diversity, srcs / n AS src_diversity, pe AS port_entropy, pre AS protocol_entropy, n / dsts AS fan_in_ratio, n / srcs AS fan_out_ratio,
 gini AS traffic_concentration_gini, CASE WHEN idx = 1 THEN 0 ELSE (edges + pedges - 2 * kept) / greatest(1.0, edges + pedges) END AS edge_churn_rate,
 short / n AS connection_churn_rate, peers AS node_count, edges AS edge_count FROM (
 SELECT bucket, count(*) AS n, count(*) FILTER (WHERE end_ts - start_ts < 2) AS short, count(DISTINCT src_ip) AS srcs, count(DISTINCT dst_ip) AS dsts FROM qf_v GROUP BY 1)
JOIN qidx_v USING (bucket)
JOIN (SELECT bucket, count(*) AS peers FROM qip_v GROUP BY 1) USING (bucket)
LEFT JOIN (SELECT bucket, count(*) AS fresh FROM (SELECT ip, min(bucket) AS bucket FROM qip_v GROUP BY 1) GROUP BY 1) USING (bucket)
JOIN (SELECT bucket, -sum(p * log2(p)) AS pe FROM (SELECT bucket, c / sum(c) OVER (PARTITION BY bucket) AS p FROM (SELECT bucket, dst_port, count(*) AS c FROM qf_v GROUP BY 1, 2)) GROUP BY 1) USING (bucket)
JOIN (SELECT bucket, -sum(p * log2(p)) AS pre FROM (SELECT bucket, c / sum(c) OVER (PARTITION BY bucket) AS p FROM (SELECT bucket, protocol, count(*) AS c FROM qf_v GROUP BY 1, 2)) GROUP BY 1) USING (bucket)
JOIN (SELECT bucket, (2 * sum(i * x) - (max(n) + 1) * sum(x)) / (max(n) * sum(x) + 1e-9) AS gini FROM (
 SELECT bucket, CAST(fwd_bytes + rev_bytes AS DOUBLE) AS x, row_number() OVER (PARTITION BY bucket ORDER BY fwd_bytes + rev_bytes) AS i, count(*) OVER (PARTITION BY bucket) AS n FROM qf_v) GROUP BY 1) USING (bucket)
JOIN (SELECT e.bucket, count(*) AS edges, count(p.bucket) AS kept FROM qe_v e JOIN qidx_v i ON e.bucket = i.bucket LEFT JOIN (SELECT q.*, idx FROM qe_v q JOIN qidx_v USING (bucket)) p
  ON p.idx = i.idx - 1 AND p.src_ip = e.src_ip AND p.dst_ip = e.dst_ip AND p.dst_port = e.dst_port GROUP BY 1) USING (bucket)
LEFT JOIN (SELECT j.bucket, count(*) AS pedges FROM qe_v e JOIN qidx_v i ON e.bucket = i.bucket JOIN qidx_v j ON j.idx = i.idx + 1 GROUP BY 1) USING (bucket)""")
VEC = ("peer_diversity", "new_peer_rate", "dest_diversity", "src_diversity", "port_entropy", "protocol_entropy", "fan_in_ratio",
       "fan_out_ratio", "traffic_concentration_gini", "edge_churn_rate", "connection_churn_rate")


@query("beh13_behavioural_vector", "SELECT bucket, flow_count, node_count, edge_count, " + ", ".join(f"round({v}, 5) AS {v}" for v in VEC) + """,
 round(least(5.0, new_peer_rate * 2 + edge_churn_rate * 1.5 + port_entropy / 8), 5) AS behavioral_novelty_score FROM bvec_v""")
def beh13(spark, d):
    v = bh.behavioural_vector(base.flows(spark, d), QUARTER)
    return v.withColumns({n: r(F.col(n), 5) for n in (*VEC, "behavioral_novelty_score")})


@query("beh14_gini", """
SELECT src_ip, round((2 * sum(i * x) - (max(n) + 1) * sum(x)) / (max(n) * sum(x) + 1e-9), 6) AS gini FROM (
 SELECT src_ip, CAST(fwd_bytes AS DOUBLE) AS x, row_number() OVER (PARTITION BY src_ip ORDER BY fwd_bytes) AS i, count(*) OVER (PARTITION BY src_ip) AS n FROM flows_v) GROUP BY 1""")
def beh14(spark, d):
    return group_gini(base.flows(spark, d), ["src_ip"], "fwd_bytes").withColumn("gini", r(F.col("gini")))


@query("beh15_entropy_counts", """
SELECT src_ip, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT src_ip, c / sum(c) OVER (PARTITION BY src_ip) AS p FROM (SELECT src_ip, dst_ip, count(*) AS c FROM flows_v GROUP BY 1, 2)) GROUP BY 1""")
def beh15(spark, d):
    return group_entropy(base.flows(spark, d), ["src_ip"], "dst_ip").withColumn("entropy", r(F.col("entropy")))


cte("fan_v", """
SELECT coalesce(o.bucket, i.bucket) AS bucket, coalesce(o.e, i.e) AS entity, coalesce(out_peers, 0) AS o, coalesce(in_peers, 0) AS i, coalesce(ports, 0) AS p FROM (
 SELECT bucket, src_ip AS e, count(DISTINCT dst_ip) AS out_peers, count(DISTINCT dst_port) AS ports FROM qf_v GROUP BY 1, 2) o
 FULL JOIN (SELECT bucket, dst_ip AS e, count(DISTINCT src_ip) AS in_peers FROM qf_v GROUP BY 1, 2) i ON o.bucket = i.bucket AND o.e = i.e""")


@query("beh16_risk_indicators", """
WITH x AS (
 SELECT bucket, entity, 'ABNORMAL_OUTBOUND_FANOUT' AS indicator_type, CAST(o AS DOUBLE) AS value, CASE WHEN o >= 50 THEN 'CRITICAL' WHEN o >= 25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, least(0.95, 0.5 + o / 100.0) AS confidence FROM fan_v WHERE o >= 15 UNION ALL
 SELECT bucket, entity, 'ABNORMAL_INBOUND_FANIN', i, CASE WHEN i >= 40 THEN 'HIGH' ELSE 'MEDIUM' END, least(0.92, 0.6 + i / 100.0) FROM fan_v WHERE i >= 20 UNION ALL
 SELECT bucket, entity, 'UNUSUAL_SERVICE_EXPOSURE_PROBING', p, CASE WHEN p >= 20 THEN 'HIGH' ELSE 'MEDIUM' END, least(0.95, 0.6 + p / 50.0) FROM fan_v WHERE p >= 8 UNION ALL
 SELECT bucket, 'network', 'RAPID_PEER_EXPANSION', new_peer_rate, CASE WHEN new_peer_rate > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END, least(0.90, 0.5 + new_peer_rate * 0.4) FROM bvec_v WHERE new_peer_rate > 0.4 AND node_count >= 5 UNION ALL
 SELECT bucket, 'network', 'HIGH_COMMUNICATION_CHURN', edge_churn_rate, 'MEDIUM', least(0.88, 0.5 + edge_churn_rate * 0.4) FROM bvec_v WHERE edge_churn_rate > 0.6 AND edge_count >= 10 UNION ALL
 SELECT bucket, 'network', 'ABNORMAL_TRAFFIC_CONCENTRATION', traffic_concentration_gini, 'MEDIUM', 0.8 FROM bvec_v WHERE traffic_concentration_gini > 0.85)
SELECT bucket, entity, indicator_type, round(value, 5) AS value, severity, round(confidence, 5) AS confidence,
 count(*) OVER (PARTITION BY indicator_type, entity ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS persistence FROM x""")
def beh16(spark, d):
    f = base.flows(spark, d)
    out = bh.risk_indicators(bh.host_fans(f, QUARTER), bh.behavioural_vector(f, QUARTER))
    return out.withColumns({"value": r(F.col("value"), 5), "confidence": r(F.col("confidence"), 5)})


@query("beh17_session_flow_evidence", """
SELECT 'flow-sweep' AS evidence_id, 'ANOMALY' AS modality, CASE WHEN s < 0.85 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, round(least(1, s), 2) AS confidence, 'T1046' AS technique
FROM (SELECT count(*) AS n, round(count(*) FILTER (WHERE total_packets = 1) / count(*), 4) AS s FROM (SELECT count(*) AS total_packets FROM packets_v GROUP BY src_ip, src_port, dst_ip, dst_port, protocol))
WHERE n >= 20 AND s >= 0.6""")
def beh17(spark, d):
    from packetloom.plans.d_clean_flows import packets_bi
    f = fl.flow_summary(fl.flow_profile(fl.build_flows(base.packets(spark, d))))
    s = fl.session_metrics(fl.track_tcp_sessions(packets_bi(spark, d)))
    return bh.flow_evidence(f).unionByName(bh.session_evidence(s)).select(
        "evidence_id", "modality", "severity", r(F.col("confidence"), 2).alias("confidence"), "technique")


@query("beh18_signature_evidence", """
SELECT CASE severity WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity, technique, count(*) AS alerts FROM alerts_v GROUP BY 1, 2""")
def beh18(spark, d):
    return bh.signature_evidence(base.views.alerts(spark, d)).groupBy("severity", "technique").agg(F.count("*").alias("alerts"))


def evidence(spark, d):
    return (bh.finding_evidence(base.findings(spark, d)).unionByName(bh.beacon_evidence(beacons(spark, d)))
            .unionByName(bh.signature_evidence(base.views.alerts(spark, d))))


cte("evid_v", """
SELECT finding_id AS evidence_id, 'ANOMALY' AS modality, upper(severity) AS severity, CASE WHEN attack_category = 'network_reconnaissance' THEN 'T1046' ELSE 'T1498' END AS technique FROM findings_v UNION ALL
SELECT 'b', 'BEHAVIOR', CASE WHEN score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END, 'T1071' FROM beacon_v WHERE is_beaconing UNION ALL
SELECT 's', 'SIGNATURE', CASE severity WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END, technique FROM alerts_v""")


@query("beh19_threat_fusion", """
SELECT count(*) AS evidence_count, count(DISTINCT modality) AS observed_modalities, string_agg(DISTINCT technique, ',' ORDER BY technique) AS observed_techniques, '' AS forecast_techniques,
 CASE WHEN bool_or(severity IN ('HIGH', 'CRITICAL')) THEN 'HIGH' WHEN bool_or(severity = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS current_risk, 'UNKNOWN' AS future_risk,
 CASE WHEN bool_or(technique = 'T1046') THEN 'Reconnaissance / Initial Access' WHEN bool_or(technique = 'T1071') THEN 'Command & Control' ELSE 'Benign Observation' END AS attack_stage FROM evid_v""")
def beh19(spark, d):
    return bh.fuse_threat(evidence(spark, d))


cte("items_v", """
SELECT src_ip || '/' || technique AS hypothesis, 'S' || severity AS source, CASE WHEN dst_port < 70 THEN 'SUPPORTING' WHEN dst_port < 80 THEN 'CONTRADICTORY' ELSE 'NEUTRAL' END AS polarity,
 0.5 + dst_port / 250.0 AS confidence FROM alerts_v""")


def items(spark, d):
    a = base.views.alerts(spark, d)
    p = F.col("dst_port")
    return a.select(F.concat("src_ip", F.lit("/"), "technique").alias("hypothesis"), F.concat(F.lit("S"), "severity").alias("source"),
                    F.when(p < 70, "SUPPORTING").when(p < 80, "CONTRADICTORY").otherwise("NEUTRAL").alias("polarity"),
                    (0.5 + p / 250.0).alias("confidence"))


cte("agree_v", """
SELECT *, CASE WHEN c > 0 THEN 'CONFLICTING' WHEN s >= 2 THEN 'STRONG' WHEN s = 1 AND n > 0 THEN 'MIXED' WHEN s = 1 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS level,
 CASE WHEN s > 0 AND c > 0 THEN 0.45 WHEN s >= 2 THEN 1.15 WHEN s = 1 AND n > 0 THEN 0.95 WHEN s = 1 THEN 1.0 WHEN c > 0 THEN 0.3 ELSE 0.6 END AS modifier FROM (
 SELECT hypothesis, count(*) FILTER (WHERE sp) AS s, count(*) FILTER (WHERE cp) AS c, count(*) FILTER (WHERE NOT sp AND NOT cp) AS n FROM (
  SELECT hypothesis, source, bool_or(polarity = 'SUPPORTING') AS sp, bool_or(polarity = 'CONTRADICTORY') AS cp FROM items_v GROUP BY 1, 2) GROUP BY 1)""")


@query("beh20_sensor_agreement", """
SELECT hypothesis, s AS supporting_sources, c AS contradicting_sources, n AS neutral_sources, level AS agreement_level, round(modifier, 2) AS confidence_modifier FROM agree_v""")
def beh20(spark, d):
    return bh.sensor_agreement(items(spark, d), "hypothesis").withColumn("confidence_modifier", r(F.col("confidence_modifier"), 2))


@query("beh21_evidence_fuse", """
SELECT hypothesis, sc AS supporting_count, cc AS contradictory_count, nc AS neutral_count, sd AS source_diversity, level AS agreement_level,
 round(CASE WHEN sc > 0 THEN least(1, greatest(0, CASE WHEN cc > 0 THEN greatest(0.1, a * modifier - least(0.4, 0.15 * cc)) ELSE a * modifier END)) WHEN cc > 0 THEN 0.2 ELSE 0.5 END, 4) AS confidence
FROM (SELECT hypothesis, count(*) FILTER (WHERE polarity = 'SUPPORTING') AS sc, count(*) FILTER (WHERE polarity = 'CONTRADICTORY') AS cc, count(*) FILTER (WHERE polarity = 'NEUTRAL') AS nc,
 count(DISTINCT source) AS sd, CAST(avg(confidence) FILTER (WHERE polarity = 'SUPPORTING') AS DOUBLE) AS a FROM items_v GROUP BY 1) JOIN agree_v USING (hypothesis)""")
def beh21(spark, d):
    return bh.fuse_evidence(items(spark, d), "hypothesis")


@query("flw10_session_tagging", """
WITH b AS (SELECT DISTINCT src_ip, dst_ip, dst_port FROM beacon_v WHERE is_beaconing)
SELECT f.src_ip, f.dst_ip, f.dst_port, f.start_ts, f.fwd_bytes,
 rtrim(CASE WHEN b.src_ip IS NOT NULL THEN 'PERIODIC_BEACONING,' ELSE '' END || CASE WHEN end_ts - start_ts >= 300 THEN 'LONG_LIVED_SESSION,' ELSE '' END
  || CASE WHEN protocol = 'TCP' AND state = 'ATTEMPTED' THEN 'UNACKNOWLEDGED_SYN,' ELSE '' END, ',') AS behavioral_tags,
 CASE WHEN b.src_ip IS NOT NULL THEN 'HIGH' WHEN end_ts - start_ts >= 300 OR (protocol = 'TCP' AND state = 'ATTEMPTED') THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM flows_v f LEFT JOIN b ON f.src_ip = b.src_ip AND f.dst_ip = b.dst_ip AND f.dst_port = b.dst_port""")
def flw10(spark, d):
    f = base.flows(spark, d)
    g = f.withColumns({"syn_count": (F.col("state") == "ATTEMPTED").cast("int"), "ack_count": F.lit(0)})
    return fl.session_tags(g, bh.beaconing(f)).select(
        "src_ip", "dst_ip", "dst_port", "start_ts", "fwd_bytes", F.array_join("behavioral_tags", ",").alias("behavioral_tags"), "risk_level")
