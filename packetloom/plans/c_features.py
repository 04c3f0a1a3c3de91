"""Flow-derived window features: WIN8-WIN16 and WIN19-WIN22."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.columns import r
from packetloom.operators import features as ft, windows as win
from packetloom.plans import base
from packetloom.plans.a_views import DAY, W
from packetloom.plans.registry import cte, query

SIX_H = 6 * 3600  # window of the long-lived packet flows

# running totals of each packet flow, one row per (flow, window): the plain form of the definition
cte("pflow_part", f"""
SELECT src_ip, src_port, dst_ip, dst_port, protocol, CAST(floor(ts / {SIX_H}) AS BIGINT) AS bucket,
  count(*) AS n, sum(packet_length) AS b, sum(payload_length) AS pay, min(ts) AS t0, max(ts) AS t1, sum(ttl) AS ttl,
  sum(tcp_window) AS winsum, count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS syn,
  count(*) FILTER (WHERE tcp_flags & 16 <> 0) AS ack, count(*) FILTER (WHERE tcp_flags & 4 <> 0) AS rst
FROM packets_v GROUP BY ALL""")
cte("pflow_all", """
SELECT src_ip, src_port, dst_ip, dst_port, protocol, min(bucket) AS b0, max(bucket) AS b1, min(t0) AS start_ts,
  sum(syn) AS syn, sum(ack) AS ack, sum(rst) AS rst FROM pflow_part GROUP BY ALL""")
cte("pflow_grid", """
SELECT a.*, o.bucket FROM pflow_all a JOIN (SELECT DISTINCT bucket FROM pflow_part) o ON o.bucket BETWEEN a.b0 AND a.b1""")
cte("pflow_prefix", """
SELECT g.src_ip, g.src_port, g.dst_ip, g.dst_port, g.protocol, g.bucket, g.start_ts, g.syn, g.ack, g.rst,
  sum(p.n) OVER w AS n, sum(p.b) OVER w AS b, sum(p.pay) OVER w AS pay, max(p.t1) OVER w - g.start_ts AS duration,
  sum(p.ttl) OVER w / sum(p.n) OVER w AS sttl, sum(p.winsum) OVER w / sum(p.n) OVER w AS swin
FROM pflow_grid g LEFT JOIN pflow_part p USING (src_ip, src_port, dst_ip, dst_port, protocol, bucket)
WINDOW w AS (PARTITION BY g.src_ip, g.src_port, g.dst_ip, g.dst_port, g.protocol ORDER BY g.bucket
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("pflow_ports", """
SELECT bucket, -sum(p * log2(p)) AS h FROM (SELECT bucket, c / sum(c) OVER (PARTITION BY bucket) AS p FROM (
  SELECT bucket, dst_port, count(*) AS c FROM pflow_grid GROUP BY 1, 2)) GROUP BY 1""")
cte("flow_state", f"""
SELECT bucket, CAST(count(*) AS DOUBLE) AS flow_count, CAST(sum(b) AS DOUBLE) AS total_src_bytes, 0.0::DOUBLE AS total_dst_bytes,
  CAST(sum(n) AS DOUBLE) AS total_packets, avg(duration) AS mean_duration, avg(b) AS mean_flow_bytes, avg(n) AS mean_flow_packets,
  avg(sttl) AS mean_sttl, avg(swin) AS mean_swin, avg(CASE WHEN n > 1 THEN duration / (n - 1) END) AS mean_iat,
  CAST(count(DISTINCT (src_ip, src_port)) AS DOUBLE) AS unique_src_ports,
  CAST(count(DISTINCT (dst_ip, dst_port)) AS DOUBLE) AS unique_dst_ports,
  CAST(count(*) FILTER (WHERE protocol = 'TCP') AS DOUBLE) AS proto_tcp_count,
  CAST(count(*) FILTER (WHERE protocol = 'UDP') AS DOUBLE) AS proto_udp_count,
  CAST(count(*) FILTER (WHERE protocol NOT IN ('TCP', 'UDP')) AS DOUBLE) AS proto_other_count,
  coalesce(var_samp(duration), 0) AS flow_duration_variance,
  count(*) FILTER (WHERE n = 1) / count(*) AS single_packet_flow_ratio, count(*) / {float(SIX_H)} AS active_flow_rate,
  CASE WHEN sum(ack) > 0 THEN sum(syn) / sum(ack) ELSE 0 END AS tcp_syn_ack_ratio,
  CASE WHEN sum(ack) > 0 THEN sum(rst) / sum(ack) ELSE 0 END AS tcp_rst_ack_ratio,
  count(*) FILTER (WHERE protocol = 'UDP') / count(*) AS udp_flow_ratio, avg(pay) AS mean_payload_bytes
FROM pflow_prefix GROUP BY 1""")


def state(spark, d):
    p = base.packets_marked(spark, d)
    return ft.flow_window_features(p, base.fl.build_flows(p), SIX_H)



@query("win8_flow_prefix_state", """
SELECT src_ip, dst_ip, dst_port, protocol, bucket, CAST(b AS BIGINT) AS src_bytes, CAST(n AS BIGINT) AS total_packets,
  round(duration, 3) AS duration, round(sttl, 4) AS sttl FROM pflow_prefix
WHERE (src_ip, src_port, dst_ip, dst_port, protocol, bucket) IN (SELECT (src_ip, src_port, dst_ip, dst_port, protocol, bucket) FROM pflow_part)""")
def win8(spark, d):
    return ft.flow_prefix_points(base.packets(spark, d), SIX_H).select(
        "src_ip", "dst_ip", "dst_port", "protocol", "bucket", "src_bytes", "total_packets",
        r(F.col("duration"), 3).alias("duration"), r(F.col("sttl"), 4).alias("sttl"))


BASE9 = ("flow_count", "total_src_bytes", "total_dst_bytes", "total_packets", "unique_src_ports", "unique_dst_ports",
         "proto_tcp_count", "proto_udp_count", "proto_other_count")
MEAN9 = ("mean_duration", "mean_flow_bytes", "mean_flow_packets", "mean_sttl", "mean_swin", "mean_iat")


@query("win9_flow_window_features", "SELECT bucket, " + ", ".join(BASE9) + ", " + ", ".join(
    f"round({n}, 2) AS {n}" for n in MEAN9) + " FROM flow_state")
def win9(spark, d):
    return state(spark, d).select("bucket", *BASE9, *[r(F.col(n), 2).alias(n) for n in MEAN9])


EXT10 = ("single_packet_flow_ratio", "active_flow_rate", "tcp_syn_ack_ratio", "tcp_rst_ack_ratio", "udp_flow_ratio",
         "mean_payload_bytes", "port_entropy")


@query("win10_flow_extended_13", "SELECT bucket, round(flow_duration_variance / 1e6::DOUBLE, 1) AS flow_duration_variance, " + ", ".join(
    f"round({'h' if n == 'port_entropy' else n}, 4) AS {n}" for n in EXT10) + """,
  total_src_bytes AS fwd_total FROM flow_state JOIN pflow_ports USING (bucket)""")
def win10(spark, d):
    return state(spark, d).select("bucket", r(F.col("flow_duration_variance") / 1e6, 1).alias("flow_duration_variance"),
                                  *[r(F.col(n), 4).alias(n) for n in EXT10], F.col("total_src_bytes").alias("fwd_total"))


@query("win10_flow_start_gaps", f"""
SELECT bucket, round(coalesce(var_samp(g), 0) / 1e6::DOUBLE, 2) AS flow_iat_variance, coalesce(max(g), 0) AS flow_iat_max,
  coalesce(min(g), 0) AS flow_iat_min FROM (
  SELECT bucket, start_ts - lag(start_ts) OVER (PARTITION BY bucket ORDER BY start_ts) AS g FROM (
    SELECT unnest(range(CAST(floor(start_ts / {DAY}) AS BIGINT), CAST(floor(end_ts / {DAY}) AS BIGINT) + 1)) AS bucket, start_ts
    FROM flows_v)) GROUP BY 1""")
def win10_gaps(spark, d):
    f = base.flows(spark, d)
    rows = win.flow_buckets(f, DAY).select(F.lit("c0").alias("capture_id"), "bucket", "start_ts",
                                           F.xxhash64(*f.columns).alias("rid"))
    return ft.flow_start_gaps(rows, DAY).select(
        "bucket", r(F.col("flow_iat_variance") / 1e6, 2).alias("flow_iat_variance"), "flow_iat_max", "flow_iat_min")


D11 = ("delta_flow_count", "delta_total_bytes", "delta_total_packets", "delta_ports", "delta_src_bytes", "delta_dst_bytes")


@query("win11_temporal_deltas", """
SELECT bucket, flow_count - lag(flow_count) OVER w AS delta_flow_count,
  total_src_bytes - lag(total_src_bytes) OVER w AS delta_total_bytes, total_packets - lag(total_packets) OVER w AS delta_total_packets,
  unique_src_ports + unique_dst_ports - lag(unique_src_ports + unique_dst_ports) OVER w AS delta_ports,
  total_src_bytes - lag(total_src_bytes) OVER w AS delta_src_bytes, total_dst_bytes - lag(total_dst_bytes) OVER w AS delta_dst_bytes,
  round(mean_iat - lag(mean_iat) OVER w, 2) AS delta_iat
FROM flow_state WINDOW w AS (ORDER BY bucket)""")
def win11(spark, d):
    return ft.temporal_deltas(state(spark, d)).select("bucket", *D11, r(F.col("delta_iat"), 2).alias("delta_iat"))


@query("win12_rolling_4", """
SELECT bucket, round(CASE WHEN row_number() OVER (ORDER BY bucket) > 1 THEN avg(total_src_bytes) OVER w END, 4) AS rolling_total_bytes,
  round(CASE WHEN row_number() OVER (ORDER BY bucket) > 1 THEN avg(flow_count) OVER w END, 4) AS rolling_flow_rate
FROM flow_state WINDOW w AS (ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def win12(spark, d):
    return ft.temporal_deltas(state(spark, d)).select(
        "bucket", r(F.col("rolling_total_bytes"), 4).alias("rolling_total_bytes"),
        r(F.col("rolling_flow_rate"), 4).alias("rolling_flow_rate"))


@query("win13_flow_lifecycle", """
WITH g AS (SELECT bucket, count(*) AS active_flows, count(*) FILTER (WHERE b0 = bucket) AS new_flows,
  count(*) FILTER (WHERE b1 = bucket) AS last FROM pflow_grid GROUP BY 1)
SELECT bucket, active_flows, new_flows, coalesce(lag(last) OVER (ORDER BY bucket), 0) AS ended_flows FROM g""")
def win13(spark, d):
    p = base.packets(spark, d)
    occ = win.with_bucket(p, SIX_H).select("capture_id", "bucket").distinct()
    return ft.flow_lifecycle(base.fl.build_flows(p), occ, SIX_H).drop("capture_id")


cte("day_state", f"""
SELECT CAST(floor(start_ts / {DAY}) AS BIGINT) AS bucket, count(*) AS flow_count, CAST(sum(fwd_bytes) AS BIGINT) AS total_src_bytes,
  CAST(sum(rev_bytes) AS BIGINT) AS total_dst_bytes, CAST(sum(fwd_packets + rev_packets) AS BIGINT) AS total_packets,
  avg(end_ts - start_ts) AS mean_duration, avg(fwd_bytes + rev_bytes) AS mean_flow_bytes,
  avg(fwd_packets + rev_packets) AS mean_flow_packets, count(DISTINCT dst_port) AS unique_dst_ports,
  count(*) FILTER (WHERE protocol = 'TCP') AS proto_tcp_count, count(*) FILTER (WHERE protocol = 'UDP') AS proto_udp_count,
  count(*) FILTER (WHERE protocol NOT IN ('TCP', 'UDP')) AS proto_other_count
FROM flows_v GROUP BY 1""")


@query("win14_csv_flow_window_state", """
SELECT bucket, flow_count, total_src_bytes, total_dst_bytes, total_packets, round(mean_duration, 3) AS mean_duration,
  round(mean_flow_bytes, 3) AS mean_flow_bytes, round(mean_flow_packets, 3) AS mean_flow_packets, unique_dst_ports,
  proto_tcp_count, proto_udp_count, proto_other_count, flow_count - coalesce(lag(flow_count) OVER w, 0) AS delta_flow_count,
  total_src_bytes + total_dst_bytes - coalesce(lag(total_src_bytes + total_dst_bytes) OVER w, 0) AS delta_total_bytes,
  total_packets - coalesce(lag(total_packets) OVER w, 0) AS delta_total_packets,
  unique_dst_ports - coalesce(lag(unique_dst_ports) OVER w, 0) AS delta_ports,
  round(avg(total_src_bytes + total_dst_bytes) OVER (ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 3) AS rolling_total_bytes
FROM day_state WINDOW w AS (ORDER BY bucket)""")
def win14(spark, d):
    s = ft.per_window_flow_state(base.flows(spark, d), DAY)
    rounded = ("mean_duration", "mean_flow_bytes", "mean_flow_packets", "rolling_total_bytes")
    return s.withColumns({n: r(F.col(n), 3) for n in rounded})


def day_state(spark, d):
    s = ft.per_window_flow_state(base.flows(spark, d), DAY).withColumn("capture_id", F.lit("c0"))
    return s.drop(*[n for n in s.columns if n.startswith(("delta_", "rolling_"))])


@query("win15_velocity_vector", f"""
WITH s AS (SELECT *, CAST(total_src_bytes + total_dst_bytes AS DOUBLE) AS tb FROM day_state),
l AS (SELECT *, lag(tb) OVER (ORDER BY bucket) AS p1, lag(tb, 2) OVER (ORDER BY bucket) AS p2, row_number() OVER (ORDER BY bucket) AS rn,
  avg(tb) OVER (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ma8,
  avg(tb) OVER (ORDER BY bucket ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma4,
  avg(tb) OVER (ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ma2,
  stddev_pop(tb) OVER (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS sd8,
  CAST(flow_count - lag(flow_count) OVER (ORDER BY bucket) AS DOUBLE) AS df FROM s)
SELECT bucket, coalesce(df, 0) AS delta_flow_count, round(coalesce(tb - p1, 0), 2) AS delta_total_bytes,
  round(ma4, 2) AS rolling_total_bytes, round(coalesce((tb - p1) - (p1 - p2), 0), 2) AS acceleration_total_bytes,
  round(sd8, 1) AS rolling_volatility_bytes, 1.0::DOUBLE AS burstiness_index,
  round(abs(ma2 - ma8) / greatest(1.0, ma8 + 1.0), 6) AS regime_change_score FROM l""")
def win15(spark, d):
    v = ft.velocity_vector(day_state(spark, d), 8, DAY)
    return v.select("bucket", "delta_flow_count", r(F.col("delta_total_bytes"), 2).alias("delta_total_bytes"),
                    r(F.col("rolling_total_bytes"), 2).alias("rolling_total_bytes"),
                    r(F.col("acceleration_total_bytes"), 2).alias("acceleration_total_bytes"),
                    r(F.col("rolling_volatility_bytes"), 1).alias("rolling_volatility_bytes"),
                    r(F.col("burstiness_index")).alias("burstiness_index"),
                    r(F.col("regime_change_score")).alias("regime_change_score"))


@query("win16_causal_25", """
WITH s AS (SELECT *, row_number() OVER (ORDER BY bucket) AS rn, CAST(flow_count AS DOUBLE) AS f FROM day_state),
h AS (SELECT *, list(f) OVER w AS hist, avg(f) OVER w AS mf, stddev_pop(f) OVER w AS sf,
  avg(total_src_bytes) OVER w AS msb, stddev_pop(total_src_bytes) OVER w AS ssb, avg(total_dst_bytes) OVER w AS mdb,
  stddev_pop(total_dst_bytes) OVER w AS sdb, stddev_pop(total_src_bytes + total_dst_bytes) OVER w AS stb,
  coalesce(lag(f) OVER o, f) AS pf, coalesce(lag(f, 2) OVER o, lag(f) OVER o, f) AS pf2,
  lag(proto_tcp_count) OVER o AS ptcp, coalesce(lag(total_src_bytes) OVER o, total_src_bytes) AS psb,
  coalesce(lag(unique_dst_ports) OVER o, unique_dst_ports) AS pdp
  FROM s WINDOW w AS (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), o AS (ORDER BY bucket))
SELECT bucket, f - pf AS d_flows, CAST(total_src_bytes - psb AS DOUBLE) AS d_src_bytes, CAST(unique_dst_ports - pdp AS DOUBLE) AS d_ports,
  (f - pf) - (pf - pf2) AS accel_flows, round(mf, 5) AS mean_flows, round(sf, 5) AS std_flows, round(msb, 2) AS mean_src_bytes,
  round((sf - mf) / (sf + mf + 1e-5), 6) AS burstiness_flows,
  round((total_src_bytes - total_dst_bytes) / (total_src_bytes + total_dst_bytes + 1e-5), 6) AS asymmetry_bytes,
  round(unique_dst_ports / (f + 1e-5), 6) AS dst_port_concentration, round((f - mf) / (sf + 1e-5), 5) AS zscore_flows,
  round((total_src_bytes + total_dst_bytes - msb - mdb) / (stb + 1e-5), 5) AS zscore_bytes,
  round(list_reduce(hist, lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a)
    - list_reduce(hist, lambda a, x: 0.15::DOUBLE * x + 0.85::DOUBLE * a), 5) AS ewma_difference,
  round(proto_tcp_count / (f + 1e-5) - coalesce(ptcp / (pf + 1e-5), proto_tcp_count / (f + 1e-5)), 6) AS proto_mix_delta,
  round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(hist, lambda x: (x - mf) / (sf + 1e-5))),
    lambda a, z: greatest(0.0::DOUBLE, a + z - 0.5)), 4) AS cusum
FROM h""")
def win16(spark, d):
    s = day_state(spark, d).withColumns({n: F.lit(0) for n in ("syn_count", "ack_count", "rst_count", "fin_count",
                                                               "unique_src_ports")})
    c = ft.causal_features(s, 8)
    digits = {"mean_flows": 5, "std_flows": 5, "mean_src_bytes": 2, "burstiness_flows": 6, "asymmetry_bytes": 6,
              "dst_port_concentration": 6, "zscore_flows": 5, "zscore_bytes": 5, "ewma_difference": 5,
              "proto_mix_delta": 6, "cusum": 4}
    return c.select("bucket", "d_flows", "d_src_bytes", "d_ports", "accel_flows",
                    *[r(F.col(n), k).alias(n) for n, k in digits.items()])


@query("win19_window_state_counts", """
WITH w AS (SELECT l.bucket, attack_state, n, lag(attack_state) OVER (ORDER BY bucket) AS p
  FROM labels_h l JOIN (SELECT CAST(floor(ts / 3600) AS BIGINT) AS bucket, count(*) AS n FROM packets_v GROUP BY 1) USING (bucket)),
m AS (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM w) WHERE i = (SELECT count(*) FROM w) // 2)
SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS records, count(*) FILTER (WHERE attack_state = 1) AS attack_windows,
  count(*) FILTER (WHERE attack_state = 0) AS benign_windows, round(avg(n), 6) AS mean_records,
  CAST((SELECT n FROM m) AS DOUBLE) AS upper_median_records,
  count(*) FILTER (WHERE p = 0 AND attack_state = 0) AS n00, count(*) FILTER (WHERE p = 0 AND attack_state = 1) AS n01,
  count(*) FILTER (WHERE p = 1 AND attack_state = 0) AS n10, count(*) FILTER (WHERE p = 1 AND attack_state = 1) AS n11 FROM w""")
def win19(spark, d):
    n = win.with_bucket(base.packets(spark, d), W).groupBy("bucket").agg(F.count("*").alias("n"))
    out = ft.window_state_counts(base.views.labels(spark, d, W).join(n, "bucket"), "attack_state", "n")
    return out.withColumns({"mean_records": r(F.col("mean_records")),
                            "upper_median_records": F.col("upper_median_records").cast("double")})


F20 = ("flow_count", "total_src_bytes", "total_packets", "proto_tcp_count")
UNP = " UNION ALL ".join(f"SELECT bucket, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM day_state" for f in F20)


@query("win20_data_drift_delta", f"""
WITH u AS ({UNP}), b AS (SELECT *, avg(value) OVER (PARTITION BY feature ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline FROM u),
c AS (SELECT *, (value - baseline) / greatest(abs(baseline), 1.0) AS rel FROM b WHERE baseline IS NOT NULL
  AND (abs(value - baseline) / greatest(abs(baseline), 1.0) >= 0.1 OR abs(value - baseline) >= 1))
SELECT bucket, feature, value, round(baseline, 4) AS baseline, round(rel, 6) AS relative_change,
  CASE WHEN rel > 0.1 THEN 'INCREASE' WHEN rel < -0.1 THEN 'DECREASE' ELSE 'NEUTRAL' END AS direction,
  CASE WHEN abs(rel) >= 0.5 THEN 'HIGH' WHEN abs(rel) >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN rel > 0.1 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS effect FROM c""")
def win20(spark, d):
    return ft.drift_delta(day_state(spark, d), F20).select(
        "bucket", "feature", "value", r(F.col("baseline"), 4).alias("baseline"),
        r(F.col("relative_change")).alias("relative_change"), "direction", "severity", "effect")


@query("win21_feature_change_explain", f"""
WITH u AS ({UNP}), b AS (SELECT *, lag(value) OVER (PARTITION BY feature ORDER BY bucket) AS previous FROM u)
SELECT bucket, feature, value, round((value - previous) / nullif(abs(previous), 0), 6) AS relative_change,
  CASE WHEN previous IS NULL THEN 'INSUFFICIENT_BASELINE' WHEN previous = 0 AND value = 0 THEN 'STABLE'
    WHEN previous = 0 AND value > 0 THEN 'NEWLY_PRESENT' WHEN previous = 0 THEN 'DECREASED'
    WHEN abs((value - previous) / abs(previous)) <= 0.05 THEN 'STABLE' WHEN value > previous THEN 'INCREASED' ELSE 'DECREASED' END AS change
FROM b""")
def win21(spark, d):
    return ft.explain_change(day_state(spark, d), F20).select(
        "bucket", "feature", "value", r(F.col("relative_change")).alias("relative_change"), "change")


@query("win22_state_vector", """
SELECT bucket, CAST(packet_count AS DOUBLE) AS packet_count, round(packet_size_mean, 4) AS mean_packet_size,
  round(sqrt(packet_size_variance), 4) AS std_packet_size, round(sqrt(ttl_variance), 4) AS std_ttl,
  round(sqrt(tcp_window_variance), 3) AS std_tcp_window, round(sqrt(iat_variance), 4) AS std_iat, round(iat_max, 4) AS max_iat,
  22 AS width FROM win_stats WHERE iat_max IS NOT NULL""")
def win22(spark, d):
    s = ft.packet_state(base.stats(spark, d))
    names = [n for n in s.columns if n not in ("capture_id", "bucket")]
    v = ft.state_vector(s, names)
    at = lambda n, k: r(F.col("vector")[names.index(n)], k).alias(n)
    return v.select("bucket", F.col("vector")[names.index("packet_count")].alias("packet_count"), at("mean_packet_size", 4),
                    at("std_packet_size", 4), at("std_ttl", 4), at("std_tcp_window", 3), at("std_iat", 4), at("max_iat", 4),
                    F.size("vector").alias("width"))
