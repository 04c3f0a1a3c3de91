"""Packet-window queries: WIN1-7, WIN17, WIN18, WIN23 and the first detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.columns import r
from packetloom.functions.quantiles import group_quantiles
from packetloom.operators import windows as win
from packetloom.plans import base
from packetloom.plans.a_views import W
from packetloom.plans.registry import query


@query("win1_tumbling_bucket", f"""
SELECT bucket, count(*) AS packet_count, bucket * {W} AS window_start, (bucket + 1) * {W} AS window_end,
  min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT ts, CAST(floor(ts / {W}) AS BIGINT) AS bucket FROM packets_v) GROUP BY bucket""")
def win1(spark, d):
    return win.tumbling_windows(base.packets(spark, d), W).drop("capture_id")


@query("win2_flow_spans_buckets", """
SELECT bucket, count(*) AS flow_count, CAST(sum(fwd_bytes) AS BIGINT) AS fwd_bytes FROM (
  SELECT unnest(range(CAST(floor(start_ts / 86400) AS BIGINT), CAST(floor(end_ts / 86400) AS BIGINT) + 1)) AS bucket, fwd_bytes
  FROM flows_v) WHERE bucket IN (SELECT CAST(floor(start_ts / 86400) AS BIGINT) FROM flows_v) GROUP BY 1""")
def win2(spark, d):
    f = base.flows(spark, d).select("start_ts", "end_ts", "fwd_bytes")
    occupied = f.select(F.floor(F.col("start_ts") / 86400).cast("bigint").alias("bucket"))
    return win.flow_window_totals(f, 86400, occupied, {"flow_count": F.lit(1), "fwd_bytes": F.col("fwd_bytes")})


STAT3 = ("ttl_variance", "tcp_window_variance", "packet_size_variance", "payload_variance", "iat_variance", "tcp_window_mean",
         "iat_mean", "iat_min", "iat_max", "iat_median", "iat_p95", "ttl_mean", "packet_size_mean", "payload_mean",
         "packet_size_median", "packet_size_p95", "payload_median", "payload_p95", "mean_tcp_payload_size",
         "payload_rate_bytes_sec", "payload_zero_ratio", "fragment_ratio", "udp_packet_ratio", "icmp_packet_ratio",
         "tcp_retransmission_rate", "port_scan_score")
PLAIN = ("bucket", "packet_count", "ttl_min", "ttl_max", "tcp_window_min", "tcp_window_max", "packet_size_min",
         "packet_size_max", "max_tcp_payload_size", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count",
         "urg_count", "cwr_count", "ece_count", "syn_attempts", "responses", "fragment_count", "tcp_count", "udp_count",
         "icmp_count", "tcp_window_zero_count", "tcp_with_payload", "tcp_retransmission_count", "unique_src_ips",
         "unique_dst_ips", "unique_dst_ports", "packet_rate_peak", "window_start", "window_end")


@query("win3_packet_window_stats", "SELECT " + ", ".join(PLAIN) + ", " + ", ".join(
    f"round({n}, 3) AS {n}" for n in STAT3) + " FROM win_stats")
def win3(spark, d):
    return base.stats(spark, d).select(*PLAIN, *[r(F.col(n), 3).alias(n) for n in STAT3])


@query("win3_protocol_counts", f"""
SELECT bucket, string_agg(protocol || ':' || n, ',' ORDER BY protocol) AS protocol_counts FROM (
  SELECT CAST(floor(ts / {W}) AS BIGINT) AS bucket, protocol, count(*) AS n FROM packets_v GROUP BY 1, 2) GROUP BY 1""")
def win3_protocols(spark, d):
    m = win.protocol_counts(base.packets(spark, d), W)
    text = F.array_join(F.transform(F.map_entries("protocol_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return m.select("bucket", text.alias("protocol_counts"))


@query("win4_port_scan_score", "SELECT bucket, round(port_scan_score, 6) AS port_scan_score FROM win_stats")
def win4(spark, d):
    return base.scan_stats(spark, d).select("bucket", r(F.col("port_scan_score")).alias("port_scan_score"))


@query("win5_adjusted_skewness", """
SELECT bucket, round(CASE WHEN n < 3 OR m2 < 1e-12 THEN 0.0 ELSE sqrt(n * (n - 1.0)) / (n - 2) * m3 / pow(m2, 1.5) END, 5)
  AS packet_size_skewness
FROM (SELECT bucket, count(*) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3 FROM (
  SELECT bucket, CAST(packet_length AS DOUBLE) AS x, avg(packet_length) OVER (PARTITION BY bucket) AS mu FROM iat_v) GROUP BY 1)""")
def win5(spark, d):
    rows = win.with_bucket(base.packets(spark, d), W)
    return rows.groupBy("bucket").agg(
        r(win.adjusted_skewness(F.col("packet_length").cast("double")), 5).alias("packet_size_skewness"))


@query("win6_packet_rate_peak", "SELECT bucket, packet_rate_peak FROM peak_v")
def win6(spark, d):
    return win.packet_rate_peak(base.packets(spark, d), W).select("bucket", "packet_rate_peak")


@query("win7_payload_rate", "SELECT bucket, round(payload_rate_bytes_sec, 5) AS payload_rate FROM win_stats")
def win7(spark, d):
    span = F.max("ts") - F.min("ts")
    return win.with_bucket(base.packets(spark, d), W).groupBy("bucket").agg(
        r(F.sum("payload_length") / F.when(span > 0, span).otherwise(60.0), 5).alias("payload_rate"))


@query("win17_traffic_summary", "SELECT count(*) AS windows, " + ", ".join(
    f"CAST(sum({n}) AS BIGINT) AS {n}" for n in (
        "packet_count", "tcp_count", "udp_count", "icmp_count", "syn_count", "ack_count", "fin_count", "rst_count",
        "psh_count", "urg_count", "fragment_count", "tcp_retransmission_count")) + " FROM win_stats")
def win17(spark, d):
    rows = win.with_bucket(base.packets_marked(spark, d), W)
    return win.traffic_summary(win.base_stats(rows, with_iat=False)).drop("capture_id")


@query("win17_protocol_totals", "SELECT protocol, count(*) AS packets FROM packets_v GROUP BY 1")
def win17_protocols(spark, d):
    return win.merged_protocols(win.protocol_counts(base.packets(spark, d), W)).drop("capture_id")


@query("win18_flow_packet_alignment", f"""
WITH a AS (SELECT DISTINCT CAST(floor(ts / {W}) AS BIGINT) % 1000 AS bucket FROM packets_v WHERE protocol = 'TCP'),
b AS (SELECT DISTINCT CAST(floor(ts / {W}) AS BIGINT) % 1000 AS bucket FROM packets_v WHERE protocol = 'ICMP')
SELECT count(a.bucket) AS total_flow_windows, count(b.bucket) AS total_packet_windows,
  count(*) FILTER (WHERE a.bucket IS NOT NULL AND b.bucket IS NOT NULL) AS matched_windows,
  count(*) FILTER (WHERE b.bucket IS NULL) AS unmatched_flow_windows,
  count(*) FILTER (WHERE a.bucket IS NULL) AS unmatched_packet_windows,
  count(*) FILTER (WHERE a.bucket IS NOT NULL AND b.bucket IS NOT NULL) / greatest(count(*), 1) AS alignment_coverage,
  count(*) FILTER (WHERE a.bucket IS NOT NULL AND b.bucket IS NOT NULL) / greatest(count(a.bucket), 1) AS match_rate_by_window
FROM a FULL JOIN b ON a.bucket = b.bucket""")
def win18(spark, d):
    p = base.packets(spark, d).withColumn("bucket", F.floor(F.col("ts") / W) % 1000)
    return win.align_windows(p.filter("protocol = 'TCP'"), p.filter("protocol = 'ICMP'"))


@query("win23_percentile_linear", """
SELECT src_ip, round(quantile_cont(packet_length, 0.25), 6) AS p25, round(quantile_cont(packet_length, 0.9), 6) AS p90
FROM packets_v GROUP BY 1""")
def win23(spark, d):
    q = group_quantiles(base.packets(spark, d), ["src_ip"], "packet_length", {"p25": 0.25, "p90": 0.9})
    return q.select("src_ip", r(F.col("p25")).alias("p25"), r(F.col("p90")).alias("p90"))


RULES = """rtrim(CASE WHEN scan >= 0.5 THEN 'PORT_SCAN_SCORE_HIGH,' ELSE '' END
  || CASE WHEN retr >= 0.5 THEN 'TCP_RETRANSMISSION_RATE_HIGH,' ELSE '' END
  || CASE WHEN frag >= 0.5 THEN 'FRAGMENTATION_RATIO_HIGH,' ELSE '' END
  || CASE WHEN synp >= 0.5 THEN 'SYN_PRESSURE_HIGH,' ELSE '' END, ',')"""


@query("beh1_heuristic_window_risk", f"""
SELECT bucket, window_start, packet_count, risk_score,
  CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS severity, {RULES} AS rules
FROM risk_v""")
def beh1(spark, d):
    return base.risk(spark, d).select(
        "bucket", "window_start", "packet_count", "risk_score", "severity",
        F.array_join(F.transform("evidence", lambda e: e["rule_id"]), ",").alias("rules"))


@query("beh2_findings", "SELECT bucket, finding_id, risk_score, severity, attack_category, src_ip FROM findings_v")
def beh2(spark, d):
    return base.findings(spark, d).select("bucket", "finding_id", "risk_score", "severity", "attack_category", "src_ip")


@query("beh2_detection_summary", """
SELECT count(*) AS windows_analyzed, count(*) FILTER (WHERE scan >= 0.5 OR retr >= 0.5 OR frag >= 0.5 OR synp >= 0.5)
  AS detected_events, round(max(risk_score), 2) AS risk_score, round(avg(risk_score), 2) AS average_window_risk,
  CASE WHEN max(risk_score) >= 60 THEN 'high' WHEN max(risk_score) >= 25 THEN 'medium' ELSE 'low' END AS threat_level
FROM risk_v""")
def beh2_summary(spark, d):
    return win.detection_summary(base.risk(spark, d)).drop("capture_id")


@query("snk2_findings_explode", """
SELECT bucket, finding_id, severity, CASE WHEN scan >= 0.5 THEN 'PORT_SCAN_SCORE_HIGH'
  WHEN retr >= 0.5 THEN 'TCP_RETRANSMISSION_RATE_HIGH' WHEN frag >= 0.5 THEN 'FRAGMENTATION_RATIO_HIGH' ELSE 'SYN_PRESSURE_HIGH' END AS rule_id,
  round(CASE WHEN scan >= 0.5 THEN scan WHEN retr >= 0.5 THEN tcp_retransmission_rate WHEN frag >= 0.5 THEN fragment_ratio
   ELSE CAST(syn_count AS DOUBLE) END, 6) AS value,
  round(CASE WHEN scan >= 0.5 THEN 0.5::DOUBLE WHEN retr >= 0.5 THEN 0.05::DOUBLE WHEN frag >= 0.5 THEN 0.025::DOUBLE
   ELSE packet_count * 0.5::DOUBLE END, 6) AS threshold
FROM risk_v JOIN (SELECT bucket, finding_id, severity FROM findings_v) USING (bucket)""")
def snk2(spark, d):
    from packetloom.sinks.store import finding_values
    return finding_values(base.findings(spark, d)).select("bucket", "finding_id", "severity", "rule_id",
                                                          r(F.col("value")).alias("value"), r(F.col("threshold")).alias("threshold"))
