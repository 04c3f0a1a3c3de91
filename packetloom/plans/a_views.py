"""SQL fragments for the telemetry views and the tables derived from them."""

from packetloom.plans.registry import cte

W = 3600          # window used for packet statistics, seconds
EP = 900          # window used for label episodes, seconds
DAY = 86400       # window used for flow tables, seconds

cte("packets_v", """
SELECT 'c0' AS capture_id, event_id AS packet_index, epoch_us(ts) / 1e6 AS ts,
  'u' || user_id AS src_ip, CAST(1024 + user_id % 7 AS INT) AS src_port, 'h' || (k % 20) AS dst_ip, k AS dst_port,
  CASE event_type WHEN 'error' THEN 'ICMP' WHEN 'view' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 16 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 ELSE 24 END AS tcp_flags,
  CAST(floor(value) AS BIGINT) AS packet_length, greatest(0, CAST(floor(value) AS BIGINT) - 40) AS payload_length,
  CAST(32 + user_id % 32 AS INT) AS ttl, k * 100 AS tcp_window, event_id % 50 AS tcp_seq,
  CASE WHEN user_id % 10 = 0 THEN 6 ELSE 4 END AS ip_version, CASE WHEN user_id % 5 = 0 THEN 100 END AS vlan_id,
  event_id % 97 = 0 AS more_fragments,
  CASE WHEN event_id % 211 = 0 THEN 'malformed' ELSE 'parsed' END AS parsing_status,
  CASE WHEN event_id % 307 = 0 THEN 'TRUE' WHEN event_id % 311 = 0 THEN 'UNKNOWN' ELSE 'FALSE' END AS truncation_status
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
""")

cte("flows_v", """
SELECT 's' || l_suppkey AS src_ip, 'n' || c_nationkey AS dst_ip, l_linenumber AS dst_port,
  CASE l_returnflag WHEN 'R' THEN 'TCP' WHEN 'A' THEN 'UDP' ELSE 'ICMP' END AS protocol,
  epoch_us(l_shipdate) / 1e6 + l_partkey % 86400 AS start_ts,
  epoch_us(l_shipdate) / 1e6 + l_partkey % 86400 + l_quantity * 3600 AS end_ts,
  CAST(floor(l_extendedprice) AS BIGINT) AS fwd_bytes, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS rev_bytes,
  CAST(floor(l_quantity) AS BIGINT) AS fwd_packets, CAST(floor(l_quantity * l_tax * 10) AS BIGINT) AS rev_packets,
  CASE l_linestatus || o_orderstatus WHEN 'OO' THEN 'ESTABLISHED' WHEN 'OF' THEN 'REJECTED' WHEN 'OP' THEN 'ATTEMPTED'
    WHEN 'FO' THEN 'RESET' WHEN 'FF' THEN 'CLOSED' ELSE 'INCOMPLETE' END AS state
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")


def labels_cte(name: str, seconds: int) -> None:
    cte(f"{name}_share", f"""
SELECT CAST(floor(epoch_us(ts) / 1e6 / {seconds}) AS BIGINT) AS bucket,
  avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM events GROUP BY 1""")
    cte(name, f"""
SELECT bucket, share, CAST(share > (SELECT avg(share) + 0.5 * stddev_pop(share) FROM {name}_share) AS INT) AS attack_state
FROM {name}_share""")


labels_cte("labels_h", W)
labels_cte("labels_q", EP)

cte("alerts_v", """
SELECT event_id AS alert_id, epoch_us(ts) / 1e6 AS ts, 'u' || user_id AS src_ip, 'h' || (k % 20) AS dst_ip, k AS dst_port,
  CASE WHEN value >= 400 THEN 1 WHEN value >= 250 THEN 2 WHEN value >= 100 THEN 3 ELSE 4 END AS severity,
  CASE k % 3 WHEN 0 THEN 'T1046' WHEN 1 THEN 'T1071' ELSE 'T1498' END AS technique
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events WHERE event_type = 'error')
""")

# packets with duplicate and retransmission marks
cte("dup_v", """
SELECT *, CASE WHEN packet_index > first_index THEN first_index END AS duplicate_of_index FROM (
  SELECT *, min(packet_index) OVER (PARTITION BY ts, src_ip, dst_ip, protocol, src_port, dst_port, packet_length, tcp_seq)
    AS first_index FROM packets_d)""")
# every ICMP packet is appended once more, so there is something to find
cte("packets_d", """
SELECT * FROM packets_v UNION ALL
SELECT * REPLACE (packet_index + 1000000000 AS packet_index) FROM packets_v WHERE protocol = 'ICMP'""")
cte("retr_v", """
SELECT p.*, coalesce(h.high IS NOT NULL AND p.tcp_seq < h.high, false) AS is_retransmission
FROM packets_v p LEFT JOIN (
  SELECT packet_index, max(tcp_seq + payload_length) OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port
    ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
  FROM packets_v WHERE protocol = 'TCP' AND payload_length > 0) h USING (packet_index)""")
cte("iat_v", f"""
SELECT *, ts - lag(ts) OVER (PARTITION BY bucket ORDER BY ts, packet_index) AS iat
FROM (SELECT *, CAST(floor(ts / {W}) AS BIGINT) AS bucket FROM retr_v)""")
cte("peak_v", """
SELECT bucket, CAST(max(n) AS DOUBLE) AS packet_rate_peak FROM (
  SELECT bucket, floor(ts) AS s, count(*) AS n FROM iat_v GROUP BY 1, 2) GROUP BY 1""")
FLAG_SQL = ", ".join(f"count(*) FILTER (WHERE tcp_flags & {m} <> 0) AS {n}_count" for n, m in (
    ("syn", 2), ("ack", 16), ("fin", 1), ("rst", 4), ("psh", 8), ("urg", 32), ("cwr", 128), ("ece", 64)))
cte("win_raw", f"""
SELECT capture_id, bucket, count(*) AS packet_count,
  avg(ttl) AS ttl_mean, var_pop(ttl) AS ttl_variance, min(ttl) AS ttl_min, max(ttl) AS ttl_max,
  avg(tcp_window) AS tcp_window_mean, var_pop(tcp_window) AS tcp_window_variance, min(tcp_window) AS tcp_window_min,
  max(tcp_window) AS tcp_window_max,
  avg(packet_length) AS packet_size_mean, var_pop(packet_length) AS packet_size_variance,
  min(packet_length) AS packet_size_min, max(packet_length) AS packet_size_max,
  avg(payload_length) AS payload_mean, var_pop(payload_length) AS payload_variance,
  count(*) FILTER (WHERE payload_length = 0) / count(payload_length) AS payload_zero_ratio,
  quantile_cont(packet_length, 0.5) AS packet_size_median, quantile_cont(packet_length, 0.95) AS packet_size_p95,
  quantile_cont(payload_length, 0.5) AS payload_median, quantile_cont(payload_length, 0.95) AS payload_p95,
  avg(payload_length) FILTER (WHERE protocol = 'TCP') AS mean_tcp_payload_size,
  max(payload_length) FILTER (WHERE protocol = 'TCP') AS max_tcp_payload_size,
  CAST(sum(payload_length) AS DOUBLE) / CASE WHEN max(ts) > min(ts) THEN max(ts) - min(ts) ELSE 60.0 END AS payload_rate_bytes_sec,
  avg(iat) AS iat_mean, var_pop(iat) AS iat_variance, min(iat) AS iat_min, max(iat) AS iat_max,
  quantile_cont(iat, 0.5) AS iat_median, quantile_cont(iat, 0.95) AS iat_p95, {FLAG_SQL},
  count(*) FILTER (WHERE tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0) AS syn_attempts,
  count(*) FILTER (WHERE tcp_flags & 18 <> 0) AS responses,
  count(*) FILTER (WHERE more_fragments) AS fragment_count,
  count(*) FILTER (WHERE more_fragments) / count(*) AS fragment_ratio,
  count(*) FILTER (WHERE protocol = 'TCP') AS tcp_count, count(*) FILTER (WHERE protocol = 'UDP') AS udp_count,
  count(*) FILTER (WHERE protocol = 'ICMP') AS icmp_count,
  count(*) FILTER (WHERE protocol = 'UDP') / count(*) AS udp_packet_ratio,
  count(*) FILTER (WHERE protocol = 'ICMP') / count(*) AS icmp_packet_ratio,
  count(*) FILTER (WHERE protocol = 'TCP' AND tcp_window = 0) AS tcp_window_zero_count,
  count(*) FILTER (WHERE protocol = 'TCP' AND payload_length > 0) AS tcp_with_payload,
  count(*) FILTER (WHERE is_retransmission) AS tcp_retransmission_count,
  count(*) FILTER (WHERE is_retransmission) /
    greatest(count(*) FILTER (WHERE protocol = 'TCP' AND payload_length > 0), 1) AS tcp_retransmission_rate,
  count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
  count(DISTINCT dst_port) AS unique_dst_ports
FROM iat_v GROUP BY 1, 2""")
cte("win_stats", f"""
SELECT w.*, p.packet_rate_peak, least(1.0::DOUBLE, 0.4::DOUBLE * least(unique_dst_ports / 100.0::DOUBLE, 1.0::DOUBLE)
   + 0.3::DOUBLE * least(syn_attempts / 100.0::DOUBLE, 1.0::DOUBLE) + 0.2::DOUBLE * least(unique_dst_ips / 25.0::DOUBLE, 1.0::DOUBLE)
   + 0.1::DOUBLE * (1.0 - least(responses / greatest(syn_attempts, 1), 1.0::DOUBLE))) AS port_scan_score,
  bucket * {W} AS window_start, (bucket + 1) * {W} AS window_end
FROM win_raw w JOIN peak_v p USING (bucket)""")
cte("risk_v", """
SELECT *, round(100.0 * (0.55::DOUBLE * scan + 0.20::DOUBLE * retr + 0.10::DOUBLE * frag + 0.15::DOUBLE * synp), 2) AS risk_score FROM (
  SELECT *, least(greatest(port_scan_score, 0), 1) AS scan,
    least(greatest(tcp_retransmission_rate / 0.10::DOUBLE, 0), 1) AS retr,
    least(greatest(fragment_ratio / 0.05::DOUBLE, 0), 1) AS frag,
    least(greatest(syn_count / (greatest(packet_count, 1) * 0.50::DOUBLE), 0), 1) AS synp FROM win_stats)""")
cte("talk_v", f"""
SELECT bucket, src_ip AS top_talker FROM (
  SELECT bucket, src_ip, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, src_ip) AS rn FROM (
    SELECT CAST(floor(ts / {W}) AS BIGINT) AS bucket, src_ip, count(*) AS n FROM packets_v GROUP BY 1, 2)) WHERE rn = 1""")
cte("findings_v", """
SELECT r.capture_id, r.bucket, r.window_start, r.risk_score,
  CASE WHEN r.risk_score >= 60 THEN 'high' WHEN r.risk_score >= 25 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN scan >= 0.5 THEN 'network_reconnaissance' ELSE 'traffic_anomaly' END AS attack_category,
  'window-' || r.bucket AS finding_id, t.top_talker AS src_ip
FROM risk_v r JOIN talk_v t USING (bucket)
WHERE scan >= 0.5 OR retr >= 0.5 OR frag >= 0.5 OR synp >= 0.5""")
