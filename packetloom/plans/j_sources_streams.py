"""Adapter and streaming queries: SRC2-SRC9, SRC11, STR1-STR7, SNK1. Log lines are derived from the event table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from packetloom.functions.columns import r
from packetloom.operators import features as ft, flows as fl
from packetloom.plans import base
from packetloom.plans.a_views import W
from packetloom.plans.registry import cte, query
from packetloom.sources import corpora, logs, views
from packetloom.streaming import live

col = F.col


def events(spark, d):
    return views.table(spark, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "t": views.epoch("ts")})


cte("ev_k", "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) / 1e6 AS t FROM events")


def wide_lines(spark, d):
    """49-column lines; error events are written one column short."""
    f = [F.lit("")] * 49
    vals = {0: F.lit("10.0.0.1"), 1: 1024 + col("user_id") % 7, 2: F.lit("10.0.0.2"), 3: col("k"), 4: F.when(col("k") < 50, "tcp").otherwise("udp"), 6: col("value") / 100,
            7: F.floor("value"), 8: col("k"), 9: col("user_id") % 64, 10: F.lit("x"), 16: F.lit(3), 17: F.lit(2), 18: F.lit(255), 19: F.lit(128),
            28: F.floor("t"), 30: F.lit("0.5"), 31: F.lit("0.25"), 32: F.lit("0.1"), 47: F.when(col("k") < 20, " Fuzzers ").otherwise(""), 48: (col("k") < 20).cast("int")}
    cells = [vals.get(i, f[i]).cast("string") for i in range(49)]
    full = F.concat_ws(",", *cells)
    return events(spark, d).select(F.when(col("event_type") == "error", F.concat_ws(",", *cells[:48])).otherwise(full).alias("value"))


@query("src2_unsw_csv", f"""
SELECT CAST(floor(floor(t) / {W}) AS BIGINT) AS bucket, count(*) AS flow_count, CAST(sum(floor(value)) AS DOUBLE) AS src_bytes, max(CAST(k < 20 AS INT)) AS attack_state, count(*) FILTER (WHERE k < 50) AS tcp, count(*) FILTER (WHERE k < 20) AS fuzzers
FROM ev_k WHERE event_type <> 'error' GROUP BY 1""")
def src2(spark, d):
    good, _ = corpora.wide_csv(wide_lines(spark, d))
    return good.groupBy(F.floor(col("start_ts") / W).cast("bigint").alias("bucket")).agg(
        F.count("*").alias("flow_count"), F.sum("fwd_bytes").alias("src_bytes"), F.max("label").alias("attack_state"),
        F.count_if(col("protocol") == "TCP").alias("tcp"), F.count_if(col("attack_cat") == "Fuzzers").alias("fuzzers"))


@query("src2_rejected_rows", "SELECT count(*) AS rejected FROM events WHERE event_type = 'error'")
def src2_bad(spark, d):
    return corpora.wide_csv(wide_lines(spark, d))[1].agg(F.count("*").alias("rejected"))


@query("src2_window_state", f"""
WITH g AS (SELECT CAST(floor(floor(t) / {W}) AS BIGINT) AS bucket, count(*) AS n, sum(floor(value) + k) AS b FROM ev_k WHERE event_type <> 'error' GROUP BY 1)
SELECT bucket, n AS flow_count, CAST(b - coalesce(lag(b) OVER (ORDER BY bucket), 0) AS DOUBLE) AS delta_total_bytes FROM g""")
def src2_state(spark, d):
    good, _ = corpora.wide_csv(wide_lines(spark, d))
    s = ft.per_window_flow_state(good, W, "label")
    return s.select("bucket", "flow_count", "delta_total_bytes")


@query("src3_cic_csv", """
SELECT label, attack_family, count(*) AS n, round(sum(ts - 1499414400), 3) AS offset_sum, round(sum(b), 3) AS bytes FROM (
 SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, CASE event_type WHEN 'view' THEN 'BENIGN' ELSE 'DoS ' || event_type END AS attack_family, 1499414400 + event_id * 0.1::DOUBLE AS ts,
  CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN NULL ELSE value END AS b FROM ev_k) GROUP BY 1, 2""")
def src3(spark, d):
    rows = events(spark, d).select(col("event_id").alias("row_no"), F.when(col("k") == 7, "Infinity").when(col("k") == 8, "n/a").otherwise(col("value").cast("string")).alias(" Flow Bytes/s"),
                                   F.when(col("event_type") == "view", "benign ").otherwise(F.concat(F.lit("DoS   "), "event_type")).alias(" Label"))
    x = corpora.labelled_csv(rows, "row_no")
    return x.groupBy("label", "attack_family").agg(F.count("*").alias("n"), r(F.sum(col("ts") - 1499414400.0), 3).alias("offset_sum"), r(F.sum("flow_bytes_s"), 3).alias("bytes"))


THIRD = "CAST(floor(event_id * 3 / (SELECT max(event_id) + 1 FROM ev_k)) AS INT)"


@query("src3_cic_folder", f"""
SELECT label, attack_family, count(*) AS n, round(sum(pos * 0.1::DOUBLE), 3) AS offset_sum, round(sum(value), 3) AS bytes FROM (
 SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, CASE event_type WHEN 'view' THEN 'BENIGN' ELSE 'DoS ' || event_type END AS attack_family, value, k,
  row_number() OVER (PARTITION BY {THIRD} ORDER BY event_id) - 1 AS pos FROM ev_k) WHERE k <> 9 GROUP BY 1, 2""")
def src3_folder(spark, d):
    """Three files of the corpus; each counts its own rows, those with a missing cell too."""
    e = events(spark, d)
    third = F.floor(col("event_id") * 3 / e.agg(F.max("event_id") + 1).scalar()).cast("int")
    label = F.when(col("event_type") == "view", "benign").otherwise(F.concat(F.lit("DoS   "), "event_type"))
    line = F.when(col("k") == 9, F.concat_ws(",", label)).otherwise(F.concat_ws(",", label, col("value").cast("string")))
    rows = e.select("event_id", third.alias("third"), line.alias("value")).withColumn("first", F.row_number().over(Window.partitionBy("third").orderBy("event_id")) == 1)
    lines = rows.select("third", "event_id", F.posexplode(F.when(col("first"), F.array(F.lit(" Label, Flow Bytes/s"), "value")).otherwise(F.array("value"))).alias("pos", "value"))
    folder = live.stream_root(spark)
    lines.repartitionById(3, "third").sortWithinPartitions("event_id", "pos").select("value").write.text(folder)
    x = corpora.read_labelled_csv(spark, folder)
    return x.groupBy("label", "attack_family").agg(F.count("*").alias("n"), r(F.sum(col("ts") - 1499414400.0), 3).alias("offset_sum"), r(F.sum("flow_bytes_s"), 3).alias("bytes"))


@query("src4_toniot_csv", """
SELECT CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 END AS label, CASE WHEN k % 3 = 0 THEN event_type WHEN k % 3 = 1 THEN 'BENIGN' END AS attack_family, count(*) AS n, CAST(sum(CASE WHEN k < 30 THEN 0 ELSE k END) AS DOUBLE) AS src_bytes
FROM ev_k WHERE event_type <> 'signup' GROUP BY 1, 2""")
def src4(spark, d):
    k = col("k")
    rows = events(spark, d).select(
        F.when(col("event_type") == "signup", "-").otherwise(F.floor("t").cast("string")).alias("ts"), F.when(k % 3 == 0, " 1").when(k % 3 == 1, "0").otherwise("?").alias("label"),
        col("event_type").alias("type"), F.lit("tcp").alias("proto"), F.lit("1").alias("src_port"), F.lit("2").alias("dst_port"), F.lit("-").alias("duration"),
        F.when(k < 30, "-").otherwise(k.cast("string")).alias("src_bytes"), F.lit("5").alias("dst_bytes"), F.lit("1").alias("src_pkts"), F.lit("1").alias("dst_pkts"), F.lit("-").alias("missed_bytes"))
    return corpora.timed_csv(rows).groupBy("label", "attack_family").agg(F.count("*").alias("n"), F.sum("src_bytes").alias("src_bytes"))


CONN = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "conn_state", "history"]


def conn_lines(spark, d):
    e = events(spark, d)
    cells = [F.floor("t").cast("string"), F.concat(F.lit("C"), "event_id"), F.concat(F.lit("u"), "user_id"), F.lit("1024"), F.concat(F.lit("h"), col("k") % 20), col("k").cast("string"),
             F.when(col("k") < 50, "tcp").otherwise("udp"), F.when(col("k") % 4 == 0, "-").otherwise((col("k") % 4).cast("string")), F.floor("value").cast("string"),
             F.when(col("event_type") == "error", "-").otherwise("7"), F.when(col("event_type") == "purchase", "SF").otherwise("S0"),
             F.when(col("event_type") == "purchase", "ShADaF").when(col("event_type") == "error", "Sr").otherwise("-")]
    body = e.select(F.concat_ws("\t", *cells).alias("value"))
    head = e.limit(1).select(F.explode(F.array(F.lit("#separator \\x09"), F.lit("#fields\t" + "\t".join(CONN)), F.lit("#types\tx"))).alias("value"))
    return head.unionByName(body)


@query("src5_zeek_tsv", "SELECT CASE WHEN event_type = 'purchase' THEN 'SF' ELSE 'S0' END AS conn_state, count(*) AS n, count(*) FILTER (WHERE k % 4 <> 0) AS with_duration FROM ev_k GROUP BY 1")
def src5(spark, d):
    return logs.zeek_tsv(conn_lines(spark, d)).groupBy("conn_state").agg(F.count("*").alias("n"), F.count("duration").alias("with_duration"))


@query("src5_zeek_headers", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(k) AS BIGINT) AS k, count(*) FILTER (WHERE floor(event_id / 100) % 2 = 0) AS with_proto FROM ev_k GROUP BY 1")
def src5_headers(spark, d):
    """Concatenated logs: a new header, with another choice and order of fields, every hundred lines."""
    e = events(spark, d).withColumn("hundred", F.floor(col("event_id") / 100))
    first = F.row_number().over(Window.partitionBy("hundred").orderBy("event_id")) == 1
    cells = {True: ["uid", "service", "port", "proto"], False: ["port", "uid", "service"]}
    text = {"uid": col("event_id").cast("string"), "service": col("event_type"), "port": col("k").cast("string"), "proto": F.lit("tcp")}
    even = col("hundred") % 2 == 0
    line = F.when(even, F.concat_ws("\t", *[text[n] for n in cells[True]])).otherwise(F.concat_ws("\t", *[text[n] for n in cells[False]]))
    head = F.when(even, F.lit("#fields\t" + "\t".join(cells[True]))).otherwise(F.lit("#fields\t" + "\t".join(cells[False])))
    lines = e.withColumn("first", first).select("hundred", "event_id", F.posexplode(F.when(col("first"), F.array(F.lit("#separator \\x09"), head, line)).otherwise(F.array(line))).alias("pos", "value"))
    folder = live.stream_root(spark)
    # files end between headers; lines keep their order inside
    lines.repartitionByRange("hundred").sortWithinPartitions("hundred", "event_id", "pos").select("value").write.text(folder)
    x = logs.zeek_logs(spark, folder, ["service", "uid", "port", "proto"])
    return x.groupBy(col("service").alias("event_type")).agg(F.count("*").alias("n"), F.sum(col("uid").cast("bigint")).alias("ids"), F.sum(col("port").cast("bigint")).alias("k"), F.count("proto").alias("with_proto"))


@query("src5_zeek_json", "SELECT 'h' || (k % 20) AS server, count(*) AS n FROM ev_k WHERE event_type <> 'error' GROUP BY 1")
def src5_json(spark, d):
    e = events(spark, d)
    obj = F.to_json(F.create_map(F.lit("uid"), col("event_id").cast("string"), F.lit("id.resp_h"), F.concat(F.lit("h"), col("k") % 20)))
    lines = e.select(F.when(col("event_type") == "error", F.lit("{broken")).otherwise(obj).alias("value"))
    return logs.zeek_json(lines, ["uid", "id.resp_h"]).filter("uid IS NOT NULL").groupBy(F.col("`id.resp_h`").alias("server")).agg(F.count("*").alias("n"))


@query("src6_zeek_conn_to_flow", """
SELECT completeness, protocol, count(*) AS flows, CAST(sum(fb) AS BIGINT) AS fwd_bytes, CAST(sum(rb) AS BIGINT) AS rev_bytes, CAST(sum(syn) AS BIGINT) AS syn, CAST(sum(fin) AS BIGINT) AS fin, CAST(sum(rst) AS BIGINT) AS rst, round(sum(pr), 4) AS packet_rate FROM (
 SELECT CASE WHEN event_type = 'purchase' THEN 'ESTABLISHED' ELSE 'INCOMPLETE' END AS completeness, CASE WHEN k < 50 THEN 'TCP' ELSE 'UDP' END AS protocol, floor(value) AS fb, CASE WHEN event_type = 'error' THEN 0 ELSE 7 END AS rb,
  CAST(event_type IN ('purchase', 'error') AS INT) AS syn, CAST(event_type = 'purchase' AS INT) AS fin, 0 AS rst, CASE WHEN k % 4 = 0 THEN 0 ELSE 2.0 / (k % 4) END AS pr FROM ev_k) GROUP BY 1, 2""")
def src6(spark, d):
    f = logs.zeek_conn_to_flows(logs.zeek_tsv(conn_lines(spark, d)))
    return f.groupBy("completeness", "protocol").agg(F.count("*").alias("flows"), F.sum("fwd_bytes").alias("fwd_bytes"), F.sum("rev_bytes").alias("rev_bytes"), F.sum("syn_count").alias("syn"),
                                                     F.sum("fin_count").alias("fin"), F.sum("rst_count").alias("rst"), r(F.sum("packet_rate"), 4).alias("packet_rate"))


def eve_lines(spark, d):
    e = events(spark, d)
    k = col("k")
    tech = F.when(k % 3 == 0, F.lit('["T1046","T1595"]')).when(k % 3 == 1, F.lit('"T1071"')).otherwise(F.lit("null"))
    at = F.expr("timestampadd(SECOND, CAST(floor(t) AS INT), TIMESTAMP_NTZ'1970-01-01 00:00:00')")  # free of the session time zone
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    alert = F.format_string('{"timestamp":"%s","event_type":"alert","src_ip":"u%d","src_port":5,"dest_ip":"h%d","dest_port":%d,"proto":"TCP","alert":{"signature":"S%d","signature_id":%d,"severity":%d,"category":"c","metadata":{"mitre_technique_id":%s,"tag":"T1498"}}}',
                            iso, col("user_id"), k % 20, k, k, k, k % 5 + 1, tech)
    dns = F.format_string('{"timestamp":"%s","event_type":"dns","src_ip":"u%d","dest_ip":"h1","dns":{"rrname":"n%d.example","rrtype":"AAAA"}}', iso, col("user_id"), k)
    return e.select(F.when(col("event_type") == "error", alert).when(col("event_type") == "view", dns).otherwise(F.lit("not json")).alias("value"))


@query("src7_eve_json_alerts", """
SELECT CASE k % 5 + 1 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 4 THEN 'LOW' ELSE 'MEDIUM' END AS severity, CASE k % 3 WHEN 0 THEN 'T1046' WHEN 1 THEN 'T1071' ELSE 'T1498' END AS technique, count(*) AS n, CAST(sum(floor(t) - 1704000000) AS DOUBLE) AS ts_sum
FROM ev_k WHERE event_type = 'error' GROUP BY 1, 2""")
def src7(spark, d):
    return logs.eve_alerts(logs.parse_eve(eve_lines(spark, d))).groupBy("severity", "technique").agg(F.count("*").alias("n"), F.sum(col("ts") - 1704000000).alias("ts_sum"))


@query("src8_eve_dns", "SELECT 'n' || k || '.example' AS query_name, 'AAAA' AS query_type, 'NOERROR' AS response_code, count(*) AS n FROM ev_k WHERE event_type = 'view' GROUP BY 1")
def src8(spark, d):
    return logs.eve_dns(logs.parse_eve(eve_lines(spark, d))).groupBy("query_name", "query_type", "response_code").agg(F.count("*").alias("n"))


@query("src8_zeek_dns_tls_weird", """
SELECT 'dns' AS kind, CAST(k % 4 AS VARCHAR) AS detail, count(*) AS n FROM ev_k WHERE event_type = 'view' GROUP BY 2 UNION ALL SELECT 'tls', CASE WHEN k < 50 THEN 'a.example' END, count(*) FROM ev_k WHERE event_type = 'click' GROUP BY 2 UNION ALL
SELECT 'weird', CASE WHEN k < 40 THEN 'LOW' ELSE 'MEDIUM' END, count(*) FROM ev_k WHERE event_type = 'error' GROUP BY 2""")
def src8_zeek(spark, d):
    e = events(spark, d)
    k = col("k")
    tsv = lambda kind, *x: e.filter(col("event_type") == kind).select(F.concat_ws("\t", F.floor("t").cast("string"), F.concat(F.lit("u"), "user_id"), F.lit("h1"), *x).alias("value"))
    base_f = ["ts", "id.orig_h", "id.resp_h"]
    answers = F.when(k % 4 == 0, "-").otherwise(F.array_join(F.array_repeat(F.lit("1.1.1.1"), k % 4), ","))
    dns = logs.zeek_dns(logs.zeek_tsv(tsv("view", F.lit("q"), F.lit("A"), F.lit("NOERROR"), answers), [*base_f, "query", "qtype_name", "rcode_name", "answers"]))
    tls = logs.zeek_tls(logs.zeek_tsv(tsv("click", F.lit("1"), F.lit("443"), F.when(k < 50, "a.example").otherwise("-"), F.lit("TLSv13")), [*base_f, "id.orig_p", "id.resp_p", "server_name", "version"]))
    weird = logs.zeek_weird_alerts(logs.zeek_tsv(tsv("error", F.when(k < 40, "bad_checksum").otherwise("odd")), [*base_f, "name"]))
    one = lambda df, kind, x: df.select(F.lit(kind).alias("kind"), x.cast("string").alias("detail"))
    return one(dns, "dns", F.size("answers")).unionByName(one(tls, "tls", col("sni"))).unionByName(one(weird, "weird", col("severity"))).groupBy("kind", "detail").agg(F.count("*").alias("n"))


@query("src9_nfstream_to_flow", """
SELECT CASE k % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP' ELSE 'OTHER' END AS protocol, CASE WHEN event_type = 'click' THEN 'ESTABLISHED' ELSE 'UNKNOWN' END AS completeness, count(*) AS n, round(sum(floor(t) - 1704000000), 3) AS start_sum, round(sum(CASE WHEN k > 0 THEN 4 / (k * 10 / 1000.0::DOUBLE) ELSE 0 END), 3) AS packet_rate
FROM ev_k GROUP BY 1, 2""")
def src9(spark, d):
    k = col("k")
    click = col("event_type") == "click"
    rows = events(spark, d).select(
        col("event_id").alias("id"), F.lit("a").alias("src_ip"), F.lit(1).alias("src_port"), F.lit("b").alias("dst_ip"), k.alias("dst_port"),
        F.when(k % 4 == 0, 6).when(k % 4 == 1, 17).when(k % 4 == 2, 1).otherwise(99).alias("protocol"), (F.floor("t") * 1000.0).alias("bidirectional_first_seen_ms"),
        (F.floor("t") * 1000.0 + k * 10).alias("bidirectional_last_seen_ms"), (k * 10).alias("bidirectional_duration_ms"), F.lit(4).alias("bidirectional_packets"), F.lit(400).alias("bidirectional_bytes"),
        F.lit(3).alias("src2dst_packets"), F.lit(1).alias("dst2src_packets"), F.lit(300).alias("src2dst_bytes"), F.lit(100).alias("dst2src_bytes"),
        click.cast("int").alias("bidirectional_syn_packets"), click.cast("int").alias("bidirectional_ack_packets"))
    f = logs.flow_export(rows)
    return f.groupBy("protocol", "completeness").agg(F.count("*").alias("n"), r(F.sum(col("start_ts") - 1704000000), 3).alias("start_sum"), r(F.sum("packet_rate"), 3).alias("packet_rate"))


@query("src11_evidence_union", """
SELECT 'PCAP_WIRE' AS sensor_type, '' AS missing_fields, count(*) AS n, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets_v UNION ALL
SELECT 'SURICATA_EVE', 'bytes_count,packets_count,duration_seconds', count(*), NULL FROM events WHERE event_type = 'error' UNION ALL SELECT 'ZEEK_CONN', '', count(*), CAST(sum(b) AS BIGINT) FROM (
 SELECT u, h, hp, sum(packet_length) AS b FROM packets_bi WHERE protocol = 'TCP' GROUP BY 1, 2, 3)""")
def src11(spark, d):
    from packetloom.plans.d_clean_flows import packets_bi
    e = logs.evidence_union(base.packets(spark, d), logs.eve_alerts(logs.parse_eve(eve_lines(spark, d))), fl.track_tcp_sessions(packets_bi(spark, d)))
    return e.groupBy("sensor_type", F.array_join("missing_fields", ",").alias("missing_fields")).agg(F.count("*").alias("n"), F.sum("bytes_count").alias("bytes"))


# --- streams ------------------------------------------------------------------------------------------------
def live_packets(spark, d, stream=True):
    """The packet view over a file stream of the event table, or over the table itself."""
    e = spark.read.parquet(f"{d}/events.parquet")
    if stream:
        e = live.files(spark, d, "events.parquet", e.schema)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = col("event_type")
    return e.select(F.timestamp_micros((views.epoch("ts") * 1e6).cast("bigint")).alias("event_time"), col("event_id").alias("packet_index"), F.concat(F.lit("u"), "user_id").alias("src_ip"),
                    F.concat(F.lit("h"), k % 20).alias("dst_ip"), k.alias("dst_port"), F.floor("value").cast("bigint").alias("packet_length"), kind.alias("kind"),
                    F.when(kind == "error", "ICMP").when(kind == "view", "UDP").otherwise("TCP").alias("protocol"),
                    F.when(kind == "signup", 2).when(kind == "click", 16).when(kind == "purchase", 17).when(kind == "error", 4).otherwise(24).alias("tcp_flags"))


CLOSED = "(SELECT max(ts) - 120 FROM packets_v)"


@query("str1_live_window_stats", f"""
SELECT * FROM (SELECT CAST(floor(ts / {W}) AS BIGINT) * {W} AS window_start, CAST(floor(ts / {W}) AS BIGINT) * {W} + {W} AS window_end, count(*) AS packet_count, round(avg(packet_length), 6) AS packet_size_mean, min(packet_length) AS packet_size_min,
 max(packet_length) AS packet_size_max, count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS syn_count, count(*) FILTER (WHERE tcp_flags & 16 <> 0) AS ack_count FROM packets_v GROUP BY 1) WHERE window_end <= {CLOSED}""")
def str1(spark, d):
    t, _ = live.run_available(live.window_stats(live_packets(spark, d), f"{W} seconds"))
    return t.drop("approx_src_ips").withColumn("packet_size_mean", r(col("packet_size_mean")))


@query("str1_live_sliding", f"""
WITH s AS (SELECT (CAST(floor(ts / 3600) AS BIGINT) - unnest(range(4))) * 3600 AS window_start, packet_length FROM packets_v)
SELECT * FROM (SELECT window_start, window_start + 14400 AS window_end, count(*) AS packet_count FROM s GROUP BY 1) WHERE window_end <= {CLOSED}""")
def str1_sliding(spark, d):
    t, _ = live.run_available(live.window_stats(live_packets(spark, d), "14400 seconds", slide="3600 seconds"))
    return t.select("window_start", "window_end", "packet_count")


@query("str2_live_dedup", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT event_type AS kind, 'u' || user_id AS u, k FROM ev_k) GROUP BY 1")
def str2(spark, d):
    p = live_packets(spark, d)
    t, _ = live.run_available(live.dedup(p, ["kind", "src_ip", "dst_port"], "400 days"))
    return t.groupBy("kind").agg(F.count("*").alias("n"))


@query("str3_live_sessions", f"""
WITH s AS (SELECT src_ip, ts, packet_length, CAST(round(ts * 1e6::DOUBLE, 0) AS BIGINT) AS us, CASE WHEN ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) >= 7200 THEN 1 ELSE 0 END AS nw FROM packets_v),
n AS (SELECT *, sum(nw) OVER (PARTITION BY src_ip ORDER BY ts) AS sid FROM s), g AS (SELECT src_ip, sid, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM n GROUP BY 1, 2)
SELECT src_ip, start_us, end_us, packets, bytes FROM g WHERE end_us / 1e6 <= {CLOSED}""")
def str3(spark, d):
    t, _ = live.run_available(live.sessions(live_packets(spark, d), "src_ip", "7200 seconds"))
    return t


@query("str4_entity_memory", """
WITH o AS (SELECT src_ip AS entity, dst_ip AS peer, dst_port AS port, row_number() OVER (PARTITION BY src_ip ORDER BY ts, packet_index) AS i FROM packets_v),
f AS (SELECT *, i > 1 AND (row_number() OVER (PARTITION BY entity, peer ORDER BY i) = 1 OR row_number() OVER (PARTITION BY entity, port ORDER BY i) = 1) AS novel FROM o),
l AS (SELECT entity, count(*) AS observations, count(DISTINCT peer) AS peers, count(DISTINCT port) AS ports, list(CASE WHEN novel THEN 0.15::DOUBLE ELSE -0.02::DOUBLE END ORDER BY i) AS steps FROM f GROUP BY 1)
SELECT entity, observations, peers, ports, round(list_reduce(list_prepend(0.0::DOUBLE, steps), lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + x))), 4) AS divergence_score FROM l""")
def str4(spark, d):
    p = live_packets(spark, d, False).select("event_time", "packet_index", col("src_ip").alias("entity"), col("dst_ip").alias("peer"), col("dst_port").alias("port"))
    root = live.stream_root(spark)
    for stream in arrivals(spark, p):
        t, _ = live.run_available(live.entity_memory(stream), "update", root=root, rocksdb=True)
    last = t.groupBy("entity").agg(F.max_by(F.struct("observations", "peers", "ports", "divergence_score"), "observations").alias("x")).select("entity", "x.*")
    return last.withColumn("divergence_score", r(col("divergence_score"), 4))


SLICES = 3
#: The third of the covered time in which a packet falls.
SLICE_SQL = f"CAST(least({SLICES - 1}, floor((ts - lo) * {SLICES} / (hi - lo))) AS BIGINT)"
SLICED = "b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM packets_v)"


def arrivals(spark, rows, late=None):
    """``rows`` as a file stream that grows by a third of the covered time at each step; rows in ``late`` come a step later."""
    t = F.unix_micros("event_time") / 1e6
    ends = rows.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    at = F.least(F.lit(SLICES - 1), F.floor((t - ends.lo) * SLICES / (ends.hi - ends.lo)))
    sliced = rows.withColumn("_step", at if late is None else at + late.cast("int"))
    folder = f"{live.stream_root(spark)}/in"
    for step in range(SLICES + (late is not None)):
        sliced.filter(col("_step") == step).drop("_step").write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


@query("str5_late_data", f"""
WITH {SLICED}, a AS (SELECT ts, {SLICE_SQL} + CASE WHEN packet_index % 10 = 0 THEN 1 ELSE 0 END AS batch FROM packets_v, b),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 120 AS mark FROM a GROUP BY batch)
SELECT batch, count(*) AS packets, count(*) FILTER (WHERE ts < mark) AS late, count(*) FILTER (WHERE (floor(ts / {W}) + 1) * {W} <= mark) AS dropped, round(max(CASE WHEN ts < mark THEN mark - ts END), 2) AS max_lateness
FROM a JOIN m USING (batch) GROUP BY 1""")
def str5(spark, d):
    report = live.LateRows(f"{live.stream_root(spark)}/late", 120, W)
    root = live.stream_root(spark)
    for stream in arrivals(spark, live_packets(spark, d, False), col("packet_index") % 10 == 0):
        live.run_available(stream, each=report.split, root=root)
    return report.counts(spark).select(col("batch").cast("bigint").alias("batch"), "packets", "late", "dropped", r(col("max_lateness"), 2).alias("max_lateness"))


@query("str6_live_alert_enrich", """
SELECT a.event_id AS alert_id, f.event_id AS flow_id FROM ev_k a JOIN ev_k f ON a.user_id = f.user_id AND a.k % 20 = f.k % 20 AND f.t BETWEEN a.t - 3600 AND a.t + 3600 WHERE a.event_type = 'error' AND f.event_type <> 'error'""")
def str6(spark, d):
    p = live_packets(spark, d)
    a = p.filter("kind = 'error'").select("event_time", "src_ip", "dst_ip", col("packet_index").alias("alert_id"))
    f = live_packets(spark, d).filter("kind <> 'error'").select(col("event_time").alias("flow_time"), col("src_ip").alias("flow_src"), col("dst_ip").alias("flow_dst"), col("packet_index").alias("flow_id"))
    t, _ = live.run_available(live.alert_enrich(a, f, "3600 seconds"))
    return t.select("alert_id", "flow_id")


@query("str7_belief_stream", f"""
SELECT * FROM (SELECT window_start, contradicting, supporting, CAST(CASE WHEN contradicting > supporting THEN 0.75 WHEN supporting > 0 THEN 1.15 ELSE 1 END AS DOUBLE) AS factor FROM (
 SELECT CAST(floor(ts / {W}) AS BIGINT) * {W} AS window_start, count(*) FILTER (WHERE packet_length < 12) AS contradicting, count(*) FILTER (WHERE packet_length >= 12) AS supporting FROM packets_v GROUP BY 1)) WHERE window_start + {W} <= {CLOSED}""")
def str7(spark, d):
    p = live_packets(spark, d).select("event_time", "protocol", F.when(col("packet_length") < 12, 0).otherwise(col("packet_length")).alias("bytes"))
    t, _ = live.run_available(live.belief_factors(p, "2 minutes", f"{W} seconds"))
    return t


@query("str7_belief_table", f"""
WITH {SLICED}, e AS (SELECT src_ip AS case_id, {SLICE_SQL} AS batch, count(*) FILTER (WHERE packet_length < 12) AS c, count(*) FILTER (WHERE packet_length >= 12) AS s FROM packets_v, b GROUP BY 1, 2),
f AS (SELECT case_id, list(CASE WHEN c > s THEN 0.75::DOUBLE WHEN s > 0 THEN 1.15::DOUBLE ELSE 1::DOUBLE END ORDER BY batch) AS fs FROM e GROUP BY 1),
p AS (SELECT src_ip AS case_id, unnest([1, 2, 3]) AS horizon, greatest(0.05, count(*) FILTER (WHERE protocol = 'ICMP') / count(*)) AS share FROM packets_v GROUP BY 1)
SELECT case_id, horizon, round(list_reduce(list_prepend((share / horizon)::DOUBLE, fs), lambda a, x: greatest(0.01::DOUBLE, least(0.99::DOUBLE, a * x))), 6) AS p, len(fs) AS revisions FROM p JOIN f USING (case_id)""")
def str7_table(spark, d):
    rows = live_packets(spark, d, False).select("event_time", col("src_ip").alias("case_id"), "protocol", F.when(col("packet_length") < 12, 0).otherwise(col("packet_length")).alias("bytes"))
    share = rows.groupBy("case_id").agg(F.greatest(F.lit(0.05), F.count_if(col("protocol") == "ICMP") / F.count("*")).alias("share"))
    points = share.select("case_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("horizon"), "share").withColumn("p", col("share") / col("horizon"))
    beliefs = live.BeliefTable(points, f"{live.stream_root(spark)}/beliefs")
    root = live.stream_root(spark)
    for stream in arrivals(spark, rows):
        live.run_available(stream, each=beliefs.revise, root=root)
    return beliefs.read().select("case_id", "horizon", r(col("p")).alias("p"), "revisions")


@query("snk1_analysis_store", "SELECT 'a' || CAST(floor(bucket / 240) AS BIGINT) AS analysis_id, count(*) AS findings, count(DISTINCT severity) AS severities FROM findings_v WHERE CAST(floor(bucket / 240) AS BIGINT) <> 1973 GROUP BY 1")
def snk1(spark, d):
    import uuid

    from packetloom.session import checkpoint_root
    from packetloom.sinks.store import AnalysisStore
    store = AnalysisStore(spark, f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}")
    f = base.findings(spark, d).withColumn("analysis_id", F.concat(F.lit("a"), F.floor(col("bucket") / 240)))
    a = f.groupBy("analysis_id").agg(F.max("risk_score").alias("risk_score"))
    store.upsert(a, f)
    store.upsert(a, f)  # a second upsert replaces, it does not add
    store.delete(a.filter("analysis_id = 'a1973'"))
    return store.read("findings").groupBy("analysis_id").agg(F.count("*").alias("findings"), F.count_distinct("severity").alias("severities"))
