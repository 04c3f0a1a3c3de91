"""Sensor logs: Zeek TSV / JSON, EVE JSON lines and flow exports, as DataFrames of lines or rows.

Parsers take a DataFrame with a ``value`` column (one line each), so the same code serves
``spark.read.text``, a table of lines or a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions.columns import choose, private_ip
from packetloom.sources.ordered import last_above, placed

c = F.col


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def zeek_tsv(lines: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Columns named by the ``#fields`` line; short rows are dropped, long ones cut, ``-`` is NULL."""
    if fields is None:
        head = lines.filter(c("value").startswith("#fields")).first()
        if head is None:
            return lines.filter(F.lit(False))
        fields = head["value"].split()[1:]
    parts = F.split("value", "\t")
    body = lines.filter((F.trim("value") != "") & ~c("value").startswith("#") & (F.size(parts) >= len(fields)))
    return body.select(*[F.nullif(parts[i], F.lit("-")).alias(n) for i, n in enumerate(fields)])


def zeek_json(lines: DataFrame, fields: list[str]) -> DataFrame:
    """JSON-lines form of the same logs; lines that do not parse are dropped. Dotted names stay flat keys."""
    m = F.from_json("value", "map<string,string>")
    return lines.select(m.alias("_m")).filter("_m IS NOT NULL").select(*[c("_m")[n].alias(n) for n in fields])


def zeek_logs(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The named fields of all Zeek logs under ``path``, as text: each line by the latest ``#fields`` line above it, JSON lines by name.

    Rotated and concatenated logs may order or choose their fields differently; a field that a header lacks is NULL. Lines
    above a file's first header, short rows and broken JSON give no rows; long rows are cut. Files with one header, as a rule
    all, take it from a join by file name; only lines of files with several are put in order.
    """
    lines = placed(spark.read.text(path).select("value", "_metadata"))
    names = F.when(c("value").startswith("#fields"), F.split(F.trim("value"), "\\s+"))
    heads = lines.filter(c("value").startswith("#fields")).groupBy("_file").agg(F.min(F.struct("_block", "_id", names.alias("names"))).alias("_head"), F.count("*").alias("_heads"))
    many = heads.filter("_heads > 1").select("_file")
    plain = lines.join(many, "_file", "left_anti").join(heads.filter("_heads = 1").select("_file", "_head"), "_file", "left")
    plain = plain.withColumn("_names", c("_head.names")).drop("_head")
    mixed = last_above(lines.join(many, "_file", "left_semi"), names, "_names")
    body = plain.unionByName(mixed).filter((F.trim("value") != "") & ~c("value").startswith("#"))
    # the header's first word is "#fields", so a name's position is that of its cell plus one
    parts, obj = F.split("value", "\t"), F.from_json("value", "map<string,string>")
    cell = lambda n: F.nullif(F.get(parts, F.nullif(F.array_position("_names", n), F.lit(0)) - 2), F.lit("-"))
    json = c("value").startswith("{")
    rows = body.withColumn("_m", F.when(json, obj)).filter(F.when(json, c("_m").isNotNull()).otherwise(F.coalesce(F.size(parts) >= F.size("_names") - 1, F.lit(False))))
    return rows.select(*[F.when(json, c("_m")[n]).otherwise(cell(n)).alias(n) for n in fields])


def q(name: str) -> Column:
    return c(f"`{name}`")


def zeek_conn_to_flows(conn: DataFrame) -> DataFrame:
    """conn rows to flows: flags from the history letters, one packet per side, SF is ESTABLISHED."""
    ts, dur = q("ts").try_cast("double"), F.coalesce(q("duration").try_cast("double"), F.lit(0.0))
    ob, rb = F.coalesce(q("orig_bytes").try_cast("bigint"), F.lit(0)), F.coalesce(q("resp_bytes").try_cast("bigint"), F.lit(0))
    letter = lambda x: F.coalesce(q("history").contains(x), F.lit(False)).cast("int")
    one = F.lit(1).cast("bigint")
    return conn.filter(ts.isNotNull()).select(
        q("uid").alias("flow_id"), ts.alias("start_ts"), (ts + dur).alias("end_ts"), dur.alias("duration"), q("id.orig_h").alias("src_ip"),
        F.coalesce(q("id.orig_p").try_cast("int"), F.lit(0)).alias("src_port"), q("id.resp_h").alias("dst_ip"),
        F.coalesce(q("id.resp_p").try_cast("int"), F.lit(0)).alias("dst_port"), F.upper(F.coalesce(q("proto"), F.lit("TCP"))).alias("protocol"),
        one.alias("fwd_packets"), one.alias("rev_packets"), ob.alias("fwd_bytes"), rb.alias("rev_bytes"), (ob + rb).alias("total_bytes"),
        F.when(dur > 0, 2.0 / dur).otherwise(0.0).alias("packet_rate"), F.when(dur > 0, (ob + rb) / dur).otherwise(0.0).alias("byte_rate"),
        letter("S").alias("syn_count"), letter("A").alias("ack_count"), letter("F").alias("fin_count"), letter("R").alias("rst_count"),
        F.when(q("conn_state") == "SF", "ESTABLISHED").otherwise("INCOMPLETE").alias("completeness"))


def zeek_dns(dns: DataFrame) -> DataFrame:
    ans = F.when(q("answers").isNotNull(), F.split(q("answers"), ",")).otherwise(F.array().cast("array<string>"))
    return dns.select(q("ts").try_cast("double").alias("ts"), q("id.orig_h").alias("client_ip"), q("id.resp_h").alias("server_ip"), q("query").alias("query_name"),
                      F.coalesce(q("qtype_name"), F.lit("A")).alias("query_type"), F.coalesce(q("rcode_name"), F.lit("NOERROR")).alias("response_code"),
                      ans.alias("answers"), F.lit("zeek_dns").alias("source"))


def zeek_tls(ssl: DataFrame) -> DataFrame:
    return ssl.select(q("ts").try_cast("double").alias("ts"), q("id.orig_h").alias("client_ip"), q("id.resp_h").alias("server_ip"),
                      F.coalesce(q("id.orig_p").try_cast("int"), F.lit(0)).alias("client_port"), F.coalesce(q("id.resp_p").try_cast("int"), F.lit(443)).alias("server_port"),
                      q("server_name").alias("sni"), q("version").alias("tls_version"), F.lit("zeek_ssl").alias("source"))


ALERT = ("ts", "source", "signature", "signature_id", "severity", "category", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "technique")


def zeek_weird_alerts(weird: DataFrame) -> DataFrame:
    """Protocol oddities as alerts; checksum ones are LOW."""
    n = q("name")
    null = F.lit(None)
    return weird.select(q("ts").try_cast("double").alias("ts"), F.lit("zeek_weird").alias("source"), F.concat(F.lit("Protocol Anomaly: "), n).alias("signature"),
                        n.alias("signature_id"), F.when(n.contains("checksum"), "LOW").otherwise("MEDIUM").alias("severity"), F.lit("protocol_anomaly").alias("category"),
                        q("id.orig_h").alias("src_ip"), null.cast("int").alias("src_port"), q("id.resp_h").alias("dst_ip"), null.cast("int").alias("dst_port"),
                        null.cast("string").alias("protocol"), null.cast("string").alias("technique"))


EVE_SCHEMA = ("timestamp string, event_type string, src_ip string, src_port int, dest_ip string, dest_port int, proto string, "
              "alert struct<signature:string,signature_id:bigint,severity:int,category:string,gid:bigint,rev:bigint,action:string,metadata:map<string,string>>, "
              "dns struct<rrname:string,rrtype:string,rcode:string>")


def parse_eve(lines: DataFrame) -> DataFrame:
    """EVE JSON lines; broken lines are dropped (metadata values keep their JSON text)."""
    return lines.select(F.from_json("value", EVE_SCHEMA).alias("e")).filter("e.event_type IS NOT NULL").select("e.*")


def iso_epoch(text: Column) -> Column:
    """ISO-8601 text to epoch seconds; unreadable text gives 0."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1e6, F.lit(0.0))


def eve_alerts(eve: DataFrame) -> DataFrame:
    """Alert events: severity 1..4 to words (3 when absent), first technique id from a list or string, tag as fallback."""
    sev = F.coalesce(c("alert.severity"), F.lit(3))
    m = F.coalesce(c("alert.metadata")["mitre_technique_id"], c("alert.metadata")["tag"])
    listed = F.from_json(m, "array<string>")
    tech = F.when(m.startswith("["), F.try_element_at(listed, F.lit(1))).otherwise(m)
    return eve.filter("event_type = 'alert'").select(
        iso_epoch(c("timestamp")).alias("ts"), F.lit("suricata").alias("source"), F.coalesce("alert.signature", F.lit("Unknown Signature")).alias("signature"),
        F.coalesce(c("alert.signature_id").cast("string"), F.lit("")).alias("signature_id"),
        choose((sev == 1, "CRITICAL"), (sev == 2, "HIGH"), (sev == 4, "LOW"), default="MEDIUM").alias("severity"),
        F.coalesce("alert.category", F.lit("Unclassified")).alias("category"), "src_ip", "src_port", c("dest_ip").alias("dst_ip"), c("dest_port").alias("dst_port"),
        c("proto").alias("protocol"), tech.alias("technique"))


def eve_dns(eve: DataFrame) -> DataFrame:
    return eve.filter("event_type = 'dns'").select(
        iso_epoch(c("timestamp")).alias("ts"), c("src_ip").alias("client_ip"), c("dest_ip").alias("server_ip"), F.coalesce("dns.rrname", F.lit("")).alias("query_name"),
        F.coalesce("dns.rrtype", F.lit("A")).alias("query_type"), F.coalesce("dns.rcode", F.lit("NOERROR")).alias("response_code"),
        F.array().cast("array<string>").alias("answers"), F.lit("suricata_eve_dns").alias("source"))


def flow_export(rows: DataFrame) -> DataFrame:
    """Bidirectional flow-export rows: ms to s (times only above 1e6), protocol numbers to names, rates, completeness."""
    sec = lambda n: F.when(c(n) > 1e6, c(n) / 1000.0).otherwise(c(n).cast("double"))
    dur = F.coalesce(c("bidirectional_duration_ms"), F.lit(0)) / 1000.0
    n, b = c("bidirectional_packets"), c("bidirectional_bytes")
    syn, ack = F.coalesce("bidirectional_syn_packets", F.lit(0)), F.coalesce("bidirectional_ack_packets", F.lit(0))
    return rows.select(
        c("id").cast("string").alias("flow_id"), "src_ip", "src_port", "dst_ip", "dst_port",
        choose((c("protocol") == 6, "TCP"), (c("protocol") == 17, "UDP"), (c("protocol") == 1, "ICMP"), default="OTHER").alias("protocol"),
        sec("bidirectional_first_seen_ms").alias("start_ts"), sec("bidirectional_last_seen_ms").alias("end_ts"), dur.alias("duration"),
        F.coalesce("src2dst_packets", n).alias("fwd_packets"), F.coalesce("dst2src_packets", F.lit(0)).alias("rev_packets"), n.alias("total_packets"),
        F.coalesce("src2dst_bytes", b).alias("fwd_bytes"), F.coalesce("dst2src_bytes", F.lit(0)).alias("rev_bytes"), b.alias("total_bytes"),
        F.when(dur > 0, n / dur).otherwise(0.0).alias("packet_rate"), F.when(dur > 0, b / dur).otherwise(0.0).alias("byte_rate"),
        syn.alias("syn_count"), ack.alias("ack_count"), F.when((syn > 0) & (ack > 0), "ESTABLISHED").otherwise("UNKNOWN").alias("completeness"))


def evidence_union(packets: DataFrame, alerts: DataFrame, sessions: DataFrame) -> DataFrame:
    """One multi-sensor table with the names of the fields each sensor cannot fill and a hashed id."""
    txt = lambda *x: F.concat_ws(":", *[F.coalesce(i.cast("string"), F.lit("None")) for i in x])
    eid = lambda pre, *x: F.concat(F.lit(pre), F.sha2(txt(*x), 256))
    s, d = private_ip("src_ip"), private_ip("dst_ip")
    miss = lambda *names: F.array_compact(F.array(*[F.when(c(n).isNull(), n) for n in names]))
    us = lambda x: F.round(x * 1e6).cast("bigint")
    none = F.lit(None)
    p = packets.select(
        eid("ev_", us(c("ts")), F.lit("PCAP_WIRE"), c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port")).alias("evidence_id"), "ts", F.lit("PCAP_WIRE").alias("sensor_type"),
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        choose((s & d, "INTERNAL_LATERAL"), (s, "OUTBOUND"), (d, "INBOUND"), default="UNKNOWN").alias("direction"), c("packet_length").cast("bigint").alias("bytes_count"),
        F.lit(1).cast("bigint").alias("packets_count"), F.lit(0.0).alias("duration_seconds"), none.cast("string").alias("technique"), F.lit(1.0).alias("confidence"),
        miss("payload_length", "src_port", "dst_port").alias("missing_fields"))
    a = alerts.select(
        eid("ev_sur_", us(c("ts")), F.lit("SURICATA"), c("src_ip"), c("dst_ip"), c("signature_id")).alias("evidence_id"), "ts", F.lit("SURICATA_EVE").alias("sensor_type"),
        "src_ip", "dst_ip", "src_port", "dst_port", F.coalesce("protocol", F.lit("UNKNOWN")).alias("protocol"), F.lit("UNKNOWN").alias("direction"),
        none.cast("bigint").alias("bytes_count"), none.cast("bigint").alias("packets_count"), none.cast("double").alias("duration_seconds"), "technique",
        F.when(c("severity") == "CRITICAL", 0.90).otherwise(0.75).alias("confidence"),
        F.array(*[F.lit(n) for n in ("bytes_count", "packets_count", "duration_seconds")]).alias("missing_fields"))
    t = sessions.select(
        eid("ev_zk_", us(c("first_seen")), F.lit("ZEEK_CONN"), c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port")).alias("evidence_id"), c("first_seen").alias("ts"),
        F.lit("ZEEK_CONN").alias("sensor_type"), "src_ip", "dst_ip", "src_port", "dst_port", F.lit("TCP").alias("protocol"), F.lit("UNKNOWN").alias("direction"),
        c("total_bytes").cast("bigint").alias("bytes_count"), c("total_packets").cast("bigint").alias("packets_count"), c("duration_seconds"),
        none.cast("string").alias("technique"), F.lit(0.95).alias("confidence"), F.array().cast("array<string>").alias("missing_fields"))
    return p.unionByName(a).unionByName(t)
