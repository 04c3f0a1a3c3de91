"""Bidirectional flows and TCP sessions as single grouped aggregations over packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.functions.columns import choose, count_when, has_flag, stable_id, tags, r
from packetloom.functions.ordered import segmented_lag, segmented_running
from packetloom.functions.quantiles import group_quantiles

FLOW_KEY = ["capture_id", "a_ip", "a_port", "b_ip", "b_port", "protocol"]


def endpoint_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free pair ``a`` <= ``b`` of (ip, port) and whether the packet goes a -> b."""
    left = F.struct(F.col("src_ip").alias("ip"), F.coalesce("src_port", F.lit(-1)).alias("port"))
    right = F.struct(F.col("dst_ip").alias("ip"), F.coalesce("dst_port", F.lit(-1)).alias("port"))
    return (packets.withColumns({"_l": left, "_r": right})
            .withColumns({"_a": F.least("_l", "_r"), "_b": F.greatest("_l", "_r"), "a_to_b": F.col("_l") <= F.col("_r")})
            .withColumns({"a_ip": F.col("_a.ip"), "a_port": F.col("_a.port"), "b_ip": F.col("_b.ip"),
                          "b_port": F.col("_b.port")}).drop("_l", "_r", "_a", "_b"))


def build_flows(packets: DataFrame) -> DataFrame:
    """Flows per direction-free 5-tuple.

    Counters are kept per side of the key and assigned to forward/reverse once the first packet's
    side is known, so flows need one aggregation and no join back to packets.
    """
    p = endpoint_key(packets)
    size = F.coalesce("packet_length", F.lit(0))
    order = F.struct("ts", "packet_index")
    flags = F.col("tcp_flags")
    retr = count_when(F.col("is_retransmission")) if "is_retransmission" in p.columns else F.lit(0).cast("bigint")
    g = p.groupBy(*FLOW_KEY).agg(
        F.min_by("a_to_b", order).alias("_fwd_is_a"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        count_when(F.col("a_to_b")).alias("_na"), F.coalesce(F.sum(F.when(F.col("a_to_b"), size)), F.lit(0)).alias("_ba"),
        F.count("*").alias("total_packets"), F.sum(size).alias("total_bytes"),
        count_when(has_flag(flags, 0x02)).alias("syn_count"), count_when(has_flag(flags, 0x10)).alias("ack_count"),
        count_when(has_flag(flags, 0x01)).alias("fin_count"), count_when(has_flag(flags, 0x04)).alias("rst_count"),
        F.bool_or(flags.bitwiseAND(F.lit(0x12)) == 0x12).alias("_syn_ack"),
        F.bool_or(has_flag(flags, 0x10) & ~has_flag(flags, 0x02)).alias("_bare_ack"),
        F.bool_or(has_flag(flags, 0x05)).alias("_term"), retr.alias("retransmission_count"))
    fwd = F.col("_fwd_is_a")
    dur = F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0.0))
    side = lambda x, y: F.when(fwd, F.col(x)).otherwise(F.col(y))
    port = lambda c: F.when(c >= 0, c)
    fp = F.when(fwd, F.col("_na")).otherwise(F.col("total_packets") - F.col("_na"))
    fb = F.when(fwd, F.col("_ba")).otherwise(F.col("total_bytes") - F.col("_ba"))
    return g.select(
        "capture_id", stable_id("flow", *[F.col(k) for k in FLOW_KEY]).alias("flow_id"),
        side("a_ip", "b_ip").alias("src_ip"), port(side("a_port", "b_port")).alias("src_port"),
        side("b_ip", "a_ip").alias("dst_ip"), port(side("b_port", "a_port")).alias("dst_port"), "protocol",
        "start_ts", "end_ts", dur.alias("duration"), fp.alias("fwd_packets"),
        (F.col("total_packets") - fp).alias("rev_packets"), "total_packets", fb.alias("fwd_bytes"),
        (F.col("total_bytes") - fb).alias("rev_bytes"), "total_bytes",
        F.when(dur > 0, F.col("total_packets") / dur).alias("packet_rate"),
        F.when(dur > 0, F.col("total_bytes") / dur).alias("byte_rate"),
        "syn_count", "ack_count", "fin_count", "rst_count", "retransmission_count",
        flow_completeness(F.col("protocol"), F.col("syn_count") > 0, F.col("_syn_ack"), F.col("_bare_ack"),
                          F.col("_term")).alias("completeness"))


def flow_completeness(protocol: Column, syn: Column, syn_ack: Column, bare_ack: Column, term: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return choose((F.coalesce(protocol, F.lit("")) != "TCP", "not_applicable"),
                  (yes(syn) & yes(syn_ack) & yes(bare_ack) & yes(term), "COMPLETE"), (yes(syn), "INCOMPLETE"),
                  default="UNKNOWN")


# Order in which one packet's letters are written, and their flag tests.
_EVENTS = ("syn", "synack", "rst", "fin", "ack", "data")


def track_tcp_sessions(packets: DataFrame) -> DataFrame:
    """TCP conversations in arrival order: per side, the first index of each kind of packet.

    State, handshake and history follow from those first indexes, so no row-order fold is needed.
    """
    p = endpoint_key(packets.filter((F.col("protocol") == "TCP") & F.col("src_ip").isNotNull()
                                    & F.col("dst_ip").isNotNull() & F.col("src_port").isNotNull()
                                    & F.col("dst_port").isNotNull()))
    flags, idx = F.col("tcp_flags"), F.col("packet_index")
    syn, ack = has_flag(flags, 0x02), has_flag(flags, 0x10)
    tests = {"syn": syn & ~ack, "synack": syn & ack, "rst": has_flag(flags, 0x04), "fin": has_flag(flags, 0x01),
             "ack": ack & ~syn, "data": F.coalesce(F.col("payload_length"), F.lit(0)) > 0}
    size = F.coalesce("packet_length", F.lit(0))
    aggs = [F.min_by("a_to_b", idx).alias("_orig_a"), F.min("ts").alias("_min_ts"), F.max("ts").alias("last_seen"),
            F.min_by("ts", idx).alias("first_seen")]
    for s, here in (("a", F.col("a_to_b")), ("b", ~F.col("a_to_b"))):
        aggs += [F.min(F.when(here & t, idx)).alias(f"{s}_{e}") for e, t in tests.items()]
        aggs += [count_when(here).alias(f"{s}_n"), F.coalesce(F.sum(F.when(here, size)), F.lit(0)).alias(f"{s}_bytes")]
    g = p.groupBy("capture_id", "a_ip", "a_port", "b_ip", "b_port").agg(*aggs)
    orig_a = F.col("_orig_a")
    pick = {}
    for e in (*_EVENTS, "n", "bytes", "ip", "port"):
        pick[f"o_{e}"] = F.when(orig_a, F.col(f"a_{e}")).otherwise(F.col(f"b_{e}"))
        pick[f"r_{e}"] = F.when(orig_a, F.col(f"b_{e}")).otherwise(F.col(f"a_{e}"))
    g = g.select("capture_id", "first_seen", "last_seen", *[c.alias(n) for n, c in pick.items()])
    o, q = (lambda e: F.col(f"o_{e}")), (lambda e: F.col(f"r_{e}"))
    first_r_syn = F.least(q("syn"), q("synack"))
    first_r_ack = F.least(q("ack"), q("synack"))
    hs_ack = (o("ack").isNotNull() & (o("synack").isNull() | (o("synack") > o("ack")))
              & (first_r_syn < o("ack")) & (first_r_ack < o("ack")))
    g = g.withColumns({
        "orig_syn": o("syn").isNotNull() | o("synack").isNotNull(),
        "orig_ack": o("ack").isNotNull() | o("synack").isNotNull(),
        "orig_fin": o("fin").isNotNull(), "orig_rst": o("rst").isNotNull(),
        "resp_syn": q("syn").isNotNull() | q("synack").isNotNull(),
        "resp_ack": q("ack").isNotNull() | q("synack").isNotNull(),
        "resp_fin": q("fin").isNotNull(), "resp_rst": q("rst").isNotNull(),
        "handshake_ack_seen": F.coalesce(hs_ack, F.lit(False))})
    g = g.withColumn("handshake_completed", F.col("orig_syn") & F.col("resp_syn") & F.col("resp_ack") & (
        F.col("handshake_ack_seen") | (F.col("orig_ack") & (F.col("o_n") >= 2))))
    # one S or H per side: the kind of that side's first SYN
    def letters(side, names):
        c = lambda e: F.col(f"{side}_{e}")
        first = F.least(c("syn"), c("synack"))
        s, h, rr, ff, aa, dd = names
        mk = lambda at, rank, ch: F.when(at.isNotNull(), F.struct(
            at.alias("at"), F.lit(rank).alias("rank"), ch.alias("ch")))
        return [mk(first, 0, F.when(c("syn") == first, s).otherwise(h)), mk(c("rst"), 1, F.lit(rr)),
                mk(c("fin"), 2, F.lit(ff)), mk(c("ack"), 3, F.lit(aa)), mk(c("data"), 4, F.lit(dd))]
    seq = F.array_sort(F.array_compact(F.array(*letters("o", "SHRFAD"), *letters("r", "shrfad"))))
    g = g.withColumn("history_string", F.array_join(F.transform(seq, lambda x: x["ch"]), ""))
    g = tcp_state(g)
    return g.select(
        "capture_id",
        F.concat(F.lit("tcp-"), "o_ip", F.lit(":"), "o_port", F.lit("-"), "r_ip", F.lit(":"), "r_port", F.lit("-"),
                 F.floor("first_seen")).alias("session_id"),
        F.col("o_ip").alias("src_ip"), F.col("o_port").alias("src_port"), F.col("r_ip").alias("dst_ip"),
        F.col("r_port").alias("dst_port"), "first_seen", "last_seen",
        F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0.0)).alias("duration_seconds"),
        F.col("o_n").alias("forward_packets"), F.col("r_n").alias("reverse_packets"),
        (F.col("o_n") + F.col("r_n")).alias("total_packets"), F.col("o_bytes").alias("forward_bytes"),
        F.col("r_bytes").alias("reverse_bytes"), (F.col("o_bytes") + F.col("r_bytes")).alias("total_bytes"),
        "orig_syn", "orig_ack", "orig_fin", "orig_rst", "resp_syn", "resp_ack", "resp_fin", "resp_rst",
        "handshake_ack_seen", "handshake_completed", "history_string", "connection_state", "zeek_state",
        "boundary_status")


def tcp_state(g: DataFrame) -> DataFrame:
    """Eight connection states, their Zeek-style codes and how much of the life cycle was seen."""
    c = F.col
    silent = c("r_n") == 0
    closed = (c("orig_fin") & c("resp_fin")) | (c("orig_fin") & c("resp_ack") & (c("r_n") >= 2))
    rules = [
        (c("orig_syn") & ~c("resp_syn") & ~c("resp_rst") & ~c("orig_rst") & silent, "ATTEMPTED", "S0", "TRUNCATED_AT_END"),
        (c("orig_syn") & c("resp_rst") & ~c("resp_syn"), "REJECTED", "REJ", "COMPLETE_LIFECYCLE"),
        (c("orig_syn") & c("orig_rst") & silent, "RESET_ATTEMPT", "RSTOS0", "COMPLETE_LIFECYCLE"),
        (c("handshake_completed") & closed, "CLOSED", "SF", "COMPLETE_LIFECYCLE"),
        (c("handshake_completed") & c("orig_rst"), "RESET", "RSTO", "COMPLETE_LIFECYCLE"),
        (c("handshake_completed") & c("resp_rst"), "RESET", "RSTR", "COMPLETE_LIFECYCLE"),
        (c("handshake_completed"), "ESTABLISHED", "S1", "TRUNCATED_AT_END"),
        (~c("orig_syn"), "INCOMPLETE", "OTH", "MIDSTREAM_JOIN")]
    return g.withColumns({
        "connection_state": choose(*[(k, a) for k, a, _, _ in rules], default="INCOMPLETE"),
        "zeek_state": choose(*[(k, b) for k, _, b, _ in rules], default="OTH"),
        "boundary_status": choose(*[(k, d) for k, _, _, d in rules], default="ISOLATED_WINDOW")})


def session_metrics(sessions: DataFrame) -> DataFrame:
    n = F.count("*")
    st = lambda s: count_when(F.col("connection_state") == s)
    ratio = lambda x: r(F.coalesce(F.try_divide(x, n), F.lit(0.0)), 4)
    return sessions.agg(
        n.alias("total_tcp_sessions"), st("ATTEMPTED").alias("attempted_sessions"),
        count_when(F.col("handshake_completed")).alias("established_sessions"), st("CLOSED").alias("closed_sessions"),
        st("REJECTED").alias("rejected_sessions"), st("RESET").alias("reset_sessions"),
        st("RESET_ATTEMPT").alias("reset_attempt_sessions"), st("INCOMPLETE").alias("incomplete_sessions"),
        count_when(F.col("orig_syn") & ~F.col("orig_ack") & ~F.col("resp_syn")).alias("syn_only_sessions"),
        ratio(st("ATTEMPTED") + st("REJECTED")).alias("failed_connection_ratio"),
        ratio(count_when(F.col("handshake_completed"))).alias("establishment_ratio"),
        ratio(st("RESET") + st("REJECTED")).alias("reset_ratio"), ratio(st("INCOMPLETE")).alias("incomplete_ratio"))


def flow_profile(flows: DataFrame) -> DataFrame:
    tp = F.coalesce(F.col("fwd_packets"), F.lit(0)) + F.coalesce(F.col("rev_packets"), F.lit(0))
    tb = F.coalesce(F.col("fwd_bytes"), F.lit(0)) + F.coalesce(F.col("rev_bytes"), F.lit(0))
    raw = F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0.0))
    dur = F.greatest(raw, F.lit(1e-4))
    asym = (F.col("fwd_packets") - F.col("rev_packets")) / F.greatest(tp, F.lit(1))
    return flows.withColumns({
        "duration_seconds": r(raw, 4), "total_packets": tp, "total_bytes": tb,
        "packet_asymmetry_ratio": r(asym, 4),
        "byte_asymmetry_ratio": r((F.col("fwd_bytes") - F.col("rev_bytes")) / F.greatest(tb, F.lit(1)), 4),
        "packet_rate_per_sec": r(tp / dur, 2), "byte_rate_per_sec": r(tb / dur, 2),
        "mean_packet_size_bytes": r(tb / F.greatest(tp, F.lit(1)), 2), "is_single_packet_flow": tp == 1,
        "is_asymmetric_flood": (F.abs(asym) >= 0.95) & (tp >= 50)})


def flow_summary(profiles: DataFrame) -> DataFrame:
    """Population summary of flow profiles; the median is exact over all flows."""
    n = F.count("*")
    retr = F.sum("retransmission_count") if "retransmission_count" in profiles.columns else F.lit(0).cast("bigint")
    row = profiles.agg(
        n.alias("total_flows"), count_when(F.col("is_single_packet_flow")).alias("single_packet_flows"),
        r(count_when(F.col("is_single_packet_flow")) / n, 4).alias("single_packet_flow_ratio"),
        r(F.avg("duration_seconds"), 4).alias("mean_flow_duration_seconds"),
        r(F.avg("packet_asymmetry_ratio"), 4).alias("mean_packet_asymmetry"),
        r(F.avg("byte_asymmetry_ratio"), 4).alias("mean_byte_asymmetry"),
        count_when(F.abs("packet_asymmetry_ratio") >= 0.9).alias("high_asymmetry_flow_count"),
        retr.alias("total_retransmissions"),
        r(retr / F.greatest(F.lit(1), F.sum("total_packets")), 4).alias("retransmission_ratio"),
        r(F.avg("packet_rate_per_sec"), 2).alias("mean_packet_rate"),
        r(F.avg("byte_rate_per_sec"), 2).alias("mean_byte_rate"),
        count_when((F.col("packet_rate_per_sec") >= 100) & (F.col("total_packets") >= 10)).alias("bursty_flow_count"),
        F.lit(0).alias("_k"))
    med = group_quantiles(profiles.select(F.lit(0).alias("_k"), "duration_seconds"), ["_k"], "duration_seconds",
                          {"_m": 0.5})
    return row.join(F.broadcast(med), "_k", "left").withColumn(
        "median_flow_duration_seconds", r(F.coalesce("_m", F.lit(0.0)), 4)).drop("_k", "_m")


def session_tags(flows: DataFrame, beacons: DataFrame) -> DataFrame:
    """Tag flows: beaconing pair, long lived, unanswered SYN; with risk and techniques."""
    keys = ["src_ip", "dst_ip", "dst_port"]
    b = beacons.filter("is_beaconing").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_b", F.lit(True))
    j = flows.join(b, (F.col("src_ip") == F.col("_src_ip")) & (F.col("dst_ip") == F.col("_dst_ip")) & F.col("dst_port").eqNullSafe(F.col("_dst_port")), "left").drop(*[f"_{k}" for k in keys])
    beacon = F.coalesce("_b", F.lit(False))
    long_lived = F.col("end_ts") - F.col("start_ts") >= 300
    syn = (F.col("protocol") == "TCP") & (F.col("syn_count") > 0) & (F.col("ack_count") == 0)
    return j.withColumns({
        "behavioral_tags": tags((beacon, "PERIODIC_BEACONING"), (long_lived, "LONG_LIVED_SESSION"),
                                (syn, "UNACKNOWLEDGED_SYN")),
        "mitre_techniques": tags((beacon, "T1071"), (syn, "T1046")),
        "risk_level": choose((beacon, "HIGH"), (syn | long_lived, "MEDIUM"), default="LOW")}).drop("_b")


# Well-known ports.
PORT_PROTOCOL = {80: "HTTP", 443: "HTTPS/TLS", 53: "DNS", 22: "SSH", 21: "FTP", 25: "SMTP", 3389: "RDP", 445: "SMB"}


def port_protocols(flows: DataFrame) -> DataFrame:
    """Flows per well-known destination port. The eight-row lookup is a literal map, not a join."""
    lookup = F.create_map(*[F.lit(x) for kv in PORT_PROTOCOL.items() for x in kv])
    return (flows.filter(F.col("dst_port").isin(*PORT_PROTOCOL)).groupBy("dst_port").agg(F.count("*").alias("flow_count"))
            .withColumn("protocol_name", lookup[F.col("dst_port")]))


def split_by_gap(df: DataFrame, keys: list[str], ts: str, order: list[str], gap_seconds: float,
                 segment_seconds: int) -> DataFrame:
    """Number the bursts of each key: a new one starts after an idle gap longer than ``gap_seconds``."""
    rows = df.withColumn("_seg", F.floor(F.col(ts) / segment_seconds))
    rows = segmented_lag(rows, keys, "_seg", order, {"_prev": ts})
    new = (F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") > gap_seconds)).cast("bigint")
    rows = segmented_running(rows.withColumn("_new", new), keys, "_seg", order, {"session_no": ("sum", "_new")},
                             inclusive=True)
    return rows.drop("_seg", "_prev", "_new")


