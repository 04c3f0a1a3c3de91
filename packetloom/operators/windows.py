"""Tumbling packet windows: statistics, scan score, peaks, alignment and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import bucket, clip, count_when, div, has_flag, r
from packetloom.functions.ordered import segmented_lag
from packetloom.functions.quantiles import group_quantiles
from packetloom.functions.spans import join_spans, window_sums
from packetloom.session import shared

KEYS = ["capture_id", "bucket"]


def with_bucket(packets: DataFrame, seconds: int = 60, ts: str = "ts") -> DataFrame:
    return packets.withColumn("bucket", bucket(ts, seconds))


def tumbling_windows(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """One row per window that holds a packet, half-open ``[window_start, window_end)``."""
    return with_bucket(packets, seconds).groupBy(*KEYS).agg(
        F.count("*").alias("packet_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumns({
            "window_start": F.col("bucket") * seconds, "window_end": (F.col("bucket") + 1) * seconds})


def flow_buckets(flows: DataFrame, seconds: int, occupied: DataFrame | None = None) -> DataFrame:
    """One row per (flow, window it overlaps); ``occupied`` restricts to the windows listed there.

    A flow meets the listed windows by the blocks of its span, so what it costs follows the rows that come out, not its
    duration. Without ``occupied`` it is the covered windows that are listed, which grow with time, not with traffic. Sums
    over windows need no such rows: see ``flow_window_totals``.
    """
    keys = [k for k in KEYS if k in flows.columns and k != "bucket"]
    spans = flows.withColumns({"_first": bucket("start_ts", seconds), "_last": bucket("end_ts", seconds)})
    if occupied is None:
        occupied = covered_windows(spans.select(*keys, "_first", "_last"), keys)
    out = join_spans(occupied.select(*keys, "bucket").distinct(), spans, keys, "bucket", "_first", "_last")
    return out.select(*flows.columns, "bucket")


def covered_windows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bucket`` of every window in at least one span ``_first .. _last``: overlapping and touching spans are merged before they are listed."""
    edges = spans.filter("_first <= _last").select(*keys, F.explode(F.array(F.struct(F.col("_first").alias("bucket"), F.lit(1).alias("_d")), F.struct((F.col("_last") + 1).alias("bucket"), F.lit(-1).alias("_d")))).alias("_e"))
    steps = edges.groupBy(*keys, "_e.bucket").agg(F.sum("_e._d").alias("_d"))
    # one row per window of time with a start or an end
    upto = Window.partitionBy(*keys, F.lit(0)).orderBy("bucket")
    live = steps.withColumns({"_live": F.sum("_d").over(upto), "_next": F.lead("bucket").over(upto)}).filter("_live > 0")
    return live.select(*keys, F.explode(F.sequence(F.col("bucket"), F.col("_next") - 1)).alias("bucket"))


def flow_window_totals(flows: DataFrame, seconds: int, occupied: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per listed window the sums of ``sums`` over the flows that overlap it; no row per (flow, window) is made."""
    keys = [k for k in KEYS if k in flows.columns and k != "bucket"]
    spans = flows.withColumns({"_first": bucket("start_ts", seconds), "_last": bucket("end_ts", seconds)})
    return window_sums(spans, occupied, keys, "bucket", "_first", "_last", sums)


def interarrival(packets: DataFrame, seconds: int) -> DataFrame:
    """Add ``iat``, the gap to the previous packet of the same window."""
    sub = max(1, seconds // 60)
    rows = with_bucket(packets, seconds).withColumn("_sub", F.floor(F.col("ts") / sub))
    rows = segmented_lag(rows, KEYS, "_sub", ["ts", "packet_index"], {"_prev": "ts"})
    return rows.withColumn("iat", F.col("ts") - F.col("_prev")).drop("_prev", "_sub")


def port_scan_score(ports: Column, syn: Column, dsts: Column, responses: Column) -> Column:
    quiet = 1.0 - F.least(responses / F.greatest(syn, F.lit(1)), F.lit(1.0))
    return F.least(F.lit(1.0), 0.4 * F.least(ports / 100.0, F.lit(1.0)) + 0.3 * F.least(syn / 100.0, F.lit(1.0))
                   + 0.2 * F.least(dsts / 25.0, F.lit(1.0)) + 0.1 * quiet)


def adjusted_skewness(col: Column) -> Column:
    """Fisher-Pearson adjusted skewness; 0 below three values or without spread."""
    n = F.count(col).cast("double")
    return F.when((n < 3) | (F.var_pop(col) < 1e-12), 0.0).otherwise(
        F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def packet_rate_peak(packets: DataFrame, seconds: int) -> DataFrame:
    """Most packets in any one-second bin of each window."""
    per_second = with_bucket(packets, seconds).groupBy(*KEYS, F.floor("ts").alias("_s")).agg(F.count("*").alias("_n"))
    return per_second.groupBy(*KEYS).agg(F.max("_n").cast("double").alias("packet_rate_peak"))


def protocol_counts(packets: DataFrame, seconds: int) -> DataFrame:
    """Map of packets per protocol per window (a protocol field has at most 256 values)."""
    per = (with_bucket(packets, seconds).filter("protocol IS NOT NULL").groupBy(*KEYS, "protocol")
           .agg(F.count("*").alias("_n")))
    return per.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "_n"))))
                                  .alias("protocol_counts"))


def base_stats(rows: DataFrame, with_iat: bool = True) -> DataFrame:
    """Mergeable aggregates of bucketed packets: one shuffle with map-side combining."""
    size, pay, flags = F.col("packet_length"), F.col("payload_length"), F.col("tcp_flags")
    tcp = F.col("protocol") == "TCP"
    frag = F.coalesce(F.col("more_fragments"), F.lit(False))
    if "fragment_offset" in rows.columns:
        frag = frag | (F.coalesce(F.col("fragment_offset"), F.lit(0)) > 0)
    n = F.count("*")
    span = F.max("ts") - F.min("ts")
    aggs = [n.alias("packet_count")]
    for name, col in (("ttl", F.col("ttl")), ("tcp_window", F.col("tcp_window")), ("packet_size", size)):
        aggs += [F.avg(col).alias(f"{name}_mean"), F.var_pop(col).alias(f"{name}_variance"),
                 F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max")]
    aggs += [F.avg(pay).alias("payload_mean"), F.var_pop(pay).alias("payload_variance"),
             div(count_when(pay == 0), F.count(pay)).alias("payload_zero_ratio"),
             # lengths are 16-bit on the wire, so these buffers hold at most 65,536 distinct values
             F.percentile(size, F.lit(0.5)).alias("packet_size_median"),
             F.percentile(size, F.lit(0.95)).alias("packet_size_p95"),
             F.percentile(pay, F.lit(0.5)).alias("payload_median"), F.percentile(pay, F.lit(0.95)).alias("payload_p95"),
             adjusted_skewness(size.cast("double")).alias("packet_size_skewness"),
             F.avg(F.when(tcp, pay)).alias("mean_tcp_payload_size"), F.max(F.when(tcp, pay)).alias("max_tcp_payload_size"),
             (F.sum(pay) / F.when(span > 0, span).otherwise(60.0)).alias("payload_rate_bytes_sec")]
    if with_iat:
        iat = F.col("iat")
        aggs += [F.avg(iat).alias("iat_mean"), F.var_pop(iat).alias("iat_variance"), F.min(iat).alias("iat_min"),
                 F.max(iat).alias("iat_max")]
    for name, mask in (("syn", 0x02), ("ack", 0x10), ("fin", 0x01), ("rst", 0x04), ("psh", 0x08), ("urg", 0x20),
                       ("cwr", 0x80), ("ece", 0x40)):
        aggs.append(count_when(has_flag(flags, mask)).alias(f"{name}_count"))
    aggs += [count_when(has_flag(flags, 0x02) & ~has_flag(flags, 0x10)).alias("syn_attempts"),
             count_when(has_flag(flags, 0x12)).alias("responses"),
             count_when(frag).alias("fragment_count"), (count_when(frag) / n).alias("fragment_ratio"),
             count_when(tcp).alias("tcp_count"), count_when(F.col("protocol") == "UDP").alias("udp_count"),
             count_when(F.col("protocol") == "ICMP").alias("icmp_count"),
             (count_when(F.col("protocol") == "UDP") / n).alias("udp_packet_ratio"),
             (count_when(F.col("protocol") == "ICMP") / n).alias("icmp_packet_ratio"),
             count_when(tcp & (F.col("tcp_window") == 0)).alias("tcp_window_zero_count"),
             count_when(tcp & (pay > 0)).alias("tcp_with_payload")]
    if "is_retransmission" in rows.columns:
        aggs += [count_when(F.col("is_retransmission")).alias("tcp_retransmission_count"),
                 (count_when(F.col("is_retransmission")) / F.greatest(count_when(tcp & (pay > 0)), F.lit(1)))
                 .alias("tcp_retransmission_rate")]
    return rows.groupBy(*KEYS).agg(*aggs)


def distinct_endpoints(rows: DataFrame) -> DataFrame:
    """Distinct sources, destinations and destination ports per window, in one pass.

    Every (window, kind, value) is reduced to one row before the count, so a hot window is spread
    over its values.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("v"))
                      for k in ("src_ip", "dst_ip", "dst_port")])
    one = (rows.select(*KEYS, "src_ip", "dst_ip", "dst_port").distinct()
           .select(*KEYS, F.explode(kinds).alias("_x")).select(*KEYS, "_x.*").filter("v IS NOT NULL").distinct())
    return one.groupBy(*KEYS).agg(count_when(F.col("kind") == "src_ip").alias("unique_src_ips"),
                                  count_when(F.col("kind") == "dst_ip").alias("unique_dst_ips"),
                                  count_when(F.col("kind") == "dst_port").alias("unique_dst_ports"))


def scan_windows(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """The window columns the risk rules need: no inter-arrival times, no quantiles, one row per window."""
    rows = with_bucket(packets, seconds)
    flags, tcp = F.col("tcp_flags"), F.col("protocol") == "TCP"
    frag = F.coalesce(F.col("more_fragments"), F.lit(False))
    base = rows.groupBy(*KEYS).agg(
        F.count("*").alias("packet_count"), count_when(has_flag(flags, 0x02)).alias("syn_count"),
        count_when(has_flag(flags, 0x02) & ~has_flag(flags, 0x10)).alias("syn_attempts"),
        count_when(has_flag(flags, 0x12)).alias("responses"),
        (count_when(frag) / F.count("*")).alias("fragment_ratio"),
        (count_when(F.col("is_retransmission")) / F.greatest(count_when(tcp & (F.col("payload_length") > 0)), F.lit(1)))
        .alias("tcp_retransmission_rate"))
    return base.join(distinct_endpoints(rows), KEYS).withColumns({
        "port_scan_score": port_scan_score(F.col("unique_dst_ports"), F.col("syn_attempts"), F.col("unique_dst_ips"),
                                           F.col("responses")),
        "window_start": F.col("bucket") * seconds})


def packet_window_stats(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """The full statistics row of every window, about fifty columns."""
    need = [x for x in ("ts", "packet_index", "src_ip", "dst_ip", "dst_port", "protocol", "packet_length", "payload_length", "tcp_flags", "ttl", "tcp_window", "more_fragments",
                        "fragment_offset", "is_retransmission") if x in packets.columns]
    rows = shared(interarrival(packets.select("capture_id", *need), seconds))  # four branches read it
    out = (base_stats(rows).join(distinct_endpoints(rows), KEYS)
           .join(group_quantiles(rows, KEYS, "iat", {"iat_median": 0.5, "iat_p95": 0.95}), KEYS, "left")
           .join(packet_rate_peak(rows, seconds), KEYS, "left"))
    return out.withColumns({
        "port_scan_score": port_scan_score(F.col("unique_dst_ports"), F.col("syn_attempts"), F.col("unique_dst_ips"),
                                           F.col("responses")),
        "window_start": F.col("bucket") * seconds, "window_end": (F.col("bucket") + 1) * seconds})


def traffic_summary(stats: DataFrame) -> DataFrame:
    names = ("packet_count", "tcp_count", "udp_count", "icmp_count", "syn_count", "ack_count", "fin_count", "rst_count",
             "psh_count", "urg_count", "fragment_count", "tcp_retransmission_count")
    return stats.groupBy("capture_id").agg(F.count("*").alias("windows"), *[F.sum(n).alias(n) for n in names])


def merged_protocols(counts: DataFrame) -> DataFrame:
    """Sum the per-window protocol maps over a capture."""
    return (counts.select("capture_id", F.explode("protocol_counts").alias("protocol", "n"))
            .groupBy("capture_id", "protocol").agg(F.sum("n").alias("packets")))


def align_windows(left: DataFrame, right: DataFrame) -> DataFrame:
    """How far two streams cover the same windows (``bucket``)."""
    a = left.select("bucket").distinct().withColumn("_a", F.lit(1))
    b = right.select("bucket").distinct().withColumn("_b", F.lit(1))
    j = a.join(b, "bucket", "full_outer")
    both = count_when(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(F.count("_a").alias("total_flow_windows"), F.count("_b").alias("total_packet_windows"),
                 both.alias("matched_windows"), count_when(F.col("_b").isNull()).alias("unmatched_flow_windows"),
                 count_when(F.col("_a").isNull()).alias("unmatched_packet_windows"),
                 (both / F.greatest(F.count("*"), F.lit(1))).alias("alignment_coverage"),
                 (both / F.greatest(F.count("_a"), F.lit(1))).alias("match_rate_by_window"))


def window_risk(stats: DataFrame) -> DataFrame:
    """Additive risk of a window, the rules that fired and the severity band."""
    n = F.greatest("packet_count", F.lit(1)).cast("double")
    scan = clip(F.coalesce("port_scan_score", F.lit(0.0)), 0.0, 1.0)
    retr = clip(F.coalesce("tcp_retransmission_rate", F.lit(0.0)) / 0.10, 0.0, 1.0)
    frag = clip(F.coalesce("fragment_ratio", F.lit(0.0)) / 0.05, 0.0, 1.0)
    syn = clip(F.coalesce("syn_count", F.lit(0)) / (n * 0.50), 0.0, 1.0)

    def rule(score: Column, rule_id: str, kind: str, metric: str, value: Column, limit: Column) -> Column:
        return F.when(score >= 0.5, F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("type"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"), limit.cast("double").alias("threshold")))
    evidence = F.array_compact(F.array(
        rule(scan, "PORT_SCAN_SCORE_HIGH", "port_scan_indicator", "port_scan_score", scan, F.lit(0.5)),
        rule(retr, "TCP_RETRANSMISSION_RATE_HIGH", "retransmission_indicator", "tcp_retransmission_rate",
             F.col("tcp_retransmission_rate"), F.lit(0.05)),
        rule(frag, "FRAGMENTATION_RATIO_HIGH", "fragmentation_indicator", "fragment_ratio", F.col("fragment_ratio"),
             F.lit(0.025)),
        rule(syn, "SYN_PRESSURE_HIGH", "syn_pressure_indicator", "syn_count", F.col("syn_count"), n * 0.5)))
    risk = r(100.0 * (0.55 * scan + 0.20 * retr + 0.10 * frag + 0.15 * syn), 2)
    return stats.withColumns({"risk_score": risk, "evidence": evidence}).withColumn(
        "severity", severity_band(F.col("risk_score")))


def severity_band(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 25, "medium").otherwise("low")


def top_talkers(packets: DataFrame, seconds: int) -> DataFrame:
    """The source that sent most packets in each window (ties: smallest address)."""
    per = with_bucket(packets, seconds).groupBy(*KEYS, "src_ip").agg(F.count("*").alias("_n"))
    return per.groupBy(*KEYS).agg(F.min_by("src_ip", F.struct((-F.col("_n")).alias("n"), F.col("src_ip")))
                                  .alias("top_talker"))


def findings(risk: DataFrame, talkers: DataFrame | None = None) -> DataFrame:
    """Windows with evidence. ``talkers`` attributes each finding to its window's top talker."""
    out = risk.filter(F.size("evidence") > 0).select(
        *KEYS, "window_start", "risk_score", "severity", "evidence",
        F.when(F.exists("evidence", lambda e: e["type"] == "port_scan_indicator"), "network_reconnaissance")
        .otherwise("traffic_anomaly").alias("attack_category"),
        F.concat(F.lit("window-"), F.col("bucket")).alias("finding_id"))
    if talkers is not None:
        out = out.join(talkers.withColumnRenamed("top_talker", "src_ip"), KEYS, "left")
    return out


def detection_summary(risk: DataFrame) -> DataFrame:
    return risk.groupBy("capture_id").agg(
        F.count("*").alias("windows_analyzed"), count_when(F.size("evidence") > 0).alias("detected_events"),
        r(F.max("risk_score"), 2).alias("risk_score"), r(F.avg("risk_score"), 2).alias("average_window_risk"),
        severity_band(F.max("risk_score")).alias("threat_level"))
