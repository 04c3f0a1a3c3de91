"""Deduplication, ordering audits, capture quality, profiling, leakage and input validation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import choose, count_when, div, r
from packetloom.functions.ordered import segmented_lag, segmented_running

SEGMENT_ROWS = 65536
FINGERPRINT = ("ts", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "packet_length", "tcp_seq")


def _index_segment(df: DataFrame, rows: int) -> DataFrame:
    return df.withColumn("_seg", F.floor(F.col("packet_index") / rows))


def flag_duplicates(packets: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mark later copies of a packet with the index of the first one (unbounded memory)."""
    keyed = _index_segment(packets, segment_rows).withColumn(
        "_fp", F.sha2(F.to_json(F.struct(*FINGERPRINT), {"ignoreNullFields": "false"}), 256))
    out = segmented_running(keyed, ["capture_id", "_fp"], "_seg", ["packet_index"],
                            {"duplicate_of_index": ("min", "packet_index")})
    return out.drop("_fp", "_seg")


def timestamp_order_audit(packets: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per capture: backward steps, equal neighbours and whether any reordering was seen."""
    rows = segmented_lag(_index_segment(packets, segment_rows), ["capture_id"], "_seg", ["packet_index"],
                         {"_prev_ts": "ts"})
    back = count_when(F.col("ts") < F.col("_prev_ts"))
    return rows.groupBy("capture_id").agg(
        F.count("*").alias("packets"), back.alias("timestamp_anomalies"),
        count_when(F.col("ts") == F.col("_prev_ts")).alias("timestamp_equal_count"),
        (back > 0).alias("timestamps_reordered"))


def flag_retransmissions(packets: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """TCP payload packets whose sequence starts before the highest byte already sent are repeats."""
    is_payload = (F.col("protocol") == "TCP") & (F.coalesce(F.col("payload_length"), F.lit(0)) > 0)
    seq = F.coalesce(F.col("tcp_seq"), F.lit(0))
    is_payload = F.coalesce(is_payload, F.lit(False))
    # only packets that can repeat are shuffled; all others pass straight through
    keyed = _index_segment(packets.filter(is_payload), segment_rows).withColumns({
        "_flow": F.concat_ws("|", "src_ip", F.coalesce("src_port", F.lit(-1)), "dst_ip", F.coalesce("dst_port", F.lit(-1))),
        "_end": seq + F.col("payload_length")})
    out = segmented_running(keyed, ["capture_id", "_flow"], "_seg", ["packet_index"],
                            {"_high": ("max", "_end")})
    flag = F.coalesce(seq < F.col("_high"), F.lit(False))
    out = out.withColumn("is_retransmission", flag).drop("_flow", "_end", "_high", "_seg")
    return out.unionByName(packets.filter(~is_payload).withColumn("is_retransmission", F.lit(False)))


def capture_quality(packets: DataFrame, duplicates: DataFrame | None = None, order: DataFrame | None = None,
                    flows: DataFrame | None = None) -> DataFrame:
    """One row of counters per capture with the GOOD / DEGRADED / INSUFFICIENT verdict.

    ``duplicates`` is the output of :func:`flag_duplicates`, ``order`` of
    :func:`timestamp_order_audit` and ``flows`` of ``build_flows``; each adds its own counter.
    """
    p = duplicates if duplicates is not None else packets.withColumn("duplicate_of_index",
                                                                     F.lit(None).cast("bigint"))
    status = F.col("parsing_status")
    frag = (F.coalesce("fragment_offset", F.lit(0)) > 0) if "fragment_offset" in p.columns else F.lit(False)
    frag = frag | F.coalesce(F.col("more_fragments"), F.lit(False))
    q = p.groupBy("capture_id").agg(
        F.count("*").alias("total_packets_observed"),
        count_when(status != "malformed").alias("parsed_packets"),
        count_when(status == "malformed").alias("malformed_packets"),
        count_when(status == "unsupported").alias("unsupported_packets"),
        count_when(F.col("truncation_status") == "TRUE").alias("truncated_packets"),
        count_when(F.col("truncation_status") == "UNKNOWN").alias("truncation_unknown_count"),
        count_when(F.col("duplicate_of_index").isNotNull()).alias("duplicate_packets"),
        count_when(F.col("ip_version") == 4).alias("ipv4_count"),
        count_when(F.col("ip_version") == 6).alias("ipv6_count"),
        count_when(F.col("protocol") == "TCP").alias("tcp_count"),
        count_when(F.col("protocol") == "UDP").alias("udp_count"),
        count_when(F.col("protocol").isin("ICMP", "ICMPv6")).alias("icmp_count"),
        count_when(F.col("protocol") == "ARP").alias("arp_count"),
        count_when(F.col("vlan_id").isNotNull()).alias("vlan_count"),
        count_when(frag).alias("fragmented_packet_count"))
    if order is not None:
        q = q.join(order.drop("packets"), "capture_id", "left")
    else:
        q = q.withColumns({"timestamp_anomalies": F.lit(0).cast("bigint"),
                           "timestamp_equal_count": F.lit(0).cast("bigint"),
                           "timestamps_reordered": F.lit(False)})
    if flows is not None:
        part = flows.groupBy("capture_id").agg(count_when(
            (F.col("protocol") == "TCP") & (F.col("completeness") != "COMPLETE")).alias("incomplete_flow_count"))
        q = q.join(part, "capture_id", "left")
    else:
        q = q.withColumn("incomplete_flow_count", F.lit(0).cast("bigint"))
    defects = sum((F.coalesce(F.col(n), F.lit(0)) for n in (
        "malformed_packets", "unsupported_packets", "truncated_packets", "timestamp_anomalies", "duplicate_packets",
        "fragmented_packet_count", "incomplete_flow_count", "truncation_unknown_count")), F.lit(0))
    return q.withColumns({
        "status": choose((F.col("parsed_packets") < 2, "INSUFFICIENT"), (defects > 0, "DEGRADED"), default="GOOD"),
        "duplicate_ratio": F.col("duplicate_packets") / F.greatest("total_packets_observed", F.lit(1))})


def data_quality_gate(windows: DataFrame, quality: DataFrame, required_windows: int = 8,
                      max_gap_seconds: float = 120.0, features: Sequence[str] = ()) -> DataFrame:
    """Seven checks per capture, one row each, with overall status, score and forecast eligibility.

    ``windows``: one row per window (capture_id, window_start, window_end, packet_count, flow_count
    and the numeric ``features``).
    """
    w = Window.partitionBy("capture_id").orderBy("window_start")
    gap = F.col("window_start") - F.lag("window_end").over(w)
    bad = [~F.coalesce(F.col(f).between(float("-1.7e308"), float("1.7e308")), F.lit(True)) | F.isnan(F.col(f))
           for f in features]
    any_bad = bad[0] if bad else F.lit(False)
    for b in bad[1:]:
        any_bad = any_bad | b
    per = windows.withColumns({"_gap": gap, "_bad": F.coalesce(any_bad, F.lit(False))}).groupBy("capture_id").agg(
        F.count("*").alias("n"), F.sum("packet_count").alias("packets"), F.sum("flow_count").alias("flows"),
        F.max("_gap").alias("gap"), F.bool_or("_bad").alias("nonfinite"))
    q = per.join(quality, "capture_id")
    broken = F.col("malformed_packets") + F.col("truncated_packets")
    ratio = F.when(F.col("packets") > 0, broken / F.col("packets"))
    transport = F.col("tcp_count") + F.col("udp_count")
    arp_only = (F.col("packets") > 0) & (transport == 0) & (F.col("arp_count") > 0)
    no_tcp = (F.col("packets") > 0) & (transport == 0)
    part = F.when(F.col("flows") > 0, F.col("incomplete_flow_count") / F.col("flows"))
    gap_over = F.coalesce(F.col("gap") > max_gap_seconds, F.lit(False))
    gap_some = F.coalesce(F.col("gap") > 0, F.lit(False))

    def check(name: str, status: Column, score: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), status.alias("check_status"),
                        score.cast("double").alias("score"))
    checks = F.array(
        check("packet_integrity",
              choose((ratio > 0.30, "INSUFFICIENT"), (ratio > 0.05, "DEGRADED"),
                     (ratio.isNull() & (F.col("malformed_packets") > 0), "INSUFFICIENT"), default="GOOD"),
              F.coalesce(F.greatest(F.lit(0.0), 1.0 - ratio), F.lit(1.0))),
        check("timestamp_availability", choose((F.col("timestamps_reordered"), "DEGRADED"), default="GOOD"),
              choose((F.col("timestamps_reordered"), 0.85), default=1.0)),
        check("temporal_continuity", choose((gap_over, "INSUFFICIENT"), (gap_some, "DEGRADED"), default="GOOD"),
              choose((gap_over, 0.0), (gap_some, 0.7), default=1.0)),
        check("window_coverage", choose((F.col("n") >= required_windows, "GOOD"), default="INSUFFICIENT"),
              F.least(F.lit(1.0), F.col("n") / float(required_windows))),
        check("protocol_observability", choose((arp_only, "INSUFFICIENT"), (no_tcp, "DEGRADED"), default="GOOD"),
              choose((arp_only, 0.1), (no_tcp, 0.4), default=1.0)),
        check("flow_reconstruction_quality",
              choose((part.isNull() & (F.col("packets") > 0) & ~arp_only, "DEGRADED"),
                     ((part > 0.8) & (F.col("flows") > 20), "DEGRADED"), default="GOOD"),
              choose((part.isNotNull(), F.greatest(F.lit(0.0), 1.0 - part * 0.5)),
                     ((F.col("packets") > 0) & ~arp_only, 0.5), default=1.0)),
        check("required_feature_availability", choose((F.col("nonfinite"), "INSUFFICIENT"), default="GOOD"),
              choose((F.col("nonfinite"), 0.0), default=1.0)))
    q = q.select("capture_id", checks.alias("checks"))
    has = lambda s: F.exists("checks", lambda x: x["check_status"] == s)
    overall = choose((has("INSUFFICIENT"), "INSUFFICIENT"), (has("DEGRADED"), "DEGRADED"), default="GOOD")
    score = F.aggregate("checks", F.lit(0.0), lambda acc, x: acc + x["score"]) / 7.0
    q = q.withColumns({"overall_status": overall, "quality_score": score,
                       "forecast_eligible": overall != "INSUFFICIENT"})
    return q.select("capture_id", "overall_status", "quality_score", "forecast_eligible",
                    F.explode("checks").alias("_c")).select(
        "capture_id", "overall_status", "quality_score", "forecast_eligible", "_c.*")


def dataset_profile(df: DataFrame, label: str | None = None, ts: str | None = None) -> DataFrame:
    """Missing cells per column, exact duplicate rows by digest, label histogram, time range.

    Long form ``(metric, item, value)`` so any table fits one schema.
    """
    cols = df.columns
    missing = [count_when(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == "")).alias(n) for n in cols]
    one = df.agg(*missing, F.count("*").alias("_rows"))
    out = one.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("metric"), F.lit("").alias("item"), F.col("_rows").cast("double").alias("value")),
        *[F.struct(F.lit("missing").alias("metric"), F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
          for n in cols])).alias("_x")).select("_x.*")
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    dup = df.groupBy(digest.alias("_d")).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("double").alias("value"))
    out = out.unionByName(dup.select(F.lit("duplicate_rows").alias("metric"), F.lit("").alias("item"), "value"))
    if label:
        hist = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("<missing>")).alias("item")).agg(
            F.count("*").cast("double").alias("value"))
        out = out.unionByName(hist.select(F.lit("label").alias("metric"), "item", "value"))
    if ts:
        span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(F.explode(F.array(
            F.struct(F.lit("ts_min").alias("item"), F.col("a").cast("double").alias("value")),
            F.struct(F.lit("ts_max").alias("item"), F.col("b").cast("double").alias("value")))).alias("_x"))
        out = out.unionByName(span.select(F.lit("timestamp").alias("metric"), "_x.*"))
    return out


def adjacent_duplicates(df: DataFrame, row_id: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """How many rows repeat the row just before them in file order (``row_id``)."""
    body = [n for n in df.columns if n != row_id]
    rows = df.select(F.lit("f").alias("_k"), F.col(row_id).alias("_o"), F.floor(F.col(row_id) / segment_rows).alias("_seg"),
                     F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256).alias("_d"))
    rows = segmented_lag(rows, ["_k"], "_seg", ["_o"], {"_p": "_d"})
    return rows.agg(F.count("*").alias("rows"), count_when(F.col("_d") == F.col("_p")).alias("adjacent_duplicate_rows"))


def parquet_profile(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Per numeric column: null count and ratio, range, whether it is constant."""
    ok = {n: F.when(F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in numeric}
    aggs = [F.count("*").alias("_rows")]
    for n in numeric:
        aggs += [F.count(F.col(n)).alias(f"n_{n}"), F.min(ok[n]).alias(f"a_{n}"), F.max(ok[n]).alias(f"b_{n}")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("column_name"), (F.col("_rows") - F.col(f"n_{n}")).alias("null_count"),
        div(F.col("_rows") - F.col(f"n_{n}"), F.col("_rows"), 0.0).alias("null_ratio"),
        F.col(f"a_{n}").alias("min_value"), F.col(f"b_{n}").alias("max_value"),
        F.coalesce(F.col(f"a_{n}") == F.col(f"b_{n}"), F.lit(True)).alias("is_constant"))
        for n in numeric])).alias("_x")).select("_x.*")


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Lower-case names, runs of other characters to ``_``, repeats numbered ``_2``, ``_3``, …"""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        base = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def normalize_label(label: Column | str) -> Column:
    col = F.col(label) if isinstance(label, str) else label
    return F.upper(F.trim(F.regexp_replace(col, r"\s+", " ")))


# Dataset label -> attack stage.
STAGE_OF_LABEL = {
    "UNSW-NB15": {
        "BENIGN": "BENIGN", "NORMAL": "BENIGN", "RECONNAISSANCE": "RECONNAISSANCE", "FUZZERS": "RECONNAISSANCE",
        "ANALYSIS": "RECONNAISSANCE", "EXPLOITS": "INITIAL_ACCESS", "BACKDOOR": "COMMAND_AND_CONTROL",
        "DOS": "IMPACT", "SHELLCODE": "EXECUTION", "WORMS": "LATERAL_MOVEMENT", "GENERIC": "UNKNOWN",
        "ATTACK_UNSPECIFIED": "UNKNOWN"},
    "CIC-IDS2017": {
        "BENIGN": "BENIGN", "PORTSCAN": "RECONNAISSANCE", "DDOS": "IMPACT", "DOS SLOWLORIS": "IMPACT",
        "DOS SLOWHTTPTEST": "IMPACT", "DOS HULK": "IMPACT", "DOS GOLDENEYE": "IMPACT", "HEARTBLEED": "IMPACT",
        "BOT": "COMMAND_AND_CONTROL", "INFILTRATION": "INITIAL_ACCESS", "FTP-PATATOR": "CREDENTIAL_ACCESS",
        "SSH-PATATOR": "CREDENTIAL_ACCESS", "WEB ATTACK BRUTE FORCE": "CREDENTIAL_ACCESS",
        "WEB ATTACK XSS": "INITIAL_ACCESS", "WEB ATTACK SQL INJECTION": "INITIAL_ACCESS"},
    "TON-IOT": {
        "BENIGN": "BENIGN", "NORMAL": "BENIGN", "SCANNING": "RECONNAISSANCE", "DOS": "IMPACT", "DDOS": "IMPACT",
        "PASSWORD": "CREDENTIAL_ACCESS", "XSS": "INITIAL_ACCESS", "INJECTION": "INITIAL_ACCESS",
        "BACKDOOR": "COMMAND_AND_CONTROL", "MITM": "DEFENSE_EVASION", "RANSOMWARE": "IMPACT"},
}


def map_stage(df: DataFrame, dataset: str, label: str) -> DataFrame:
    """Add ``stage`` by looking (dataset, label) up in :data:`STAGE_OF_LABEL`; unknown labels give UNKNOWN."""
    rows = [(d, k, v) for d, m in STAGE_OF_LABEL.items() for k, v in m.items()]
    lookup = df.sparkSession.createDataFrame(rows, "_ds string, _lb string, stage string")
    out = df.withColumns({"_ds": F.upper(F.trim(F.col(dataset))), "_lb": normalize_label(label)})
    return (out.join(F.broadcast(lookup), ["_ds", "_lb"], "left").drop("_ds", "_lb")
            .withColumn("stage", F.coalesce("stage", F.lit("UNKNOWN"))))


def sample_validation(df: DataFrame, row_id: str, ts: str, label: str, family: str,
                      segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Monotonic time, label counts and sorted families of an evaluation sample table."""
    rows = df.select(F.lit("s").alias("_k"), F.floor(F.col(row_id) / segment_rows).alias("_seg"),
                     row_id, ts, label, family)
    rows = segmented_lag(rows, ["_k"], "_seg", [row_id], {"_p": ts})
    return rows.agg(
        F.count("*").alias("sample_count"),
        F.coalesce(~F.bool_or(F.col(ts) < F.col("_p")), F.lit(True)).alias("is_chronologically_monotonic"),
        F.min(ts).alias("min_timestamp"), F.max(ts).alias("max_timestamp"),
        count_when(F.col(label) == 1).alias("positive_count"), count_when(F.col(label) == 0).alias("negative_count"),
        count_when(F.col(label).isNull()).alias("unknown_label_count"),
        F.array_join(F.array_sort(F.collect_set(family)), ",").alias("unique_attack_families"))


def feature_completeness(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of rows with a finite value, per feature."""
    finite = lambda n: count_when(F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")))
    row = df.agg(F.count("*").alias("_rows"), *[finite(n).alias(n) for n in features])
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("feature"), r(F.col(n) / F.col("_rows"), 4).alias("completeness"))
        for n in features])).alias("_x")).select("_x.*")


def feature_status(states: DataFrame, features: Sequence[str], order: str = "bucket") -> DataFrame:
    """Per capture and feature: available in every window (the first is excluded if there are more)."""
    first = F.min(order).over(Window.partitionBy("capture_id"))
    n = F.count("*").over(Window.partitionBy("capture_id"))
    body = states.withColumns({"_first": first, "_n": n}).filter((F.col(order) > F.col("_first")) | (F.col("_n") == 1))
    row = body.groupBy("capture_id").agg(*[F.bool_and(F.col(f).isNotNull()).alias(f) for f in features])
    ready = F.lit(True)
    for f in features:
        ready = ready & F.col(f)
    return row.select("capture_id", ready.alias("model_ready"), F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.when(F.col(f), "AVAILABLE").otherwise("UNAVAILABLE").alias("availability"))
        for f in features])).alias("_x")).select("capture_id", "model_ready", "_x.*")


# Provenance class of well-known field names.
FIELD_CLASS = {
    "OBSERVED": (
        "packet_count", "byte_count", "bytes", "total_bytes", "total_src_bytes", "total_dst_bytes", "tcp_syn_count",
        "tcp_ack_count", "tcp_fin_count", "tcp_rst_count", "tcp_psh_count", "tcp_urg_count", "packet_length",
        "payload_length", "duration_seconds", "packet_timestamp_span_seconds", "temporal_window_coverage_seconds",
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_version", "ttl", "tcp_window", "tcp_seq", "tcp_ack",
        "icmp_type", "icmp_code", "vlan_id", "fragment_offset", "more_fragments", "flow_count"),
    "DERIVED": (
        "packet_rate", "byte_rate", "mean_packet_size", "std_packet_size", "min_packet_size", "max_packet_size",
        "mean_duration", "mean_flow_bytes", "mean_flow_packets", "mean_sttl", "mean_dttl", "mean_swin", "mean_dwin",
        "mean_iat", "std_iat", "max_iat", "delta_flow_count", "delta_total_bytes", "delta_total_packets", "delta_ports",
        "delta_iat", "rolling_total_bytes", "unique_src_ports", "unique_dst_ports", "unique_src_ips", "unique_dst_ips",
        "rate_trend", "churn_trend", "flow_churn", "peer_diversity", "flows", "entropy"),
    "INFERRED": (
        "threat_level", "risk_score", "behavioral_risk", "anomaly_score", "detected_events", "findings",
        "mitre_techniques", "mitre_tactics", "beaconing_signals", "attack_patterns", "campaign_clusters",
        "prioritized_threats", "incident_story", "analyst_decisions", "threat_stories", "observed_stage"),
    "FORECAST": (
        "forecast_points", "attack_probability", "predicted_stage", "forecast_confidence", "attack_horizon",
        "lead_time_seconds", "predicted_state", "forecast_trajectory", "multi_horizon_predictions",
        "transition_probability"),
}


def field_provenance_class(df: DataFrame, field: str) -> DataFrame:
    """Add ``provenance_class`` for the field name in column ``field``."""
    rows = [(n, k) for k, names in FIELD_CLASS.items() for n in names]
    lookup = df.sparkSession.createDataFrame(rows, "_f string, provenance_class string")
    out = df.withColumn("_f", F.lower(F.trim(F.col(field)))).join(F.broadcast(lookup), "_f", "left").drop("_f")
    return out.withColumn("provenance_class", F.coalesce("provenance_class", F.lit("UNKNOWN")))


def timeline_event_class(horizon: Column, observed: Column) -> Column:
    return choose(((horizon == "T0") | observed, "OBSERVED"), (horizon.startswith("T+"), "FORECAST"),
                  default="UNKNOWN")


def feature_provenance_table(stats: DataFrame, packets: DataFrame, features: dict[str, str], seconds: int) -> DataFrame:
    """(window, feature) rows with value, aggregation, contributing packets and their first and last index."""
    b = packets.select("capture_id", F.floor(F.col("ts") / seconds).cast("bigint").alias("bucket"), "packet_index")
    heads = b.groupBy("capture_id", "bucket").agg(F.min("packet_index").alias("first_index"), F.max("packet_index").alias("last_index"))
    rows = stats.select("capture_id", "bucket", F.col("packet_count").alias("contributing_packets"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), F.lit(how).alias("aggregation"))
        for n, how in features.items()])).alias("_x"))
    return rows.select("capture_id", "bucket", "contributing_packets", "_x.*").join(heads, ["capture_id", "bucket"], "left")


LEAK_TOKENS = ("future", "next", "target", "y_")
TARGET_NAMES = ("attack_state", "label", "attack_cat")


def feature_name_leaks(df: DataFrame, name: str) -> DataFrame:
    """Flag feature names equal to a target or holding a token that speaks of the future."""
    n = F.lower(F.col(name))
    future = F.lit(False)
    for t in LEAK_TOKENS:
        future = future | n.contains(t)
    return df.withColumns({"is_target": n.isin(*TARGET_NAMES), "is_future_named": future}).withColumn(
        "passed", ~F.col("is_target") & ~F.col("is_future_named"))


def split_overlap(rows: DataFrame, split: str, key: str) -> DataFrame:
    """Keys present in more than one split, counted per pair of splits (no self join)."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("_s"))
    many = sets.filter(F.size("_s") > 1)
    pairs = F.expr("flatten(transform(_s, (a, i) -> transform(slice(_s, i + 2, size(_s)), b -> concat(a, '_', b))))")
    return many.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("shared_keys"))


def past_only_violations(states: DataFrame, ts: str, order: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    rows = states.select(F.lit("s").alias("_k"), F.floor(F.col(order) / segment_rows).alias("_seg"),
                         F.col(order).alias("_o"), F.col(ts).alias("_t"))
    rows = segmented_lag(rows, ["_k"], "_seg", ["_o"], {"_p": "_t"})
    return rows.agg(F.count("*").alias("rows"), count_when(F.col("_t") < F.col("_p")).alias("violations"))


def history_status(windows: DataFrame, lookback: int = 8) -> DataFrame:
    """Per capture READY / GAPPED_HISTORY / INSUFFICIENT_HISTORY from window contiguity."""
    w = Window.partitionBy("capture_id").orderBy("window_start")
    gap = F.col("window_start") != F.lag("window_end").over(w)
    return windows.withColumn("_gap", gap).groupBy("capture_id").agg(
        F.count("*").alias("windows"), count_when(F.col("_gap")).alias("gaps")).withColumn(
        "history_status", choose((F.col("gaps") > 0, "GAPPED_HISTORY"),
                                 (F.col("windows") < lookback, "INSUFFICIENT_HISTORY"), default="READY"))


def model_input_validate(states: DataFrame, features: Sequence[str], seconds: int, lookback: int = 8) -> DataFrame:
    """First failing rule for the sequence of each capture plus the list of missing features."""
    w = Window.partitionBy("capture_id").orderBy("window_start")
    step = F.col("window_start") - F.lag("window_start").over(w)
    body = states.withColumn("_step", step).groupBy("capture_id").agg(
        F.count("*").alias("windows"), count_when(F.col("_step") != seconds).alias("bad_steps"),
        *[F.bool_or(F.col(f).isNull()).alias(f"_m_{f}") for f in features],
        *[F.bool_or(F.coalesce(F.isnan(F.col(f).cast("double")), F.lit(False))).alias(f"_n_{f}") for f in features])
    missing = F.concat_ws(",", *[F.when(F.col(f"_m_{f}"), f) for f in features])
    nonfinite = F.concat_ws(",", *[F.when(F.col(f"_n_{f}"), f) for f in features])
    return body.select("capture_id", "windows", "bad_steps", missing.alias("missing_features"),
                       choose((F.col("windows") < lookback, "INSUFFICIENT_HISTORY"),
                              (F.col("bad_steps") > 0, "NON_CONTIGUOUS_TIMESTAMPS"),
                              (missing != "", "FEATURE_SCHEMA_MISMATCH"),
                              (nonfinite != "", "INVALID_NUMERIC_VALUE"), default="VALID").alias("verdict"))


def feature_matrix(tables: dict[str, DataFrame], features: Sequence[str]) -> DataFrame:
    """feature x dataset availability: ABSENT, EMPTY or AVAILABLE with the share of filled rows."""
    out = None
    for name, df in tables.items():
        here = [f for f in features if f in df.columns]
        row = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f)).alias(f) for f in here])
        cells = F.array(*[F.struct(
            F.lit(f).alias("feature"),
            (F.col(f) / F.greatest(F.col("_rows"), F.lit(1)) if f in here else F.lit(0.0)).alias("fill_ratio"),
            (choose((F.col(f) > 0, "AVAILABLE"), default="EMPTY") if f in here else F.lit("ABSENT")).alias("availability"))
            for f in features])
        part = row.select(F.lit(name).alias("dataset"), F.explode(cells).alias("_x")).select("dataset", "_x.*")
        out = part if out is None else out.unionByName(part)
    return out


def rank_datasets(scores: DataFrame, dataset: str, score: str) -> DataFrame:
    """Total of the per-criterion scores of each candidate dataset, best first."""
    return scores.groupBy(dataset).agg(F.sum(score).alias("total_score"), F.count("*").alias("criteria"))


def systematic_sample(df: DataFrame, row_no: str, stride: int) -> DataFrame:
    """Every ``stride``-th row of each file. ``row_no`` is the 0-based ordinal in its file."""
    return df.filter(F.col(row_no) % stride == 0)


def reject_reasons(packets: DataFrame) -> Column:
    """Why a raw packet row cannot be used; NULL when it can."""
    return choose(((F.col("ts").isNull()) | F.isnan("ts"), "bad_timestamp"), (F.col("src_ip").isNull(), "no_source"),
                  (F.col("dst_ip").isNull(), "no_destination"), (F.col("protocol").isNull(), "no_protocol"))


