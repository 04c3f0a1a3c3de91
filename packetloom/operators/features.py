"""Window features from flows: change-point sums, deltas, rolling and causal features.

A flow stays listed in every window from its first to its last packet and shows its *running* totals
there. Writing that out gives one row per (flow, window), which explodes for long-lived flows. Every
additive feature is computed from change points instead: each flow adds the growth of its totals at
the windows where it has packets and takes them back after its last window; one running sum over
windows restores the same numbers from packets-many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import bucket, choose, count_when
from packetloom.functions.ordered import segmented_lag
from packetloom.operators.flows import FLOW_KEY, endpoint_key
from packetloom.session import shared

W = Window


def flow_prefix_points(packets: DataFrame, seconds: int) -> DataFrame:
    """Per (flow, window with packets): the flow's running totals up to the window's end."""
    p = endpoint_key(packets).withColumn("bucket", bucket("ts", seconds))
    # microseconds, packet index and direction in one number: its minimum has a fixed-size buffer, a struct's has not
    first = F.expr("cast(round(ts * 1000000) as decimal(18,0)) * 10000000000000000000BD + cast(coalesce(packet_index, 0) as decimal(18,0)) * 10BD + if(a_to_b, 1BD, 0BD)").cast("decimal(38,0)")
    size, pay = F.coalesce("packet_length", F.lit(0)), F.coalesce("payload_length", F.lit(0))
    aggs = [F.min(first).alias("_first"), F.min("ts").alias("_t0"),
            F.max("ts").alias("_t1"), F.count("*").alias("_n"), F.sum(pay).alias("_pay")]
    for s, here in (("a", F.col("a_to_b")), ("b", ~F.col("a_to_b"))):
        aggs += [count_when(here).alias(f"_{s}_n"), F.coalesce(F.sum(F.when(here, size)), F.lit(0)).alias(f"_{s}_bytes"),
                 F.coalesce(F.sum(F.when(here, F.col("ttl"))), F.lit(0)).alias(f"_{s}_ttl"),
                 count_when(here & F.col("ttl").isNotNull()).alias(f"_{s}_nttl"),
                 F.coalesce(F.sum(F.when(here, F.col("tcp_window"))), F.lit(0)).alias(f"_{s}_win"),
                 count_when(here & F.col("tcp_window").isNotNull()).alias(f"_{s}_nwin")]
    part = p.groupBy(*FLOW_KEY, "bucket").agg(*aggs)
    run = W.partitionBy(*FLOW_KEY).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cols = {"_fwd_a": F.min("_first").over(run) % 10 == 1, "start_ts": F.min("_t0").over(run),
            "_t1": F.max("_t1").over(run), "total_packets": F.sum("_n").over(run), "payload": F.sum("_pay").over(run)}
    for s in "ab":
        for f in ("n", "bytes", "ttl", "nttl", "win", "nwin"):
            cols[f"_{s}_{f}"] = F.sum(f"_{s}_{f}").over(run)
    cum = part.withColumns(cols)
    fwd = lambda f: F.when(F.col("_fwd_a"), F.col(f"_a_{f}")).otherwise(F.col(f"_b_{f}"))
    rev = lambda f: F.when(F.col("_fwd_a"), F.col(f"_b_{f}")).otherwise(F.col(f"_a_{f}"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    dur = F.col("_t1") - F.col("start_ts")
    end = F.max("bucket").over(W.partitionBy(*FLOW_KEY))
    src = lambda a, b: F.when(F.col("_fwd_a"), F.col(a)).otherwise(F.col(b))
    return cum.select(
        *FLOW_KEY, "bucket", end.alias("end_bucket"), "start_ts",
        src("a_ip", "b_ip").alias("src_ip"), src("a_port", "b_port").alias("src_port"),
        src("b_ip", "a_ip").alias("dst_ip"), src("b_port", "a_port").alias("dst_port"),
        fwd("bytes").alias("src_bytes"), rev("bytes").alias("dst_bytes"), fwd("n").alias("fwd_packets"),
        rev("n").alias("rev_packets"), "total_packets", "payload", dur.alias("duration"),
        ratio(fwd("ttl"), fwd("nttl")).alias("sttl"), ratio(rev("ttl"), rev("nttl")).alias("dttl"),
        ratio(fwd("win"), fwd("nwin")).alias("swin"), ratio(rev("win"), rev("nwin")).alias("dwin"),
        # consecutive gaps telescope, so their mean needs only the span and the count
        F.when(F.col("total_packets") > 1, dur / (F.col("total_packets") - 1)).alias("iat"))


def _running(changes: DataFrame, sums: dict[str, str], occupied: DataFrame) -> DataFrame:
    """Sum the changes per window, run the sum over windows, keep the windows that hold packets."""
    per = changes.groupBy("capture_id", "bucket").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    grid = occupied.select("capture_id", "bucket", F.lit(True).alias("_keep"))
    run = W.partitionBy("capture_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    full = per.join(grid, ["capture_id", "bucket"], "full_outer")
    full = full.withColumns({k: F.coalesce(F.sum(k).over(run), F.lit(0)) for k in sums})
    return full.filter("_keep").drop("_keep")


def _intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge the [bucket, end_bucket] spans of each key into disjoint ones (+1 / -1 changes)."""
    keys = ["capture_id", *keys]
    spans = df.groupBy(*keys, F.col("first_bucket")).agg(F.max("end_bucket").alias("end_bucket"))
    w = W.partitionBy(*keys).orderBy("first_bucket").rowsBetween(W.unboundedPreceding, -1)
    marked = spans.withColumn("_new", (F.coalesce(F.max("end_bucket").over(w), F.lit(-1)) < F.col("first_bucket")).cast("int"))
    w2 = W.partitionBy(*keys).orderBy("first_bucket").rowsBetween(W.unboundedPreceding, 0)
    isl = marked.withColumn("_i", F.sum("_new").over(w2)).groupBy(*keys, "_i").agg(
        F.min("first_bucket").alias("lo"), F.max("end_bucket").alias("hi"))
    return isl.select("capture_id", F.explode(F.array(
        F.struct(F.col("lo").alias("bucket"), F.lit(1).alias("d")),
        F.struct((F.col("hi") + 1).alias("bucket"), F.lit(-1).alias("d")))).alias("_x")).select("capture_id", "_x.*")


ADDITIVE = ("flow_count", "total_src_bytes", "total_dst_bytes", "total_packets", "fwd_packets", "rev_packets", "payload",
            "proto_tcp_count", "proto_udp_count", "singles", "dur_us", "dur_us2", "syn", "ack", "rst",
            "sttl", "n_sttl", "dttl", "n_dttl", "swin", "n_swin", "dwin", "n_dwin", "iat", "n_iat")


def flow_window_features(packets: DataFrame, flows: DataFrame, seconds: int) -> DataFrame:
    """Flow features of every window that holds packets (base set and the additive extended ones)."""
    pts = flow_prefix_points(packets, seconds)
    flows = shared(flows.select("capture_id", "start_ts", "end_ts", "src_ip", "src_port", "dst_ip", "dst_port", "syn_count", "ack_count",
                                "rst_count"))
    key = W.partitionBy(*FLOW_KEY).orderBy("bucket")
    occupied = packets.select("capture_id", bucket("ts", seconds).alias("bucket")).distinct()
    us = F.round(F.col("duration") * 1e6).cast("decimal(18,0)")
    val = {
        "total_src_bytes": F.col("src_bytes").cast("double"), "total_dst_bytes": F.col("dst_bytes").cast("double"),
        "total_packets": F.col("total_packets").cast("double"), "fwd_packets": F.col("fwd_packets").cast("double"),
        "rev_packets": F.col("rev_packets").cast("double"), "payload": F.col("payload").cast("double"),
        "singles": (F.col("total_packets") == 1).cast("double"), "dur_us": us, "dur_us2": us * us,
        "flow_count": F.lit(1.0), "proto_tcp_count": (F.col("protocol") == "TCP").cast("double"),
        "proto_udp_count": (F.col("protocol") == "UDP").cast("double")}
    for n in ("sttl", "dttl", "swin", "dwin", "iat"):
        val[n] = F.coalesce(F.col(n), F.lit(0.0))
        val[f"n_{n}"] = F.col(n).isNotNull().cast("double")
    vals = shared(pts.select(*FLOW_KEY, "bucket", "end_bucket", *[v.alias(k) for k, v in val.items()]))
    names = list(val)
    zero = {n: F.lit(0).cast("decimal(38,0)") if n.startswith("dur_us") else F.lit(0.0) for n in names}
    grow = vals.select("capture_id", "bucket", *[
        (F.col(n) - F.coalesce(F.lag(n).over(key), zero[n])).alias(n) for n in names])
    last = vals.filter(F.col("bucket") == F.col("end_bucket")).select(
        "capture_id", (F.col("bucket") + 1).alias("bucket"), *[(-F.col(n)).alias(n) for n in names])
    # flag counters are whole-flow values in every window the flow spans
    f = flows.select("capture_id", bucket("start_ts", seconds).alias("lo"), bucket("end_ts", seconds).alias("hi"),
                     F.col("syn_count").cast("double").alias("syn"), F.col("ack_count").cast("double").alias("ack"),
                     F.col("rst_count").cast("double").alias("rst"))
    flag = f.select("capture_id", F.explode(F.array(
        F.struct(F.col("lo").alias("bucket"), F.col("syn"), F.col("ack"), F.col("rst")),
        F.struct((F.col("hi") + 1).alias("bucket"), (-F.col("syn")).alias("syn"), (-F.col("ack")).alias("ack"),
                 (-F.col("rst")).alias("rst")))).alias("_x")).select("capture_id", "_x.*")
    changes = grow.unionByName(last).unionByName(flag, allowMissingColumns=True)
    # distinct endpoints among live flows
    spans = flows.select("capture_id", bucket("start_ts", seconds).alias("first_bucket"),
                         bucket("end_ts", seconds).alias("end_bucket"), "src_ip", "src_port", "dst_ip", "dst_port")
    for side, col in (("src", "unique_src_ports"), ("dst", "unique_dst_ports")):
        part = _intervals(spans.filter(F.col(f"{side}_port").isNotNull()), [f"{side}_ip", f"{side}_port"])
        changes = changes.unionByName(part.select("capture_id", "bucket", F.col("d").cast("double").alias(col)),
                                      allowMissingColumns=True)
    # per port: change of n * log2(n), from which the port entropy of each window follows
    port = spans.filter("dst_port IS NOT NULL").select("capture_id", "dst_port", F.explode(F.array(
        F.struct(F.col("first_bucket").alias("bucket"), F.lit(1).alias("d")),
        F.struct((F.col("end_bucket") + 1).alias("bucket"), F.lit(-1).alias("d")))).alias("_x"))
    port = port.groupBy("capture_id", "dst_port", F.col("_x.bucket").alias("bucket")).agg(F.sum("_x.d").alias("d"))
    pw = W.partitionBy("capture_id", "dst_port").orderBy("bucket")
    port = port.withColumn("_c", F.sum("d").over(pw.rowsBetween(W.unboundedPreceding, 0)))
    nlogn = F.when(F.col("_c") > 0, F.col("_c") * F.log2(F.col("_c"))).otherwise(0.0)
    port = port.withColumn("_e", nlogn)
    port = port.select("capture_id", "bucket", F.col("d").cast("double").alias("port_n"),
                       (F.col("_e") - F.coalesce(F.lag("_e").over(pw), F.lit(0.0))).alias("port_nlogn"))
    changes = changes.unionByName(port, allowMissingColumns=True)
    sums = {n: n for n in (*ADDITIVE, "unique_src_ports", "unique_dst_ports", "port_n", "port_nlogn")}
    s = _running(changes, sums, occupied)
    n = F.col("flow_count")
    mean = lambda c: F.when(F.col(f"n_{c}") > 0.5, F.col(c) / F.col(f"n_{c}"))
    d1, d2 = F.col("dur_us").cast("double") / 1e6, F.col("dur_us2").cast("double") / 1e12
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return s.select(
        "capture_id", "bucket", "flow_count", "total_src_bytes", "total_dst_bytes", "total_packets",
        F.try_divide(d1, n).alias("mean_duration"),
        F.try_divide(F.col("total_src_bytes") + F.col("total_dst_bytes"), n).alias("mean_flow_bytes"),
        F.try_divide(F.col("total_packets"), n).alias("mean_flow_packets"),
        mean("sttl").alias("mean_sttl"), mean("dttl").alias("mean_dttl"), mean("swin").alias("mean_swin"),
        mean("dwin").alias("mean_dwin"), mean("iat").alias("mean_iat"), "unique_src_ports", "unique_dst_ports",
        "proto_tcp_count", "proto_udp_count", (n - F.col("proto_tcp_count") - F.col("proto_udp_count")).alias("proto_other_count"),
        F.when(n > 1, F.greatest(F.lit(0.0), (d2 - d1 * d1 / n) / (n - 1))).otherwise(0.0).alias("flow_duration_variance"),
        safe("total_src_bytes", "total_dst_bytes").alias("byte_ratio_src_dst"),
        safe("fwd_packets", "rev_packets").alias("packet_ratio_src_dst"),
        F.coalesce(F.try_divide(F.col("singles"), n), F.lit(0.0)).alias("single_packet_flow_ratio"),
        (n / float(seconds)).alias("active_flow_rate"), safe("syn", "ack").alias("tcp_syn_ack_ratio"),
        safe("rst", "ack").alias("tcp_rst_ack_ratio"), safe("proto_udp_count", "flow_count").alias("udp_flow_ratio"),
        F.when(F.col("port_n") > 1, F.log2("port_n") - F.col("port_nlogn") / F.col("port_n")).otherwise(0.0).alias("port_entropy"),
        F.coalesce(F.try_divide(F.col("payload"), n), F.lit(0.0)).alias("mean_payload_bytes"))


def flow_start_gaps(flow_rows: DataFrame, seconds: int) -> DataFrame:
    """Gaps between the starts of the flows live in each window (variance, max, min).

    ``flow_rows``: ``capture_id, bucket, start_ts, rid`` - one narrow row per (flow, window), ``rid`` unique.
    """
    sub = max(1, seconds // 16)
    rows = flow_rows.withColumn("_seg", F.floor(F.col("start_ts") / sub))
    rows = segmented_lag(rows, ["capture_id", "bucket"], "_seg", ["start_ts", "rid"], {"_prev": "start_ts"})
    gap = F.col("start_ts") - F.col("_prev")
    return rows.groupBy("capture_id", "bucket").agg(
        F.coalesce(F.var_samp(gap), F.lit(0.0)).alias("flow_iat_variance"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("flow_iat_max"), F.coalesce(F.min(gap), F.lit(0.0)).alias("flow_iat_min"))


def per_window_flow_state(flows: DataFrame, seconds: int, label: str | None = None) -> DataFrame:
    """Flow rows of a CSV corpus summed into the window of their start; first deltas are against zeros."""
    tb = F.col("fwd_bytes") + F.col("rev_bytes")
    tp = F.col("fwd_packets") + F.col("rev_packets")
    aggs = [F.count("*").alias("flow_count"), F.sum("fwd_bytes").alias("total_src_bytes"),
            F.sum("rev_bytes").alias("total_dst_bytes"), F.sum(tp).alias("total_packets"),
            F.avg(F.col("end_ts") - F.col("start_ts")).alias("mean_duration"), F.avg(tb).alias("mean_flow_bytes"),
            F.avg(tp).alias("mean_flow_packets"), F.count_distinct("dst_port").alias("unique_dst_ports"),
            count_when(F.col("protocol") == "TCP").alias("proto_tcp_count"),
            count_when(F.col("protocol") == "UDP").alias("proto_udp_count"),
            count_when(~F.col("protocol").isin("TCP", "UDP")).alias("proto_other_count")]
    if label:
        aggs.append(F.max(label).alias("attack_state"))
    g = flows.withColumn("bucket", bucket("start_ts", seconds)).groupBy("bucket").agg(*aggs)
    w = W.partitionBy(F.lit(0)).orderBy("bucket")
    prev = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    total = F.col("total_src_bytes") + F.col("total_dst_bytes")
    g = g.withColumn("_tb", total)
    return g.withColumns({
        "delta_flow_count": F.col("flow_count") - prev("flow_count"), "delta_total_bytes": F.col("_tb") - prev("_tb"),
        "delta_total_packets": F.col("total_packets") - prev("total_packets"),
        "delta_ports": F.col("unique_dst_ports") - prev("unique_dst_ports"),
        "rolling_total_bytes": F.avg("_tb").over(w.rowsBetween(-3, 0))}).drop("_tb")


def temporal_deltas(state: DataFrame, syn: str | None = None) -> DataFrame:
    """Differences against the previous observed window (NULL in the first) and rolling means of four."""
    w = W.partitionBy("capture_id").orderBy("bucket")
    tb = F.col("total_src_bytes") + F.col("total_dst_bytes")
    ports = F.col("unique_src_ports") + F.col("unique_dst_ports")
    s = state.withColumns({"_tb": tb, "_ports": ports})
    d = lambda c: F.col(c) - F.lag(c).over(w)
    first = F.lag("bucket").over(w).isNull()
    four = w.rowsBetween(-3, 0)
    cols = {"delta_flow_count": d("flow_count"), "delta_total_bytes": d("_tb"), "delta_total_packets": d("total_packets"),
            "delta_ports": d("_ports"), "delta_iat": d("mean_iat"), "delta_src_bytes": d("total_src_bytes"),
            "delta_dst_bytes": d("total_dst_bytes"),
            "rolling_total_bytes": F.when(~first, F.avg("_tb").over(four)),
            "rolling_flow_rate": F.when(~first, F.avg("flow_count").over(four))}
    if syn:
        cols["delta_syn_count"] = d(syn)
    return s.withColumns(cols).drop("_tb", "_ports")


def flow_lifecycle(flows: DataFrame, occupied: DataFrame, seconds: int) -> DataFrame:
    """Live, new and ended flow counts per observed window.

    A flow starts and ends in windows that hold packets, so new flows are those that start in the
    window and ended ones those whose last window was the previous observed one.
    """
    f = flows.select("capture_id", bucket("start_ts", seconds).alias("lo"), bucket("end_ts", seconds).alias("hi"))
    ch = f.select("capture_id", F.explode(F.array(
        F.struct(F.col("lo").alias("bucket"), F.lit(1).alias("live"), F.lit(1).alias("new"), F.lit(0).alias("last")),
        F.struct((F.col("hi") + 1).alias("bucket"), F.lit(-1).alias("live"), F.lit(0).alias("new"), F.lit(0).alias("last")),
        F.struct(F.col("hi").alias("bucket"), F.lit(0).alias("live"), F.lit(0).alias("new"), F.lit(1).alias("last")))).alias("_x")
    ).groupBy("capture_id", F.col("_x.bucket").alias("bucket")).agg(
        F.sum("_x.live").alias("live"), F.sum("_x.new").alias("new_flows"), F.sum("_x.last").alias("last"))
    grid = occupied.select("capture_id", "bucket").distinct().withColumn("_keep", F.lit(True))
    run = W.partitionBy("capture_id").orderBy("bucket")
    j = ch.join(grid, ["capture_id", "bucket"], "full_outer").withColumn(
        "active_flows", F.sum(F.coalesce("live", F.lit(0))).over(run.rowsBetween(W.unboundedPreceding, 0)))
    return j.filter("_keep").select(
        "capture_id", "bucket", "active_flows", F.coalesce("new_flows", F.lit(0)).alias("new_flows"),
        F.coalesce(F.lag("last").over(run), F.lit(0)).alias("ended_flows"))


def flow_lifecycle_events(flows: DataFrame, occupied: DataFrame, seconds: int) -> DataFrame:
    """The same as rows ``(bucket, flow_id, NEW | ENDED)`` for callers that need the ids."""
    grid = occupied.select("capture_id", "bucket").distinct()
    nxt = grid.select("capture_id", F.col("bucket").alias("hi"),
                      F.lead("bucket").over(W.partitionBy("capture_id").orderBy("bucket")).alias("bucket"))
    f = flows.select("capture_id", "flow_id", bucket("start_ts", seconds).alias("lo"), bucket("end_ts", seconds).alias("hi"))
    ended = f.join(nxt, ["capture_id", "hi"]).filter("bucket IS NOT NULL")
    return f.select("capture_id", F.col("lo").alias("bucket"), "flow_id", F.lit("NEW").alias("event")).unionByName(
        ended.select("capture_id", "bucket", "flow_id", F.lit("ENDED").alias("event")))


def velocity_vector(state: DataFrame, history: int = 8, seconds: int = 60) -> DataFrame:
    """Causal velocity features: deltas, acceleration, volatility, burstiness, regime change."""
    w = W.partitionBy("capture_id").orderBy("bucket")
    hist, four, two = w.rowsBetween(-(history - 1), 0), w.rowsBetween(-3, 0), w.rowsBetween(-1, 0)
    s = state.withColumn("_tb", (F.col("total_src_bytes") + F.col("total_dst_bytes")).cast("double"))
    lag = lambda c, k=1: F.lag(c, k).over(w)
    d = lambda c: F.coalesce(F.col(c) - lag(c), F.lit(0.0)).cast("double")
    accel = (F.col("_tb") - lag("_tb")) - (lag("_tb") - lag("_tb", 2))
    rate = F.col("total_packets") / float(seconds)
    peak = F.col("packet_rate_peak") if "packet_rate_peak" in state.columns else rate
    long_ma = F.avg("_tb").over(hist)
    return s.withColumns({
        "delta_flow_count": d("flow_count"), "delta_total_bytes": d("_tb"), "delta_total_packets": d("total_packets"),
        "rolling_total_bytes": F.avg("_tb").over(four), "acceleration_total_bytes": F.coalesce(accel, F.lit(0.0)),
        "rolling_volatility_bytes": F.stddev_pop("_tb").over(hist),
        "burstiness_index": F.when(lag("bucket").isNull(), 1.0).otherwise(peak / F.greatest(F.lit(1e-5), rate)),
        "regime_change_score": F.abs(F.avg("_tb").over(two) - long_ma) / F.greatest(F.lit(1.0), long_ma + 1.0)}).drop("_tb")


def causal_features(state: DataFrame, history: int = 8) -> DataFrame:
    """Twenty-five causal features over the last ``history`` windows, folds included.

    ``state`` carries the flow features plus ``syn_count, ack_count, rst_count, fin_count``.
    """
    w = W.partitionBy("capture_id").orderBy("bucket")
    h = w.rowsBetween(-(history - 1), 0)
    e = F.lit(1e-5)
    num = ("flow_count", "total_src_bytes", "total_dst_bytes", "unique_dst_ports", "unique_src_ports", "proto_tcp_count",
           "proto_udp_count")
    s = state.withColumns({n: F.col(n).cast("double") for n in num}).withColumn(
        "_tb", F.col("total_src_bytes") + F.col("total_dst_bytes"))
    lag = lambda c, k=1: F.lag(c, k).over(w)
    prev = lambda c: F.coalesce(lag(c), F.col(c))
    prev2 = lambda c: F.coalesce(lag(c, 2), lag(c), F.col(c))
    mean, std = (lambda c: F.avg(c).over(h)), (lambda c: F.stddev_pop(c).over(h))
    f = F.col("flow_count")
    s = s.withColumns({
        "_hist": F.collect_list("flow_count").over(h), "_mf": mean("flow_count"), "_sf": std("flow_count"),
        "_msb": mean("total_src_bytes"), "_ssb": std("total_src_bytes"), "_mdb": mean("total_dst_bytes"),
        "_sdb": std("total_dst_bytes"), "_stb": std("_tb"), "_pf": prev("flow_count"),
        "_ptcp": lag("proto_tcp_count")})
    head = F.element_at("_hist", 1)
    tail = F.slice("_hist", F.lit(2), F.greatest(F.size("_hist") - 1, F.lit(0)))
    ewma = lambda a: F.aggregate(tail, head, lambda acc, x: a * x + (1 - a) * acc)
    cusum = F.aggregate("_hist", F.lit(0.0), lambda acc, x: F.greatest(
        F.lit(0.0), acc + (x - F.col("_mf")) / (F.col("_sf") + e) - 0.5))
    tcp = F.col("proto_tcp_count") / (f + e)
    return s.select(
        "capture_id", "bucket", (f - prev("flow_count")).alias("d_flows"),
        (F.col("total_src_bytes") - prev("total_src_bytes")).alias("d_src_bytes"),
        (F.col("total_dst_bytes") - prev("total_dst_bytes")).alias("d_dst_bytes"),
        (F.col("unique_dst_ports") - prev("unique_dst_ports")).alias("d_ports"),
        ((f - prev("flow_count")) - (prev("flow_count") - prev2("flow_count"))).alias("accel_flows"),
        ((F.col("_tb") - prev("_tb")) - (prev("_tb") - prev2("_tb"))).alias("accel_bytes"),
        F.col("_mf").alias("mean_flows"), F.col("_sf").alias("std_flows"), F.col("_msb").alias("mean_src_bytes"),
        F.col("_ssb").alias("std_src_bytes"), F.col("_mdb").alias("mean_dst_bytes"), F.col("_sdb").alias("std_dst_bytes"),
        ((F.col("_sf") - F.col("_mf")) / (F.col("_sf") + F.col("_mf") + e)).alias("burstiness_flows"),
        ((F.col("total_src_bytes") - F.col("total_dst_bytes")) / (F.col("_tb") + e)).alias("asymmetry_bytes"),
        (F.col("unique_dst_ports") / (f + e)).alias("dst_port_concentration"),
        (F.col("unique_dst_ports") / (F.col("unique_src_ports") + e)).alias("port_ratio"),
        (F.col("syn_count") / (F.col("ack_count") + 1.0)).alias("syn_ack_ratio"),
        ((F.col("rst_count") + F.col("fin_count")) / (F.col("syn_count") + 1.0)).alias("failed_conn_ratio"),
        ((f - F.col("_mf")) / (F.col("_sf") + e)).alias("zscore_flows"),
        ((F.col("_tb") - F.col("_msb") - F.col("_mdb")) / (F.col("_stb") + e)).alias("zscore_bytes"),
        (ewma(0.5) - ewma(0.15)).alias("ewma_difference"), tcp.alias("tcp_ratio"),
        (F.col("proto_udp_count") / (f + e)).alias("udp_ratio"),
        (tcp - F.coalesce(F.col("_ptcp") / (F.col("_pf") + e), tcp)).alias("proto_mix_delta"), cusum.alias("cusum"))


def window_state_counts(windows: DataFrame, label: str, records: str) -> DataFrame:
    """Attack and benign windows, records per window, and counts of consecutive label pairs."""
    w = W.partitionBy(F.lit(0)).orderBy("bucket")
    s = windows.withColumn("_p", F.lag(label).over(w))
    pair = lambda a, b: count_when((F.col("_p") == a) & (F.col(label) == b))
    half = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {records} DESC)")
    return s.agg(F.count("*").alias("windows"), F.sum(records).alias("records"),
                 count_when(F.col(label) == 1).alias("attack_windows"), count_when(F.col(label) == 0).alias("benign_windows"),
                 F.avg(records).alias("mean_records"), half.alias("upper_median_records"),
                 pair(0, 0).alias("n00"), pair(0, 1).alias("n01"), pair(1, 0).alias("n10"), pair(1, 1).alias("n11"))


def unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                                for f in features])).alias("_x")).select(*keys, "_x.*")


def drift_delta(state: DataFrame, features: Sequence[str], history: int = 7, attack_expected: bool = True) -> DataFrame:
    """Current value against the mean of the previous windows, per feature.

    Changes below 10 % and below one unit are dropped; ``effect`` says whether the change speaks for
    or against the hypothesis (an attack, or a quiet baseline).
    """
    rows = unpivot(state, ["capture_id", "bucket"], features)
    w = W.partitionBy("capture_id", "feature").orderBy("bucket").rowsBetween(-history, -1)
    rows = rows.withColumn("baseline", F.avg("value").over(w)).filter("baseline IS NOT NULL")
    rel = (F.col("value") - F.col("baseline")) / F.greatest(F.abs("baseline"), F.lit(1.0))
    rows = rows.withColumn("relative_change", rel).filter(
        (F.abs(rel) >= 0.10) | (F.abs(F.col("value") - F.col("baseline")) >= 1.0))
    rel = F.col("relative_change")
    supports = (rel > 0.10) if attack_expected else ~(rel >= 0.25)
    return rows.withColumns({
        "direction": choose((rel > 0.10, "INCREASE"), (rel < -0.10, "DECREASE"), default="NEUTRAL"),
        "severity": choose((F.abs(rel) >= 0.50, "HIGH"), (F.abs(rel) >= 0.25, "MEDIUM"), default="LOW"),
        "effect": choose((supports, "SUPPORTS"), default="CONTRADICTS")})


def explain_change(state: DataFrame, features: Sequence[str]) -> DataFrame:
    """NEWLY_PRESENT, STABLE (within 5 %), INCREASED, DECREASED or INSUFFICIENT_BASELINE; zero never divides."""
    rows = unpivot(state, ["capture_id", "bucket"], features)
    w = W.partitionBy("capture_id", "feature").orderBy("bucket")
    rows = rows.withColumn("previous", F.lag("value").over(w))
    v, p = F.col("value"), F.col("previous")
    rel = F.when(p != 0, (v - p) / F.abs(p))
    return rows.withColumns({"relative_change": rel, "change": choose(
        (p.isNull() | v.isNull(), "INSUFFICIENT_BASELINE"), ((p == 0) & (v == 0), "STABLE"), ((p == 0) & (v > 0), "NEWLY_PRESENT"),
        (p == 0, "DECREASED"),
        (F.abs(rel) <= 0.05, "STABLE"), (rel > 0, "INCREASED"), default="DECREASED")})


# Model feature name <- window statistic.
PACKET_FEATURES = {
    "packet_count": "packet_count", "mean_packet_size": "packet_size_mean", "min_packet_size": "packet_size_min",
    "max_packet_size": "packet_size_max", "mean_ttl": "ttl_mean", "min_ttl": "ttl_min", "max_ttl": "ttl_max",
    "tcp_syn_count": "syn_count", "tcp_ack_count": "ack_count", "tcp_fin_count": "fin_count", "tcp_rst_count": "rst_count",
    "tcp_psh_count": "psh_count", "tcp_urg_count": "urg_count", "mean_tcp_window": "tcp_window_mean",
    "fragment_count": "fragment_count", "retransmission_count": "tcp_retransmission_count", "packet_mean_iat": "iat_mean",
    "max_iat": "iat_max"}
PACKET_STD = {"std_packet_size": "packet_size_variance", "std_ttl": "ttl_variance", "std_tcp_window": "tcp_window_variance",
              "std_iat": "iat_variance"}


def packet_state(stats: DataFrame) -> DataFrame:
    """Window statistics under the model's feature names; deviations are roots of the variances."""
    return stats.select("capture_id", "bucket", *[F.col(s).cast("double").alias(n) for n, s in PACKET_FEATURES.items()],
                        *[F.sqrt(s).alias(n) for n, s in PACKET_STD.items()])


def state_vector(state: DataFrame, features: Sequence[str]) -> DataFrame:
    """One array per window; windows with any missing feature are left out, never zero-filled."""
    full = state.filter(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    return full.select("capture_id", "bucket", F.array(*[F.col(f).cast("double") for f in features]).alias("vector"))


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
