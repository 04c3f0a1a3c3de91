"""Time-sliced communication graphs: snapshots, changes, projections, world state, components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from packetloom.functions.columns import bucket, choose, count_when, private_ip, r, set_size, subnet_24, tag_string
from packetloom.operators.behavior import observed_window_index, with_previous
from packetloom.session import durable, shared

W = Window
EDGE = ["src_ip", "dst_ip", "protocol", "dst_port"]


def graph_edges(flows: DataFrame, seconds: int) -> DataFrame:
    """One row per (window, src, dst, protocol, port) with flows, packets, bytes, weight."""
    f = flows.withColumn("bucket", bucket("start_ts", seconds))
    fwd = F.when(F.coalesce("fwd_packets", F.lit(0)) == 0, 1).otherwise(F.col("fwd_packets"))
    pk, by = fwd + F.col("rev_packets"), F.col("fwd_bytes") + F.col("rev_bytes")
    has = lambda c: F.col(c) if c in flows.columns else F.lit(0)
    g = f.groupBy("bucket", *EDGE).agg(
        F.count("*").alias("flow_count"), F.sum(pk).alias("packet_count"), F.sum(by).alias("byte_count"),
        F.sum(has("syn_count")).alias("syn_count"), F.sum(has("rst_count")).alias("rst_count"),
        F.max(F.col("end_ts") - F.col("start_ts")).alias("max_duration"))
    return g.withColumn("weight", F.col("packet_count") + F.col("byte_count") / 1024.0)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """One row per (window, host): degrees, volumes, port diversity, activity score.

    Built from edges, which already hold one row per peer and port, so a hot host is only as heavy
    as its distinct edges; distinct counts spread those again by value.
    """
    both = F.explode(F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer"), F.lit(True).alias("out")),
        F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("peer"), F.lit(False).alias("out")))).alias("_x")
    e = edges.select("bucket", "dst_port", "packet_count", "byte_count", both).select(
        "bucket", "dst_port", "packet_count", "byte_count", "_x.*")
    out = F.col("out")
    fans = e.select("bucket", "ip", "peer", "out").distinct().groupBy("bucket", "ip").agg(
        count_when(out).alias("fan_out"), count_when(~out).alias("fan_in"))
    n = e.groupBy("bucket", "ip").agg(
        set_size(F.col("dst_port")).alias("port_diversity"),
        F.coalesce(F.sum(F.when(out, F.col("byte_count"))), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum(F.when(~out, F.col("byte_count"))), F.lit(0)).alias("bytes_recv"),
        F.coalesce(F.sum(F.when(out, F.col("packet_count"))), F.lit(0)).alias("packets_sent"),
        F.coalesce(F.sum(F.when(~out, F.col("packet_count"))), F.lit(0)).alias("packets_recv"))
    n = n.join(fans, ["bucket", "ip"])
    n = n.withColumns({"total_degree": F.col("fan_out") + F.col("fan_in"), "_p": F.col("packets_sent") + F.col("packets_recv"),
                       "is_external": ~private_ip("ip")})
    top = n.groupBy("bucket").agg(F.max("_p").alias("_max"))
    score = F.least(F.lit(1.0), F.col("_p") / F.greatest("_max", F.lit(1)) * 0.7 + F.col("total_degree") / 10.0 * 0.3)
    return n.join(top, "bucket").withColumn("activity_score", score).drop("_p", "_max")


def graph_changes(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``is_new``, nodes with change flags, structural change score and roles) against the previous window."""
    idx = observed_window_index(nodes)
    e = with_previous(edges, EDGE, ["flow_count"], idx).withColumn("is_new", F.col("prev_flow_count").isNull()).drop(
        "idx", "prev_flow_count")
    n = nodes.withColumn("_vol", F.col("bytes_sent") + F.col("bytes_recv"))
    n = with_previous(n, ["ip"], ["fan_out", "_vol"], idx)
    first = F.col("idx") == 1
    absent = F.col("prev_fan_out").isNull()
    delta = F.col("fan_out") - F.col("prev_fan_out")
    ratio = (F.col("_vol") + 1) / (F.col("prev__vol") + 1)
    surge = F.coalesce(~first & (delta >= 4), F.lit(False))
    spike = F.coalesce(~first & (ratio > 3.0) & (F.col("_vol") > 50000), F.lit(False))
    n = n.withColumns({
        "new_node": ~first & absent, "sudden_fan_out": surge, "volume_spike": spike, "fan_out_delta": F.when(~first, delta),
        "volume_ratio": F.when(~first, ratio),
        "structural_change": choose((first, 0.0), (absent, 0.8), default=F.least(
            F.lit(1.0), F.when(surge, 0.5).otherwise(0.0) + F.when(spike, 0.4).otherwise(0.0)))})
    roles = tag_string((F.col("fan_out") >= 5, "HIGH_ACTIVITY_NODE"), (F.col("fan_out") >= 5, "LATERAL_SOURCE"),
                       ((F.col("fan_out") < 5) & (F.col("fan_in") >= 5), "SCAN_TARGET"),
                       (F.col("structural_change") >= 0.4, "STRUCTURAL_CHANGE_NODE"))
    n = n.withColumn("role_tags", F.when(roles == "", "NOMINAL_HOST").otherwise(roles))
    return e, n.drop("_vol", "prev__vol", "prev_fan_out")


def change_signals(nodes: DataFrame) -> DataFrame:
    """NEW_NODE, SUDDEN_FAN_OUT and VOLUME_SPIKE rows from :func:`graph_changes` nodes."""
    sig = lambda cond, name, sev, delta: F.when(cond, F.struct(
        F.lit(name).alias("change_type"), sev.alias("severity"), delta.cast("double").alias("metric_delta")))
    rows = F.array_compact(F.array(
        sig(F.col("new_node"), "NEW_NODE", F.when(F.col("fan_out") < 5, "MEDIUM").otherwise("HIGH"), F.col("fan_out")),
        sig(F.col("sudden_fan_out"), "SUDDEN_FAN_OUT", F.lit("HIGH"), F.col("fan_out_delta")),
        sig(F.col("volume_spike"), "VOLUME_SPIKE", F.lit("MEDIUM"), F.col("volume_ratio"))))
    return nodes.select("bucket", F.col("ip").alias("entity"), F.explode(rows).alias("_x")).select("bucket", "entity", "_x.*")


def graph_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = edges.groupBy("bucket").agg(F.count("*").alias("edge_count"), F.sum("byte_count").alias("total_bytes"),
                                    F.sum("packet_count").alias("total_packets"))
    n = nodes.groupBy("bucket").agg(
        F.count("*").alias("node_count"), F.max("fan_out").alias("max_fan_out"), F.max("fan_in").alias("max_fan_in"),
        F.avg("total_degree").alias("mean_degree"), F.count_distinct(subnet_24("ip")).alias("unique_subnets"))
    nn = F.col("node_count")
    return n.join(e, "bucket").withColumn("density", F.when(nn > 1, F.col("edge_count") / (nn * (nn - 1)))
                                          .otherwise(F.col("edge_count").cast("double")))


def latest_bucket(nodes: DataFrame) -> Column:
    return nodes.agg(F.max("bucket").alias("b")).scalar()


def top_nodes(changed: DataFrame, k: int) -> DataFrame:
    """The k most active and k most changed hosts of the last window (ties: more degree, then address)."""
    last = changed.filter(F.col("bucket") == latest_bucket(changed))
    act = last.orderBy(F.desc("activity_score"), F.desc("total_degree"), "ip").limit(k).withColumn("ranking", F.lit("activity"))
    chg = last.orderBy(F.desc("structural_change"), F.desc("fan_out"), "ip").limit(k).withColumn("ranking", F.lit("change"))
    return act.unionByName(chg)


def graph_vector(edges: DataFrame, changed: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sixteen numbers that summarise the last window."""
    lb = latest_bucket(changed)
    m = metrics.filter(F.col("bucket") == lb)
    flag = lambda c: F.col(c).cast("int")
    n = changed.filter(F.col("bucket") == lb).groupBy("bucket").agg(
        F.sum(flag("new_node") + flag("sudden_fan_out") + flag("volume_spike")).alias("changes"),
        count_when(F.col("fan_out") >= 5).alias("active"), count_when(F.col("structural_change") >= 0.4).alias("changed"),
        F.max("activity_score").alias("max_activity"), F.max("structural_change").alias("max_change"))
    e = edges.filter(F.col("bucket") == lb).groupBy("bucket").agg(count_when(F.col("is_new")).alias("new_edges"))
    snaps = metrics.agg(F.count("*").alias("n")).scalar()
    j = m.join(n, "bucket").join(e, "bucket")
    parts = [F.col(c) for c in ("node_count", "edge_count", "density", "max_fan_out", "max_fan_in", "mean_degree",
                                "unique_subnets", "changes", "active", "changed", "new_edges")]
    parts += [F.col("total_bytes") / 1e6, F.col("total_packets") / 1e3, snaps, F.col("max_activity"), F.col("max_change")]
    return j.select("bucket", F.array(*[r(p.cast("double"), 4) for p in parts]).alias("vector"))


def graph_projection(metrics: DataFrame, changed: DataFrame) -> DataFrame:
    """Expected graph shape one to five windows after the last one."""
    w = W.partitionBy(F.lit(0)).orderBy("bucket")
    rate = F.when(F.lag("edge_count").over(w) > 0, F.greatest(F.lit(0.8), F.least(
        F.lit(2.5), F.col("edge_count") / F.lag("edge_count").over(w)))).otherwise(1.0)
    lb = latest_bucket(metrics)
    m = metrics.withColumn("rate", F.coalesce(rate, F.lit(1.0))).filter(F.col("bucket") == lb)
    last = changed.filter(F.col("bucket") == lb)
    threats = last.agg(count_when(F.col("fan_out") >= 5).alias("n")).scalar()
    moved = last.agg(count_when(F.col("structural_change") > 0.3).alias("n")).scalar()
    m = m.withColumns({"threat_nodes": threats, "_moved": moved}).withColumn("horizon_step", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    k = F.col("horizon_step")
    pe = F.floor(F.col("edge_count") * (1 + (F.col("rate") - 1) * F.pow(F.lit(0.6), k)))
    pn = F.col("node_count") + F.col("_moved") * F.least(k, F.lit(2))
    return m.select(
        "horizon_step", pn.alias("predicted_node_count"), pe.alias("predicted_edge_count"), "threat_nodes",
        F.least(F.lit(1.0), F.when(pn > 1, pe / (pn * (pn - 1))).otherwise(F.col("density"))).alias("predicted_density"),
        r(F.col("max_fan_out") * F.when(F.col("threat_nodes") > 0, 1.0 + 0.15 * k).otherwise(1.0), 2).alias("predicted_fanout_expansion"),
        r(F.greatest(F.lit(0.35), F.least(F.lit(0.92), 0.88 * F.exp(-0.12 * k))), 3).alias("propagation_confidence"))


def propagation_targets(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Peers of the last window's spreading hosts that are not spreading themselves."""
    last = changed.filter(F.col("bucket") == latest_bucket(changed))
    threat = last.filter("fan_out >= 5").select("bucket", "ip")
    e = edges.join(last.select("bucket").distinct(), "bucket", "left_semi")
    pair = lambda a, b: e.select("bucket", F.col(a).alias("ip"), F.col(b).alias("peer"))
    peers = pair("src_ip", "dst_ip").unionByName(pair("dst_ip", "src_ip")).join(threat, ["bucket", "ip"], "left_semi")
    peers = peers.select("bucket", F.col("peer").alias("ip")).distinct()
    return peers.join(threat, ["bucket", "ip"], "left_anti")


def graph_evolution(edges: DataFrame, nodes: DataFrame, monitored: int = 256) -> DataFrame:
    """Undirected density, edge and node churn, novelty against the previous window, observability."""
    idx = observed_window_index(nodes)
    e = with_previous(edges.select("bucket", *EDGE).withColumn("one", F.lit(1)), EDGE, ["one"], idx).groupBy("bucket").agg(
        F.count("*").alias("edge_count"), F.count("prev_one").alias("_ke"))
    n = with_previous(nodes.select("bucket", "ip", "total_degree").withColumn("one", F.lit(1)), ["ip"], ["one"], idx).groupBy("bucket").agg(
        F.count("*").alias("node_count"), F.count("prev_one").alias("_kn"), F.avg("total_degree").alias("mean_degree"),
        F.max("total_degree").alias("max_degree"))
    w = W.partitionBy(F.lit(0)).orderBy("bucket")
    v, ec = F.col("node_count"), F.col("edge_count")
    pv, pe = F.lag("node_count").over(w), F.lag("edge_count").over(w)
    return n.join(e, "bucket").select(
        "bucket", "node_count", "edge_count", "mean_degree", "max_degree",
        F.when(v > 1, 2.0 * ec / (v * (v - 1))).otherwise(0.0).alias("graph_density"),
        F.when(v > 1, F.col("max_degree") / (v - 1)).otherwise(0.0).alias("max_betweenness_approx"),
        F.when(pe.isNull(), 0.0).otherwise((ec + pe - 2 * F.col("_ke")) / (ec + pe)).alias("edge_churn_rate"),
        F.when(pv.isNull(), 0.0).otherwise((v + pv - 2 * F.col("_kn")) / (v + pv)).alias("node_churn_rate"),
        F.when(pv.isNull(), 0.0).otherwise((v - F.col("_kn")) / v).alias("peer_novelty_rate"),
        F.least(F.lit(1.0), v / float(monitored)).alias("graph_observability_score"),
        ((v < monitored * 0.5) | (v <= 2)).alias("is_partial_capture"))


def connected_components(pairs: DataFrame, keys: Sequence[str] = (), a: str = "src_ip", b: str = "dst_ip", group_edges: int = 1 << 18) -> DataFrame:
    """``keys, node, component`` (smallest node id): ``keys`` of up to ``group_edges`` edges as one group each, the others, or all without
    ``keys``, by ``star_components``. Both give the same rows."""
    keys = list(keys)
    if not keys:
        return star_components(pairs, keys, a, b)
    u, v = F.col("_u"), F.col("_v")
    e = shared(pairs.select(*keys, F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).filter(u.isNotNull() & v.isNotNull()).distinct())
    # a null key joins nothing, so its nodes stay apart: star_components keeps it so
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    sizes = shared(e.groupBy(*keys).agg(F.count("*").alias("_edges")))
    few = whole & (F.col("_edges") <= group_edges)
    schema = T.StructType([*[e.schema[k] for k in keys], T.StructField("node", e.schema["_u"].dataType), T.StructField("component", e.schema["_u"].dataType)])

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:  # inside, so that tasks need no module of this package
        codes, names = pd.factorize(pd.concat([group["_u"], group["_v"]], ignore_index=True), sort=True)
        left, right = codes[:len(group)], codes[len(group):]
        label = np.arange(len(names))
        while len(left):  # roots take the smaller label until no edge has two
            x, y = label[left], label[right]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
            open_ = label[left] != label[right]
            left, right = left[open_], right[open_]
        out = {name: np.full(len(names), value) for name, value in zip(keys, key)}
        return pd.DataFrame(out | {"node": names, "component": np.asarray(names)[label]})

    if sizes.filter(~few).isEmpty():
        return e.groupBy(*keys).applyInPandas(merged, schema)
    small = e.join(sizes.filter(few).select(*keys), keys, "left_semi").groupBy(*keys).applyInPandas(merged, schema)
    match = reduce(Column.__and__, [e[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    rest = e.join(sizes.filter(~few).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), match, "left_semi")
    return small.unionByName(star_components(rest, keys, "_u", "_v"))


def star_components(pairs: DataFrame, keys: Sequence[str] = (), a: str = "src_ip", b: str = "dst_ip") -> DataFrame:
    """``keys, node, component`` (smallest node id) by alternating large-star / small-star rounds.

    Stars shrink the graph to depth one in a logarithmic number of rounds, whatever its diameter, and
    no adjacency list is ever collected: every step is a min per node and a join. The edge list is
    checkpointed so lost executors do not replay the loop.
    """
    keys = list(keys)
    u, v = F.col("_u"), F.col("_v")
    e = pairs.select(*keys, F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).filter(u.isNotNull() & v.isNotNull())
    nodes = e.select(*keys, u.alias("node")).unionByName(e.select(*keys, v.alias("node"))).distinct()
    cur = durable(e.filter(u != v).distinct())
    last = None
    while True:  # ends when the edge set is stable
        both = cur.unionByName(cur.select(*keys, v.alias("_u"), u.alias("_v")))
        m = both.groupBy(*keys, "_u").agg(F.min("_v").alias("_m")).withColumn("_m", F.least("_m", "_u"))
        # large star: every larger neighbour points to the smallest node around
        large = both.filter(v > u).join(m, [*keys, "_u"]).select(*keys, v.alias("_u"), F.col("_m").alias("_v")).distinct()
        m2 = large.groupBy(*keys, "_u").agg(F.min("_v").alias("_m"))
        # small star: smaller neighbours (and the node) point to the smallest of them
        j = large.join(m2, [*keys, "_u"])
        small = j.select(*keys, v.alias("_u"), F.col("_m").alias("_v")).unionByName(
            j.select(*keys, u.alias("_u"), F.col("_m").alias("_v"))).filter(u != v).distinct()
        cur = durable(small)
        sig = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "_u", "_v").cast("decimal(38,0)")).alias("h")).first()
        if last == sig:
            break
        last = sig
    label = cur.select(*keys, u.alias("node"), F.col("_v").alias("component"))
    return nodes.join(label, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def ip_class(pairs: DataFrame) -> DataFrame:
    s, t = private_ip("src_ip"), private_ip("dst_ip")
    return pairs.withColumns({
        "src_private": s, "dst_private": t, "src_subnet": subnet_24("src_ip"), "dst_subnet": subnet_24("dst_ip"),
        "direction": choose((s & t, "INTERNAL"), (s, "OUTBOUND"), (t, "INBOUND"), default="EXTERNAL")})


def host_profile(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (window, host): peers, probed ports, change against the previous window, risk, uncertainty."""
    probed = edges.filter("dst_port > 0").groupBy("bucket", F.col("src_ip").alias("ip")).agg(
        F.count_distinct("dst_port").alias("probed_ports"))
    n = nodes.join(probed, ["bucket", "ip"], "left").withColumns({
        "probed_ports": F.coalesce("probed_ports", F.lit(0).cast("bigint")), "_vol": F.col("bytes_sent") + F.col("bytes_recv")})
    n = with_previous(n, ["ip"], ["fan_out", "_vol"])
    change = F.when(F.col("prev_fan_out").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("fan_out") - F.col("prev_fan_out")) * 0.1
             + F.least(F.lit(0.5), F.abs(F.col("_vol") - F.col("prev__vol")) / F.greatest(F.lit(1.0), F.col("prev__vol").cast("double")) * 0.1)))
    scanner = (F.col("probed_ports") >= 10) | (F.col("fan_out") >= 15)
    n = n.withColumn("temporal_change_score", change).withColumn("is_scanner", scanner)
    risk = (F.lit(0.05) + F.when(F.col("is_scanner"), 0.45).otherwise(0.0) + F.when(F.col("bytes_sent") > 10000000, 0.20).otherwise(0.0)
            + F.when(F.col("temporal_change_score") > 0.3, 0.15).otherwise(0.0))
    seen = F.col("packets_sent") + F.col("packets_recv")
    return n.select("bucket", "ip", "bytes_sent", "bytes_recv", F.col("fan_out").alias("outbound_peers"), F.col("fan_in").alias("inbound_peers"),
                    "probed_ports", "temporal_change_score", F.least(F.lit(0.99), risk).alias("risk_score"),
                    (F.col("temporal_change_score") * 0.8 + F.when(F.col("is_scanner"), 0.5).otherwise(0.0)).alias("anomaly_score"),
                    F.greatest(F.lit(0.05), 1.0 / (1.0 + F.log1p(seen.cast("double")))).alias("uncertainty"), "is_external")


# --- world state ------------------------------------------------------------------------------
ZEEK_FAILURES = ("REJ", "RSTOS0", "RSTR", "OTH")


def entity_state(edges: DataFrame, sessions: DataFrame, attack_states: DataFrame | None = None) -> DataFrame:
    """Per (window, entity): presence, fan-out, volumes and failure ratio.

    ``sessions``: ``bucket, src_ip, dst_ip, zeek_state``; ``attack_states``: ``entity, attack_state``.
    """
    both = F.explode(F.array(
        F.struct(F.col("src_ip").alias("entity"), F.col("dst_ip").alias("peer"), F.lit(True).alias("out")),
        F.struct(F.col("dst_ip").alias("entity"), F.col("src_ip").alias("peer"), F.lit(False).alias("out")))).alias("_x")
    e = edges.select("bucket", "dst_port", "packet_count", "byte_count", both).select("bucket", "dst_port", "packet_count",
                                                                                   "byte_count", "_x.*")
    out = F.col("out")
    g = e.groupBy("bucket", "entity").agg(
        F.count_distinct("peer").alias("fanout"),
        F.count_distinct(F.when(out & (F.col("dst_port") != 0), F.col("dst_port"))).alias("port_diversity"),
        F.coalesce(F.sum(F.when(out, F.col("byte_count"))), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum(F.when(~out, F.col("byte_count"))), F.lit(0)).alias("bytes_recv"), F.sum("packet_count").alias("packets"))
    per = sessions.groupBy("bucket", "src_ip", "dst_ip").agg(
        F.count("*").alias("n"), count_when(F.col("zeek_state").isin(*ZEEK_FAILURES)).alias("f"))
    s = per.select("bucket", "n", "f", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("entity")).groupBy(
        "bucket", "entity").agg(F.sum("n").alias("sessions"), F.sum("f").alias("failures"))
    g = g.join(s, ["bucket", "entity"], "left")
    g = _presence(g, ["entity"], "NEWLY_EMERGED", "ACTIVE")
    g = g.withColumn("failure_ratio", F.when(F.col("sessions") > 0, F.col("failures") / F.col("sessions")).otherwise(0.0))
    if attack_states is not None:
        g = g.join(attack_states.select("entity", "attack_state"), "entity", "left")
    else:
        g = g.withColumn("attack_state", F.lit(None).cast("string"))
    return g.withColumn("attack_state", F.coalesce("attack_state", F.lit("BENIGN"))).drop("sessions", "failures")


def _presence(rows: DataFrame, keys: Sequence[str], new: str, active: str) -> DataFrame:
    span = rows.groupBy(*keys).agg(F.min("bucket").alias("first_seen_window"), F.max("bucket").alias("last_seen_window"))
    boundary = rows.agg(F.max("bucket").alias("b")).scalar()
    return rows.join(span, list(keys)).withColumn("presence", choose(
        (F.col("bucket") == boundary, "LAST_OBSERVED_AT_CAPTURE_BOUNDARY"),
        (F.col("first_seen_window") == F.col("bucket"), new), default=active))


def relationship_state(edges: DataFrame) -> DataFrame:
    rel = F.concat("src_ip", F.lit("->"), "dst_ip", F.lit(":"), F.coalesce("dst_port", F.lit(0)), F.lit("/"), "protocol")
    rows = edges.select("bucket", *EDGE, F.col("flow_count").alias("connection_count"), "packet_count", "byte_count",
                        rel.alias("relationship_id"))
    return _presence(rows, ["relationship_id"], "NEW", "PERSISTED")


def world_diff(entities: DataFrame, relationships: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows ``(change, item, before, after)`` between windows ``a`` and ``b`` of the world state."""
    pick = lambda df, at, s, cols: df.filter(F.col("bucket") == at).select(*[F.col(c).alias(f"{c}{s}") for c in cols])
    cols = ["entity", "attack_state", "fanout", "packets", "bytes_sent", "bytes_recv"]
    j = pick(entities, a, "_a", cols).join(pick(entities, b, "_b", cols), F.col("entity_a") == F.col("entity_b"), "full_outer")
    both = F.col("entity_a").isNotNull() & F.col("entity_b").isNotNull()
    fa, fb = F.col("fanout_a"), F.col("fanout_b")
    vol = lambda s: F.col(f"bytes_sent_{s}") + F.col(f"bytes_recv_{s}")

    def row(cond, name, before, after):
        return F.when(cond, F.struct(F.lit(name).alias("change"), before.cast("string").alias("before"), after.cast("string").alias("after")))
    null = F.lit(None)
    rows = F.array_compact(F.array(
        row(F.col("entity_a").isNull(), "ENTITY_ADDED", null, null), row(both, "ENTITY_PERSISTED", null, null),
        row(F.col("entity_b").isNull(), "ENTITY_NOT_OBSERVED", null, null),
        row(both & (F.col("attack_state_a") != F.col("attack_state_b")), "ATTACK_STATE_TRANSITION", F.col("attack_state_a"), F.col("attack_state_b")),
        row(both & (fb > fa) & ((fb - fa >= 3) | ((fa > 0) & (fb / fa >= 2.0))), "FANOUT_SURGE", fa, fb),
        row(both & ((F.col("packets_a") != F.col("packets_b")) | (vol("a") != vol("b"))), "VOLUME_DELTA",
            F.col("packets_b") - F.col("packets_a"), vol("b") - vol("a"))))
    ents = j.select(F.coalesce("entity_a", "entity_b").alias("item"), F.explode(rows).alias("_x")).select("item", "_x.*")
    r_a = relationships.filter(F.col("bucket") == a).select(F.col("relationship_id").alias("ra"))
    r_b = relationships.filter(F.col("bucket") == b).select(F.col("relationship_id").alias("rb"))
    rj = r_a.join(r_b, F.col("ra") == F.col("rb"), "full_outer").filter("ra IS NULL OR rb IS NULL")
    rels = rj.select(F.coalesce("ra", "rb").alias("item"),
                     F.when(F.col("ra").isNull(), "RELATIONSHIP_ADDED").otherwise("RELATIONSHIP_NOT_OBSERVED").alias("change"),
                     null.cast("string").alias("before"), null.cast("string").alias("after"))
    return ents.select("item", "change", "before", "after").unionByName(rels)


def entity_timeline_grid(entities: DataFrame, entity: str | None = None) -> DataFrame:
    """Every observed window of each entity's capture, with NOT_OBSERVED rows where it was absent.

    Meant for one ``entity``: a grid of all of them has entities x windows rows (``presence_intervals`` says the same in as
    many rows as there are observations). Absent stretches are generated from the gap to the next observation, so the work is
    the size of the result.
    """
    e = entities if entity is None else entities.filter(F.col("entity") == entity)
    idx = observed_window_index(entities)
    last = idx.agg(F.max("idx").alias("m")).scalar()
    x = e.select("entity", "bucket", "presence", "fanout", "packets").join(idx, "bucket")
    w = W.partitionBy("entity").orderBy("idx")
    x = x.withColumn("_next", F.coalesce(F.lead("idx").over(w), last + 1)).withColumn(
        "_lead", F.when(F.lag("idx").over(w).isNull(), F.col("idx")).otherwise(F.lit(1)))
    own = x.select("entity", "idx", "presence", "fanout", "packets")
    gap = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    holes = F.concat(gap(F.col("idx") + 1, F.col("_next") - 1), gap(F.lit(1), F.col("_lead") - 1))
    miss = x.select("entity", F.explode(holes).alias("idx")).withColumn("presence", F.lit("NOT_OBSERVED"))
    return own.unionByName(miss, allowMissingColumns=True).join(idx, "idx").drop("idx")


def presence_intervals(entities: DataFrame) -> DataFrame:
    """``entity, presence, first_bucket, last_bucket, windows``: each entity's time line as runs of one state, NOT_OBSERVED included.

    The windows are those observed for anyone; a run goes on over windows that follow one another there. An observation
    starts or prolongs a run and may end an absence, so rows grow with observations, not with entities x windows.
    """
    idx = observed_window_index(entities)
    # one row per window of time
    near = W.partitionBy(F.lit(0)).orderBy("idx")
    idx = idx.withColumns({"_before": F.lag("bucket").over(near), "_after": F.lead("bucket").over(near)})
    ends = idx.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.max("idx").alias("n"))
    first, last, n = (ends.select(x).scalar() for x in "abn")
    x = entities.groupBy("entity", "bucket").agg(F.max("presence").alias("presence")).join(idx, "bucket")
    w = W.partitionBy("entity").orderBy("idx")
    island = F.col("idx") - F.row_number().over(W.partitionBy("entity", "presence").orderBy("idx"))
    runs = x.withColumn("_run", island).groupBy("entity", "presence", "_run").agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.count("*").alias("windows")).drop("_run")
    at = x.withColumns({"_pi": F.lag("idx").over(w), "_pa": F.lag("_after").over(w), "_end": F.lead("idx").over(w).isNull()})
    gap = lambda lo, hi, k: F.when(k > 0, F.struct(lo.alias("first_bucket"), hi.alias("last_bucket"), k.cast("bigint").alias("windows")))
    holes = F.array_compact(F.array(gap(F.coalesce("_pa", first), F.col("_before"), F.col("idx") - F.coalesce("_pi", F.lit(0)) - 1),
                                    gap(F.col("_after"), last, F.when(F.col("_end"), n - F.col("idx")))))
    absent = at.select("entity", F.lit("NOT_OBSERVED").alias("presence"), F.explode(holes).alias("_h")).select("entity", "presence", "_h.*")
    return runs.unionByName(absent)
