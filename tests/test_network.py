"""Hand-built packets and flows: sessions, flows, duplicates, windows, beacons, baselines, memory."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import behavior as bh, clean, features as ft, flows as fl, windows as win

SCHEMA = ("capture_id string, packet_index bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, "
          "tcp_flags int, packet_length bigint, payload_length bigint, ttl int, tcp_window int, tcp_seq bigint, more_fragments boolean")
SYN, ACK, FIN, RST = 2, 16, 1, 4


def packets(spark, rows):
    """rows: (forward?, flags, ts[, payload[, seq]])"""
    out = []
    for i, row in enumerate(rows):
        fwd, flags, ts, pay, seq = (*row, *(0, 0)[len(row) - 3:]) if len(row) < 5 else row
        a, b = (("c", 5000), ("s", 80)) if fwd else (("s", 80), ("c", 5000))
        out.append(("x", i, float(ts), a[0], a[1], b[0], b[1], "TCP", flags, 40 + pay, pay, 64, 100, seq, False))
    return spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("rows,state,zeek,history", [
    ([(1, SYN, 0)], "ATTEMPTED", "S0", "S"),
    ([(1, SYN, 0), (1, SYN, 1), (1, SYN, 2)], "ATTEMPTED", "S0", "S"),
    ([(1, SYN, 0), (0, RST | ACK, 1)], "REJECTED", "REJ", "Sra"),
    ([(1, SYN, 0), (1, RST, 1)], "RESET_ATTEMPT", "RSTOS0", "SR"),
    ([(1, SYN, 0), (0, SYN | ACK, 1)], "INCOMPLETE", "OTH", "Sh"),
    ([(1, SYN, 0), (0, SYN | ACK, 1), (1, ACK, 2)], "ESTABLISHED", "S1", "ShA"),
    ([(1, SYN, 0), (0, SYN | ACK, 1), (1, ACK, 2), (1, ACK | FIN, 3), (0, ACK | FIN, 4)], "CLOSED", "SF", "ShAFfa"),
    ([(1, SYN, 0), (0, SYN | ACK, 1), (1, ACK, 2, 10), (0, RST, 3)], "RESET", "RSTR", "ShADr"),
    ([(1, ACK, 0, 5), (0, ACK, 1)], "INCOMPLETE", "OTH", "ADa")])
def test_tcp_states(spark, rows, state, zeek, history):
    got = fl.track_tcp_sessions(packets(spark, rows)).collect()
    assert len(got) == 1
    assert (got[0]["connection_state"], got[0]["zeek_state"], got[0]["history_string"]) == (state, zeek, history)


def test_udp_and_empty_give_no_sessions(spark):
    p = packets(spark, [(1, SYN, 0)])
    assert fl.track_tcp_sessions(p.withColumn("protocol", F.lit("UDP"))).count() == 0
    assert fl.session_metrics(fl.track_tcp_sessions(p.filter("false"))).first()["failed_connection_ratio"] == 0.0


def test_flow_direction_follows_first_packet(spark):
    p = packets(spark, [(0, ACK, 0, 100), (1, ACK, 1, 5), (0, ACK, 3, 7)])
    f = fl.build_flows(p).first()
    assert (f["src_ip"], f["fwd_packets"], f["rev_packets"], f["fwd_bytes"], f["duration"]) == ("s", 2, 1, 187, 3.0)


def test_retransmission_and_duplicates_cross_segments(spark):
    p = packets(spark, [(1, ACK, 0, 10, 0), (1, ACK, 1, 10, 10), (1, ACK, 2, 10, 5), (0, ACK, 3, 10, 0), (1, ACK, 4, 10, 20)])
    got = {r["packet_index"]: r["is_retransmission"] for r in clean.flag_retransmissions(p, segment_rows=2).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False}
    d = p.unionByName(p.withColumn("packet_index", F.col("packet_index") + 100))
    dup = {r["packet_index"]: r["duplicate_of_index"] for r in clean.flag_duplicates(d, segment_rows=3).collect()}
    assert all(dup[i] is None and dup[i + 100] == i for i in range(5))


def test_skewness_edges(spark):
    df = spark.createDataFrame([("two", 1.0), ("two", 9.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("lean", 1.0), ("lean", 1.0), ("lean", 10.0)], "k string, x double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(win.adjusted_skewness(F.col("x")).alias("s")).collect()}
    assert got["two"] == 0.0 and got["flat"] == 0.0 and abs(got["lean"] - 1.7320508) < 1e-6


def test_past_windows_do_not_change_when_packets_arrive(spark):
    rng = random.Random(3)
    rows = [(1, SYN, t, rng.randint(0, 50), t) for t in range(0, 600, 7)]
    p = packets(spark, rows).withColumn("is_retransmission", F.lit(False))
    part = p.filter("ts < 300")
    full_s = {r["bucket"]: r for r in win.packet_window_stats(p, 60).collect()}
    for r in win.packet_window_stats(part, 60).collect():
        assert full_s[r["bucket"]] == r
    a = {r["bucket"]: r for r in ft.flow_window_features(p, fl.build_flows(p), 60).collect()}
    for r in ft.flow_window_features(part, fl.build_flows(part), 60).collect():
        assert {k: round(v, 6) for k, v in r.asDict().items() if isinstance(v, float)} == {k: round(v, 6) for k, v in a[r["bucket"]].asDict().items() if isinstance(v, float)}


def flow_rows(spark, starts):
    return spark.createDataFrame([("a", "b", 443, "TCP", float(s), float(s) + 1) for s in starts], "src_ip string, dst_ip string, dst_port int, protocol string, start_ts double, end_ts double")


def test_periodicity_classes(spark):
    few = bh.periodicity(flow_rows(spark, [0, 60])).first()
    assert few["classification"] == "INSUFFICIENT_OBSERVATIONS" and few["regularity_score"] == 0.0
    clock = bh.periodicity(flow_rows(spark, range(0, 600, 60)), segment_seconds=90).first()
    assert clock["classification"] == "HIGHLY_PERIODIC" and clock["median_interval"] == 60.0 and clock["jitter"] == 0.0
    rng = random.Random(1)
    wild = bh.periodicity(flow_rows(spark, sorted(rng.sample(range(100000), 30))), segment_seconds=5000).first()
    assert wild["classification"] == "IRREGULAR"
    assert bh.periodicity(flow_rows(spark, [0]).filter("false")).count() == 0


def test_beacon_sums_do_not_depend_on_segments(spark):
    rng = random.Random(5)
    f = flow_rows(spark, [i * 100 + rng.randint(-9, 9) for i in range(50)])
    a, b = bh.beaconing(f, segment_seconds=170).first(), bh.beaconing(f, segment_seconds=10 ** 9).first()
    assert a["is_beaconing"] and abs(a["coefficient_of_variation"] - b["coefficient_of_variation"]) < 1e-9


def test_regime_memory_matches_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(bh, "CHUNK", 5)
    rng = random.Random(2)
    rows = [(e, f"p{rng.randint(0, 6 if e == 'a' else 60)}", rng.randint(0, 4), float(i), i) for i, e in enumerate(rng.choice(["a", "a", "b"]) for _ in range(300))]
    df = spark.createDataFrame(rows, "entity string, peer string, port int, ts double, i int")
    got = {r["entity"]: r["divergence_score"] for r in bh.regime_memory(df, ["ts", "i"], "ts", segment_seconds=7).collect()}
    for e in "ab":
        peers, ports, s = set(), set(), 0.0
        for _, peer, port, *_ in (r for r in rows if r[0] == e):
            new = (peers and peer not in peers) or (ports and port not in ports)
            peers.add(peer)
            ports.add(port)
            s = min(1.0, s + 0.15) if new else max(0.0, s - 0.02)
        assert abs(got[e] - s) < 1e-9


def test_gate_and_history(spark):
    w = spark.createDataFrame([("a", i * 60, i * 60 + 60) for i in range(9)] + [("b", 0, 60), ("b", 180, 240)] + [("c", 0, 60)], "capture_id string, window_start bigint, window_end bigint")
    got = {r["capture_id"]: r["history_status"] for r in clean.history_status(w).collect()}
    assert got == {"a": "READY", "b": "GAPPED_HISTORY", "c": "INSUFFICIENT_HISTORY"}


def test_missing_ports_are_a_key(spark):
    """Ten ICMP flows 60 s apart: beaconing, periodic and tagged, with or without a port."""
    from packetloom.operators import behavior, flows as fl
    rows = [("a", "b", p, "ICMP", 1000.0 + 60 * i, 1001.0 + 60 * i, 0, 0) for p in (None, 80) for i in range(10)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, protocol string, start_ts double, end_ts double, syn_count int, ack_count int")
    beacons = behavior.beaconing(df)
    assert {(r.dst_port, r.is_beaconing) for r in beacons.collect()} == {(None, True), (80, True)}
    assert {(r.dst_port, r.interval_count, r.classification) for r in behavior.periodicity(df).collect()} == {(None, 9, "HIGHLY_PERIODIC"), (80, 9, "HIGHLY_PERIODIC")}
    tagged = fl.session_tags(df, beacons)
    assert tagged.filter("array_contains(split(cast(behavioral_tags as string), ','), 'PERIODIC_BEACONING') or cast(behavioral_tags as string) like '%PERIODIC%'").count() == 20


def test_long_chains_and_many_ports(spark):
    """A trace of more than 20 hops is whole; an episode keeps more than 20 ports; campaigns need a shared target or port."""
    from packetloom.operators import entities, knowledge, patterns
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "source_id string, target_id string")
    assert knowledge.backward_trace(edges, spark.createDataFrame([("n40",)], "id string")).count() == 41
    found = [("e", b, "port_scan", "high") for b in (0, 2, 4)]
    findings = spark.createDataFrame(found, "entity string, bucket long, attack_category string, severity string")
    ends = [("e", 0, "p", 1000 + i, 1, True) for i in range(30)] + [("e", 2, "q", 1000, 1, True), ("e", 4, "r", 7, 1, True), ("e", 1, "z", 9, 1, True)]
    ends = spark.createDataFrame(ends, "entity string, bucket long, peer string, dst_port int, n long, out boolean")
    eps = entities.episodes(findings, ends, 1)
    got = {r.start_window: (len(r.destination_ports), r.session_count) for r in eps.collect()}
    assert got == {0: (30, 30), 2: (1, 1), 4: (1, 1)}
    camps = patterns.campaigns(eps, entities.episode_targets(eps, ends), 3)
    assert sorted((r.start_window, r.end_window, r.episode_count) for r in camps.collect()) == [(0, 2, 2), (4, 4, 1)]
