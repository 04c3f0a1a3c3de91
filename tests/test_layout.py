"""Flows laid out once: what is counted per source and window is not shuffled again, and equals the counts of plain flows."""

from packetloom.functions.spans import join_spans
from packetloom.operators import behavior as bh, entities as en
from packetloom.session import settled

SCHEMA = "src_ip string, dst_ip string, dst_port int, protocol string, state string, start_ts double, end_ts double, fwd_bytes long, rev_bytes long, fwd_packets long, rev_packets long"


def flows(spark):
    rows = [(f"s{i % 7}", f"d{i % 5}", i % 4, "TCP", ("RESET", "CLOSED")[i % 2], 37.0 * i, 37.0 * i + 5, i, 1, 2, i % 3) for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


def test_counts_per_source_and_window_need_no_shuffle(spark):
    laid = settled(en.by_source_window(flows(spark), 3600))
    met = en.endpoint_rows(laid, 3600).filter("out").select("entity", "bucket", "peer").distinct()
    for df in (met, bh.entity_windows(laid, 3600)):
        assert "ENSURE_REQUIREMENTS" not in plan(df)


def test_laid_out_flows_give_the_counts_of_plain_ones(spark):
    plain, laid = flows(spark), settled(en.by_source_window(flows(spark), 3600))
    same(bh.entity_windows(plain, 3600), bh.entity_windows(laid, 3600))
    ends = [en.endpoint_rows(f, 3600) for f in (plain, laid)]
    same(*[en.peer_counts(e) for e in ends])
    same(*[en.entity_peers(e) for e in ends])
    none = spark.createDataFrame([], "entity string, bucket long, attack_category string, severity string")
    same(*[en.entity_history(e, none) for e in ends])
    score = [{(r.src_ip, r.dst_ip, r.dst_port): round(r.score, 9) for r in bh.beaconing(f).collect()} for f in (plain, laid)]
    assert score[0] == score[1] and score[0]


def test_points_are_not_multiplied_by_levels(spark):
    """Points meet their spans through the windows of their key: only those are listed once a level."""
    points = spark.createDataFrame([("a", 5, i) for i in range(50)], "k string, at long, i int")
    spans = spark.createDataFrame([("a", 0, 1000)], "k string, first long, last long")
    out = join_spans(points, spans, ["k"], "at", "first", "last")
    assert out.count() == 50
    tree = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread = next(i for i, line in enumerate(tree) if "Generate explode(sequence" in line)
    assert any("Aggregate [k" in line for line in tree[spread:])


def test_views_from_totals_equal_those_from_sessions(spark):
    """Sessions are read once a direction for all views; missing ports and states, port 0 and hosts on both sides included."""
    odd = [("s1", "s2", None, "TCP", "RESET", 40.0, 41.0, 1, 1, 1, 1), ("s2", "s1", 0, "TCP", None, 41.0, 50.0, 2, 2, 2, 2), ("s9", "s1", None, None, None, 9000.0, 9001.0, 1, 0, 1, 0)]
    laid = settled(en.by_source_window(flows(spark).union(spark.createDataFrame(odd, SCHEMA)), 3600))
    ends = en.endpoint_rows(laid, 3600)
    sent = settled(en.window_totals(ends, True))
    assert "ENSURE_REQUIREMENTS" not in plan(en.window_totals(ends, True))
    ew = bh.entity_windows(laid, 3600, sent)
    assert "ENSURE_REQUIREMENTS" not in plan(ew)
    same(bh.entity_windows(laid, 3600).select(*ew.columns), ew)
    totals = sent.unionByName(en.window_totals(ends, False))
    found = spark.createDataFrame([("s1", 0, "port_scan", "high"), ("s1", 4, "dos_flood", "critical"), ("d2", 1, "port_scan", "high")],
                                  "entity string, bucket long, attack_category string, severity string")
    history = {r.entity: r for r in en.entity_history(ends, found, totals).collect()}
    for name, rows in ((n, ends.filter(ends.entity == n).collect()) for n in ("s1", "s2", "s9", "d2")):
        got = history[name]
        assert (got.activity_count, got.total_bytes, got.active_windows) == (len(rows), sum(r.bytes for r in rows), len({r.bucket for r in rows}))
        assert (got.unique_ports, got.unique_peers) == (len({r.dst_port for r in rows} - {None}), len({r.peer for r in rows}))
        assert got.observed_states == ",".join(sorted({r.state for r in rows} - {None}))
    none = spark.createDataFrame([], "src_ip string, score double, coefficient_of_variation double, is_beaconing boolean")
    profile = {r.entity: r for r in en.entity_profile(ends, found, none, totals).collect()}
    assert (profile["s9"].targeted_ports_count, profile["s9"].connection_attempts, profile["d2"].connection_attempts) == (0, 1, 0)
    ep = en.episodes(found, ends, 1, 3600, totals)
    same(en.episodes(found, ends, 1, 3600), ep)
    for r in ep.collect():
        during = [e for e in ends.filter(ends.entity == r.entity).collect() if r.start_window <= e.bucket <= r.end_window]
        assert (r.session_count, r.destination_ports) == (len(during), sorted({e.dst_port for e in during} - {None}))
    same(en.episode_targets(ep, ends), en.episode_targets(ep, ends, totals))
