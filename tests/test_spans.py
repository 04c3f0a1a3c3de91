import random

from pyspark.sql import functions as F

from packetloom.functions import spans as sp
from packetloom.operators import entities, patterns, windows

YEAR = 525_600


def test_blocks_are_an_exact_and_short_cover(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.choice([-1, 0, 1, 7, 100, 3000])) for a in [rng.randrange(-5000, 5000) for _ in range(300)]] + [(0, 1023), (1, 1022), (-1, 0), (None, 3), (3, None)]
    df = spark.createDataFrame(rows, "first long, last int").withColumn("b", sp.span_blocks("first", "last"))
    for r in df.collect():
        cells = sorted(w for b in r.b for w in range(b.block << b.level, (b.block + 1) << b.level))
        assert cells == ([] if r.first is None or r.last is None else list(range(r.first, r.last + 1)))
    long = spark.createDataFrame([(12_345, 12_345 + 999_999), (-7, 1_000_000)], "first long, last long").withColumn("b", sp.span_blocks("first", "last"))
    assert all(len(r.b) <= 40 and sum(1 << b.level for b in r.b) == r.last - r.first + 1 for r in long.collect())


def test_join_and_sums_equal_brute_force(spark):
    rng = random.Random(2)
    spans = [(i, rng.choice("xyz"), (a := rng.randrange(-300, 300)), a + rng.choice([0, 1, 5, 64, 200])) for i in range(120)] + [(900, "x", -YEAR, YEAR), (901, None, 0, 5), (902, "y", 9, 3)]
    points = [(i, rng.choice("xyz"), rng.randrange(-400, 500)) for i in range(200)] + [(800, "x", 400_000), (801, None, 2), (802, "x", None)]
    s = spark.createDataFrame(spans, "sid long, k string, first long, last long")
    p = spark.createDataFrame(points, "pid long, k string, at long")
    want = sorted((pid, sid) for pid, k, at in points for sid, k2, a, b in spans if k is not None and at is not None and k == k2 and a <= at <= b)
    assert sorted(tuple(r) for r in sp.join_spans(p, s, ["k"], "at", "first", "last").select("pid", "sid").collect()) == want
    sums = {(r.k, r["at"]): (r.n, r.ids) for r in sp.window_sums(s, p, ["k"], "at", "first", "last", {"n": F.lit(1), "ids": F.col("sid")}).collect()}
    at_of = {pid: (k, at) for pid, k, at in points}
    brute = {}
    for key in set(at_of.values()):
        hits = [sid for sid, k2, a, b in spans if None not in key and key[0] == k2 and a <= key[1] <= b]
        if hits:
            brute[key] = (len(hits), sum(hits))
    assert sums == brute
    assert sp.join_spans(p, s.filter("false"), ["k"], "at", "first", "last").count() == 0


def test_year_long_episode_and_campaign_cost_few_rows(spark):
    found = [("e", 0, "scan", "HIGH"), ("e", YEAR, "scan", "LOW"), ("f", 5, "dos", "LOW")]
    findings = spark.createDataFrame(found, "entity string, bucket long, attack_category string, severity string")
    ends = spark.createDataFrame([("e", 10, "p1", 80, 2, True), ("e", YEAR - 1, "p2", 443, 3, True), ("e", YEAR + 1, "p3", 22, 9, True), ("f", 5, "p1", 53, 1, True), ("f", 6, "p9", 53, 1, True)],
                                 "entity string, bucket long, peer string, dst_port int, n long, out boolean")
    ep = entities.episodes(findings, ends)
    got = {r.entity: r for r in ep.collect()}
    assert (got["e"].start_window, got["e"].end_window, got["e"].destination_ports, got["e"].session_count) == (0, YEAR, [80, 443], 5)
    assert got["f"].destination_ports == [53] and got["f"].session_count == 1
    targets = entities.episode_targets(ep, ends)
    assert sorted((r.entity, r.target) for r in targets.collect()) == [("e", "p1"), ("e", "p2"), ("f", "p1")]
    camp = patterns.campaigns(ep, targets)
    members = {(r.entity, r.role) for r in patterns.campaign_members(camp, ends).collect()}
    assert members == {("e", "PRIMARY"), ("f", "PRIMARY"), ("p1", "TARGET"), ("p2", "TARGET")}
    assert sorted(r.entity for r in patterns.campaign_dossier(camp, ep).collect()) == ["e", "f"]
    for df in (ep, targets, patterns.campaign_members(camp, ends), patterns.campaign_dossier(camp, ep)):
        assert "explode(sequence(start_window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_flow_rows_and_totals_of_long_flows(spark):
    flows = spark.createDataFrame([(0.0, 60.0 * 1_000_000, 5), (120.0, 130.0, 7), (61.0, 185.0, 1)], "start_ts double, end_ts double, fwd_bytes long")
    held = spark.createDataFrame([(0,), (2,), (3,), (999_999,), (2_000_000,)], "bucket long")
    rows = windows.flow_buckets(flows, 60, held)
    assert sorted((r.bucket, r.fwd_bytes) for r in rows.collect()) == [(0, 5), (2, 1), (2, 5), (2, 7), (3, 1), (3, 5), (999_999, 5)]
    totals = windows.flow_window_totals(flows, 60, held, {"flow_count": F.lit(1), "fwd_bytes": F.col("fwd_bytes")})
    assert sorted(tuple(r) for r in totals.collect()) == [(0, 1, 5), (2, 3, 13), (3, 2, 6), (999_999, 1, 5)]
