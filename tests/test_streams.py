import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import behavior
from packetloom.streaming import live

SCHEMA = "event_time timestamp, packet_index long, entity string, peer string, port int"
T0 = dt.datetime(2024, 1, 1)


def observations(seed, n=600):
    rng = random.Random(seed)
    return [(T0 + dt.timedelta(seconds=10 * i), i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["p1", "p2", None, f"x{rng.randrange(40)}"]), rng.choice([80, 443, None, rng.randrange(30)])) for i in range(n)]


def plain_memory(rows):
    state = {}
    for _, _, e, peer, port in sorted(rows, key=lambda r: r[:2]):
        n, score, peers, ports = state.get(e, (0, 0.0, set(), set()))
        novel = (peer is not None and bool(peers) and peer not in peers) or (port is not None and bool(ports) and port not in ports)
        score = min(1.0, score + 0.15) if novel else max(0.0, score - 0.02)
        state[e] = (n + 1, score, peers | ({peer} - {None}), ports | ({port} - {None}))
    return {e: (n, len(p), len(q), round(s, 9)) for e, (n, s, p, q) in state.items()}


def feed(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def last(table):
    rows = table.groupBy("entity").agg(F.max_by(F.struct("observations", "peers", "ports", "divergence_score"), "observations").alias("x")).select("entity", "x.*")
    return {r.entity: (r.observations, r.peers, r.ports, round(r.divergence_score, 9)) for r in rows.collect()}


def test_memory_of_three_batches_equals_one_pass(spark, tmp_path):
    rows, root = observations(1), live.stream_root(spark)
    for i in range(3):  # every run is a restart from the checkpoint
        feed(spark, rows[200 * i:200 * i + 200], str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        table, _ = live.run_available(live.entity_memory(stream), "update", root=root, rocksdb=True)
        assert last(table) == plain_memory(rows[:200 * i + 200])
    batch = behavior.regime_memory(spark.createDataFrame([r for r in rows if r[2]], SCHEMA).withColumn("ts", F.unix_seconds("event_time")), ["event_time", "packet_index"], "ts")
    assert {r.entity: round(r.divergence_score, 6) for r in batch.collect()} == {e: round(v[3], 6) for e, v in plain_memory(rows).items() if e}
    # a batch writes the entities it touches, no others
    feed(spark, [(T0 + dt.timedelta(days=1), 9999, "b", "p1", 80)], str(tmp_path / "in"))
    table, _ = live.run_available(live.entity_memory(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), "update", root=root, rocksdb=True)
    newest = table.agg(F.max("batch")).first()[0]
    assert [r.entity for r in table.filter(F.col("batch") == newest).collect()] == ["b"]


def test_silent_entities_are_forgotten(spark, tmp_path):
    root, folder = live.stream_root(spark), str(tmp_path / "in")
    hour = dt.timedelta(hours=1)
    for i, rows in enumerate([[(T0, 0, "a", "p", 1), (T0, 1, "b", "p", 1)], [(T0 + hour, 2, "b", "p", 1)], [(T0 + 5 * hour, 3, "c", "p", 1)], [(T0 + 5 * hour, 4, "a", "q", 2), (T0 + 5 * hour, 5, "b", "q", 2)]]):
        feed(spark, rows, folder)
        table, _ = live.run_available(live.entity_memory(spark.readStream.schema(SCHEMA).parquet(folder), idle="90 MINUTE"), "update", root=root, rocksdb=True)
    newest = table.groupBy("entity").agg(F.max_by("observations", "batch").alias("n")).collect()
    assert {r.entity: r.n for r in newest} == {"a": 1, "b": 1, "c": 1}


@pytest.mark.parametrize("novel,rows", [([], 0), ([], 5), ([0], 1), ([3, 4, 9], 40), (list(range(30)), 60)])
def test_memory_step_equals_row_by_row(novel, rows):
    for start in (0.0, 0.5, 1.0):
        score = start
        for i in range(rows):
            score = min(1.0, score + 0.15) if i in novel else max(0.0, score - 0.02)
        assert abs(live.memory_step(start, novel, rows) - score) < 1e-9


BELIEF = "case_id string, protocol string, bytes long"


def test_beliefs_follow_the_batches_and_survive_replays(spark, tmp_path):
    points = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.9), ("y", 1, 0.02), ("z", 1, 0.4)], "case_id string, horizon int, p double")
    table = live.BeliefTable(points, f"{live.stream_root(spark)}/beliefs")
    batches = [[("x", "TCP", 5)], [("x", "TCP", 0), ("x", "ARP", 9), ("y", "TCP", 0)], [("x", "UDP", 1), ("y", "NTP", 4)], [("y", None, None), ("q", "TCP", 1)]]
    want = {("x", 1): 0.5, ("x", 2): 0.9, ("y", 1): 0.02, ("z", 1): 0.4}
    factors = [{"x": 1.15}, {"x": 0.75, "y": 0.75}, {"x": 1.15, "y": 0.75}, {"y": 0.75}]
    root, folder = live.stream_root(spark), str(tmp_path / "in")
    for i, rows in enumerate(batches):
        feed(spark, rows, folder, BELIEF)
        live.run_available(spark.readStream.schema(BELIEF).parquet(folder), each=table.revise, root=root)
        want = {k: max(0.01, min(0.99, p * factors[i][k[0]])) if k[0] in factors[i] else p for k, p in want.items()}
        got = {(r.case_id, r.horizon): r.p for r in table.read().collect()}
        assert got == pytest.approx(want)
        table.revise(spark.createDataFrame(rows, BELIEF), i)  # the same batch again
        assert {(r.case_id, r.horizon): r.p for r in table.read().collect()} == pytest.approx(want)
    assert {(r.case_id, r.horizon): r.revisions for r in table.read().collect()} == {("x", 1): 3, ("x", 2): 3, ("y", 1): 3, ("z", 1): 0}


def test_late_rows_against_the_watermark_before_the_batch(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[(at(100),), (at(5),), (at(1000),)], [(at(850),), (at(700),), (at(300),), (at(2000),)], [(at(1890),)], [(at(10),)]]
    late = live.LateRows(f"{live.stream_root(spark)}/late", 120, 300)
    root, folder = live.stream_root(spark), str(tmp_path / "in")
    for rows in batches:
        feed(spark, rows, folder, "event_time timestamp")
        live.run_available(spark.readStream.schema("event_time timestamp").parquet(folder), each=late.split, root=root)
    counts = {r.batch: (r.packets, r.late, r.dropped, r.max_lateness) for r in late.counts(spark).collect()}
    # watermarks: none, 880, 1880, 1880; windows of 300 s
    assert counts == {0: (3, 0, 0, None), 1: (4, 3, 1, 580.0), 2: (1, 0, 0, None), 3: (1, 1, 1, 1870.0)}
    late.split(spark.createDataFrame(batches[1], "event_time timestamp"), 1)
    assert {r.batch: r.late for r in late.counts(spark).collect()} == {0: 0, 1: 3, 2: 0, 3: 1}
    assert sorted(r.lateness for r in late.late(spark).collect()) == [30.0, 180.0, 580.0, 1870.0]
